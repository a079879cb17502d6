"""Filter trees over metadata columns and document text, compiled to one Column.

The wire form is JSON: ``{"field": {"$op": value}}``, ``{"field": value}``,
``{"$and": [...]}``, ``{"$or": [...]}``; for text ``{"$contains": "x"}``,
``{"$not_contains": "x"}`` and ``{"$regex": "x"}``. A missing field fails every
comparison but ``$ne`` and ``$nin``, which it passes.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARISONS = {"$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin"}
ORDERED = {"$gt", "$gte", "$lt", "$lte"}

#: Kinds of documents and the extensions they stand for (fixed values).
FILE_KINDS = {
    "pdf": ["pdf"],
    "text": ["txt", "log", "rtf"],
    "markdown": ["md", "markdown"],
    "html": ["html", "htm", "xhtml"],
    "spreadsheet": ["xlsx", "xls", "ods", "csv", "tsv", "numbers"],
    "word": ["docx", "doc", "odt", "pages"],
    "presentation": ["pptx", "ppt", "odp", "key"],
    "book": ["epub"],
}


def typed(text: str):
    """A literal as free text means it: integer, number, true/false or trimmed text."""
    t = text.strip()
    for kind in (int, float):
        try:
            return kind(t)
        except ValueError:
            pass
    return {"true": True, "false": False}.get(t, t)


def typed_list(text: str) -> list:
    return [typed(x) for x in text.split(",") if x.strip()]


def _kind(value) -> str:
    return "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "string"


@dataclass
class Leaf:
    name: str
    op: str
    value: object

    def problems(self) -> list[str]:
        if not self.name.strip():
            return ["a field is missing"]
        if self.op not in COMPARISONS:
            return [f"unknown comparison {self.op}"]
        if self.op in ORDERED and _kind(self.value) != "number":
            return [f"{self.name}: {self.op} needs a number"]
        if self.op in ("$in", "$nin"):
            if not self.value:
                return [f"{self.name}: the list is empty"]
            if len({_kind(v) for v in self.value}) > 1:
                return [f"{self.name}: the list mixes types"]
        return []

    def column(self, of=F.col) -> Column:
        c = of(self.name)
        if self.op == "$eq":
            return F.coalesce(c == F.lit(self.value), F.lit(False))
        if self.op == "$ne":
            return F.coalesce(c != F.lit(self.value), F.lit(True))
        if self.op == "$in":
            return F.coalesce(c.isin(list(self.value)), F.lit(False))
        if self.op == "$nin":
            return F.coalesce(~c.isin(list(self.value)), F.lit(True))
        number = c.try_cast("double")
        return F.coalesce({"$gt": number > self.value, "$gte": number >= self.value, "$lt": number < self.value, "$lte": number <= self.value}[self.op], F.lit(False))

    def to_json(self) -> dict:
        return {self.name: {self.op: self.value}}


@dataclass
class Group:
    op: str = "$and"
    children: list = field(default_factory=list)

    def problems(self) -> list[str]:
        return [p for c in self.children for p in c.problems()]

    def pruned(self):
        """Without incomplete leaves and empty groups; one child stands for itself; None if nothing is left."""
        kept = []
        for c in self.children:
            c = c.pruned() if isinstance(c, Group) else None if c.problems() else c
            if c is not None:
                kept.append(c)
        return None if not kept else kept[0] if len(kept) == 1 else Group(self.op, kept)

    def column(self, of=F.col) -> Column:
        parts = [c.column(of) for c in self.children]
        if not parts:
            return F.lit(True)
        return reduce((lambda a, b: a & b) if self.op == "$and" else (lambda a, b: a | b), parts)

    def to_json(self) -> dict:
        return {self.op: [c.to_json() for c in self.children]}


def parse(spec: dict | str):
    """The tree of a wire filter; ValueError if it says more than a tree can."""
    spec = json.loads(spec) if isinstance(spec, str) else spec
    if not isinstance(spec, dict):
        raise ValueError("a filter is an object")
    if not spec:
        return Group()
    nodes = []
    for key, value in spec.items():
        if key in ("$and", "$or"):
            nodes.append(Group(key, [parse(v) for v in value]))
        elif key.startswith("$"):
            raise ValueError(f"unknown operator {key}")
        elif isinstance(value, dict):
            if not value or not set(value) <= COMPARISONS:
                raise ValueError(f"unknown comparison for {key}")
            nodes += [Leaf(key, op, v) for op, v in value.items()]
        else:
            nodes.append(Leaf(key, "$eq", value))
    return nodes[0] if len(nodes) == 1 else Group("$and", nodes)


def where(spec: dict | str | None, of=F.col) -> Column:
    """The predicate of a wire filter; all rows if there is none."""
    if not spec:
        return F.lit(True)
    node = parse(spec)
    node = node.pruned() if isinstance(node, Group) else node
    return F.lit(True) if node is None else node.column(of)


def where_document(spec: dict | str | None, text: Column) -> Column:
    """The predicate of a text filter; ``$contains`` respects case."""
    spec = json.loads(spec) if isinstance(spec, str) else spec
    if not spec:
        return F.lit(True)
    parts = []
    for key, value in spec.items():
        if key in ("$and", "$or"):
            inner = [where_document(v, text) for v in value]
            parts.append(reduce((lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b), inner))
        elif key == "$contains":
            parts.append(F.contains(text, F.lit(value)))
        elif key == "$not_contains":
            parts.append(~F.contains(text, F.lit(value)))
        elif key == "$regex":
            parts.append(text.rlike(value))
        else:
            raise ValueError(f"unknown text operator {key}")
    return reduce(lambda a, b: a & b, parts)


def file_types(kinds: list[str], extension: Column) -> Column:
    """Rows whose extension belongs to one of the kinds (or is named itself)."""
    wanted = sorted({e for k in kinds for e in FILE_KINDS.get(k.lower(), [k.lower().lstrip(".")])})
    return F.coalesce(extension.isin(wanted), F.lit(False))


def level_scope(scope: str, level: Column) -> Column:
    """children, parents or all chunks of a two-level collection."""
    if scope == "children":
        return F.coalesce(level != 1, F.lit(True))
    if scope == "parents":
        return F.coalesce(level > 0, F.lit(False))
    return F.lit(True)
