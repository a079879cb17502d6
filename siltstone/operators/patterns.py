"""Many patterns looked for at once: one automaton passes over a text and finds all of them.

Patterns of up to ``MOST_CHARACTERS`` together are one automaton, which each
worker builds once. Beyond that they are dealt to groups by hash, each of about
that size; texts then meet every group, in lots of ``LOT_CHARACTERS``, and a task
holds one automaton and one lot.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_CHARACTERS = 1_000_000  # of the patterns of an automaton, about
LOT_CHARACTERS = 16_000_000  # of the texts that one automaton meets in a task, about

_built: dict = {}  # the automaton of this worker, by a name for the call


class Automaton:
    """All occurrences of patterns, given as {pattern: ids}; the empty pattern occurs in every text."""

    def __init__(self, ids_of: dict[str, list]):
        import ahocorasick

        self.everywhere = ids_of.get("", [])
        self.tree = ahocorasick.Automaton()
        for pattern, ids in ids_of.items():
            if pattern:
                self.tree.add_word(pattern, ids)
        self.any = len(self.tree) > 0
        if self.any:
            self.tree.make_automaton()

    def found(self, text: str | None) -> list:
        """Ids of the patterns that the text holds, each once."""
        if text is None:
            return []
        held = {id(x): x for _, x in self.tree.iter(text)} if self.any else {}
        return [*self.everywhere, *(i for x in held.values() for i in x)]


def _matches(automaton: Automaton, keys: list, texts: list):
    import pyarrow as pa

    items, docs = [], []
    for k, t in zip(keys, texts):
        own = automaton.found(t)
        items += own
        docs += [k] * len(own)
    return pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(docs, pa.int64())], ["item_id", "doc_id"])


def _ids_of(rows) -> dict[str, list]:
    out: dict[str, list] = {}
    for item, pattern in rows:
        out.setdefault(pattern, []).append(item)
    return out


def over(docs: DataFrame, patterns: DataFrame, build, find, schema: str, most: int | None = None) -> DataFrame:
    """What ``find(build(patterns), ids, texts)`` gives, a record batch, for the patterns (item_id, f) and every batch of documents (doc_id, t).

    ``build`` gets [(item_id, f)] without null patterns. Texts are read once and
    not shuffled while the patterns fit one automaton.
    """
    most = most or MOST_CHARACTERS
    asked = patterns.select(F.col("item_id").cast("long"), "f").where("f is not null")
    size = asked.agg(F.sum(F.length("f") + 1)).first()[0] or 0
    texts = docs.select(F.col("doc_id").cast("long"), "t")
    if size <= most:
        held, name = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in asked.collect()]), uuid.uuid4().hex  # at most ``most`` characters

        def run(batches):
            if name not in _built:
                _built.clear()
                _built[name] = build(held.value)
            for b in batches:
                yield find(_built[name], b.column(0).to_pylist(), b.column(1).to_pylist())

        return texts.mapInArrow(run, schema)

    groups = -(-2 * size // most)
    lots = 1 + (texts.agg(F.sum(F.length("t"))).first()[0] or 0) // LOT_CHARACTERS

    def each(n):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    many = texts.select("doc_id", "t", F.pmod(F.xxhash64("doc_id", F.length("t")), F.lit(lots)).alias("lot")).select("doc_id", "t", "lot", each(groups).alias("group"))
    one = asked.select("item_id", "f", F.pmod(F.xxhash64("f"), F.lit(groups)).alias("group"), each(lots).alias("lot"))

    def meet(patterns, texts):
        import pyarrow as pa

        built = build(list(zip(patterns.column("item_id").to_pylist(), patterns.column("f").to_pylist())))
        return pa.Table.from_batches([find(built, texts.column("doc_id").to_pylist(), texts.column("t").to_pylist())])

    return one.groupBy("group", "lot").cogroup(many.groupBy("group", "lot")).applyInArrow(meet, schema)


def containing(docs: DataFrame, patterns: DataFrame, most: int | None = None) -> DataFrame:
    """(item_id, doc_id): which documents (doc_id, t) hold which patterns (item_id, f), as often as rows repeat; nulls match nothing."""
    return over(docs, patterns, lambda rows: Automaton(_ids_of(rows)), _matches, "item_id long, doc_id long", most)
