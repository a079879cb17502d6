"""Where fragments lie in documents whose text was changed on the way: white space, hyphens at line ends, ligatures.

Fragments and documents are compared in a plain form, and what is found there
is told in characters of the document as it is. Short seeds of all fragments,
edges and longest sentences, are looked up in a document by one automaton, and
only fragments with a seed in it are tried. Where characters stand is noted only
of documents that hold a fragment.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from pyspark.sql import DataFrame

from . import patterns

EDGE = 40  # characters of a fragment's begin and end
LEAST_SENTENCE = 24  # a shorter one could be anywhere
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
CHANGED = re.compile(r"[-‐][ \t]*\n\s*|­|\s+|[" + "".join(LIGATURES) + "]|[-‐]")
JOINED = re.compile(r"[-‐][ \t]*\n\s*")  # a word's halves on two lines


def plain(text: str, bare: bool = False) -> str:
    """``Plain(text, bare).value``, without the places of its characters."""
    if "\n" in text:
        text = JOINED.sub("\u00ad", text)  # as a soft hyphen: it parts two runs of white space
    if not text.isascii():
        for ligature, letters in LIGATURES.items():
            text = text.replace(ligature, letters)
    text = " ".join(text.split())
    for hyphen in "-‐":
        text = text.replace(hyphen, "" if bare else "-")
    return text.replace("\u00ad", "").lstrip(" ")


class Plain:
    """A text in plain form, and where its characters stand in the text as it is."""

    def __init__(self, text: str, bare: bool = False):
        """``bare``: without any hyphen."""
        parts, at, length = [], 0, 0
        self.begins, self.origins = [], []  # pieces by their place in the plain form and in the text; a replaced piece has an end

        def put(piece, origin, end=None):
            nonlocal length
            if piece:
                parts.append(piece)
                self.begins.append(length)
                self.origins.append((origin, end))
                length += len(piece)

        for m in CHANGED.finditer(text):
            put(text[at: m.start()], at)
            what = m[0]
            if what in LIGATURES:
                put(LIGATURES[what], m.start(), m.end())
            elif what.isspace():
                if length and m.end() < len(text):
                    put(" ", m.start(), m.end())
            elif what in "-‐" and not bare:
                put("-", m.start(), m.end())
            at = m.end()
        put(text[at:], at)
        self.value = "".join(parts)

    def span(self, first: int, last: int) -> tuple[int, int]:
        """The range in the text of the plain characters from ``first`` up to ``last``."""
        i, j = bisect_right(self.begins, first) - 1, bisect_right(self.begins, last - 1) - 1
        (begin, replaced), (origin, end) = self.origins[i], self.origins[j]
        return begin if replaced is not None else begin + first - self.begins[i], end if end is not None else origin + last - self.begins[j]


def longest_sentence(text: str) -> str:
    found = [s.strip() for s in re.findall(r"[^.!?]+[.!?]*", text)]
    return max((s for s in found if len(s) >= LEAST_SENTENCE), key=len, default="")


class Fragments:
    """Fragments by their seeds, in both plain forms."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.forms = []
        for bare in (False, True):
            needles = [(i, plain(f, bare)) for i, f in rows]
            needles = [(n, i, f) for n, (i, f) in enumerate(needles) if f]
            seeds: dict[str, list] = {}
            for n, _, f in needles:
                for seed in {f[:EDGE], longest_sentence(f)} - {""}:
                    seeds.setdefault(seed, []).append(n)
            self.forms.append((bare, patterns.Automaton(seeds), {n: (i, f) for n, i, f in needles}))

    @staticmethod
    def _tried(value: str, f: str) -> tuple[int, int, str] | None:
        at = value.find(f)
        if at >= 0:
            return at, at + len(f), "exact"
        if len(f) > 2 * EDGE and (at := value.find(f[:EDGE])) >= 0 and (end := value.find(f[-EDGE:], at + EDGE)) >= 0:
            return at, end + EDGE, "edges"
        sentence = longest_sentence(f)
        if sentence and (at := value.find(sentence)) >= 0:
            return at, at + len(sentence), "sentence"
        return None

    def found(self, text: str | None) -> list[tuple[int, int, int, str]]:
        """(fragment, begin, end, how) of the fragments in a text."""
        out, done = [], set()
        for bare, seeds, needles in self.forms if text else ():
            value, places = plain(text, bare), None
            for n in sorted(set(seeds.found(value)) - done):
                hit = self._tried(value, needles[n][1])
                if hit:
                    done.add(n)
                    places = places or Plain(text, bare)
                    out.append((needles[n][0], *places.span(hit[0], hit[1]), "without_hyphens" if bare else hit[2]))
        return out


def _located(fragments: Fragments, keys: list, texts: list):
    import pyarrow as pa

    rows = [(i, k, b, e, how) for k, t in zip(keys, texts) for i, b, e, how in fragments.found(t)]
    columns = list(zip(*rows)) or [[]] * 5
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["item_id", "doc_id", "begin", "end", "how"])


def located(docs: DataFrame, fragments: DataFrame, most: int | None = None) -> DataFrame:
    """(item_id, doc_id, begin, end, how): where fragments (item_id, f) lie in documents (doc_id, t).

    ``how``: exact; edges, with anything between the fragment's first and last
    40 characters; sentence, its longest one; without_hyphens, any of these with
    all hyphens left out. A fragment that is not found in a document, an empty
    one and nulls have no row.
    """
    return patterns.over(docs, fragments, Fragments, _located, "item_id long, doc_id long, begin int, end int, how string", most)
