"""Language identification by rank-order n-gram profiles.

A language's profile is the order of its most frequent one- to three-letter
sequences, words padded by a blank. A text is ranked the same way, over all of
it, and goes to the language with the smallest out-of-place distance: the sum,
over the text's own top sequences, of how far each stands from its place in the
profile, or the full profile length where it is missing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from .common import read_table, written

PROFILE = 300  # sequences in a profile
LETTERS = 60  # of each language the most frequent letters are told apart; all others count as one more
TRAIN_PER_LANG = 4000  # bound of the labelled rows that a profile is learned from
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text is a multiple of five, or the id is null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def letter_table(letters: str) -> np.ndarray:
    """Code of each code point: 0 no letter, then one for each of ``letters``, then one for all others; cases fold."""
    table = np.zeros(0x110000, np.uint16)
    for c in range(0x110000):
        if chr(c).isalpha():
            table[c] = len(letters) + 1
    for i, letter in enumerate(letters):
        table[ord(letter)] = i + 1
        if len(letter.upper()) == 1:
            table[ord(letter.upper())] = i + 1
    return table


def sequences(text: str, table: np.ndarray) -> np.ndarray:
    """Numbers of all one- to three-letter sequences of a text, padded by one blank at each word's ends."""
    a = int(table.max()) + 1
    c = np.concatenate([[0], table[code_points(text)], [0]]).astype(np.int32 if a < 1000 else np.int64)
    one = c[c > 0]
    two = c[:-1] * a + c[1:]
    three = two[:-1] * a + c[2:]
    return np.concatenate([one, a + two[two > 0], a + a * a + three[c[1:-1] > 0]])


def counted(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers in order and how often each occurs."""
    if len(numbers) and numbers.max() < 1 << 18:
        counts = np.bincount(numbers)
        found = np.flatnonzero(counts)
        return found, counts[found]
    return np.unique(numbers, return_counts=True)


def ranking(text: str, table: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The text's most frequent sequences, ties by number."""
    found, counts = counted(sequences(text, table))
    return found[np.argsort(-counts, kind="stable")][:size]


class Profiles:
    def __init__(self, letters: str, tops: dict[str, list[int]], size: int = PROFILE):
        self.letters, self.langs, self.size = letters, sorted(tops), size
        # each profile by number, with the places
        self.order = [np.argsort(tops[lang][:size], kind="stable") for lang in self.langs]
        self.numbers = [np.array(tops[lang][:size], np.int64)[o] for lang, o in zip(self.langs, self.order)]

    def places(self, top: np.ndarray) -> np.ndarray:
        """(languages, sequences): the place of each in each profile, the profile's length where it is missing."""
        out = np.full((len(self.langs), len(top)), self.size)
        for row, numbers, order in zip(out, self.numbers, self.order):
            at = np.minimum(np.searchsorted(numbers, top), len(numbers) - 1)
            met = numbers[at] == top
            row[met] = order[at[met]]
        return out

    def classify(self, text: str | None, table: np.ndarray) -> tuple[str, float]:
        """(language, 1 - distance / largest possible distance); ties to the first name."""
        top = ranking(text, table, self.size) if text else np.zeros(0, np.int64)
        if not len(top) or not self.langs:
            return UNKNOWN, 0.0
        distance = np.abs(self.places(top) - np.arange(len(top))).sum(1)
        best = int(distance.argmin())
        return self.langs[best], float(1 - distance[best] / (self.size * len(top)))


def fit(docs: DataFrame, size: int = PROFILE) -> Profiles:
    """Profiles of the labelled rows of ``docs`` (doc_id, text, lang), a bounded sample of each language."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    counts = labelled.groupBy("lang").count().collect()
    share = F.lit(1)
    for r in counts:
        share = F.when(F.col("lang") == r["lang"], F.lit(max(1, r["count"] // (2 * TRAIN_PER_LANG)))).otherwise(share)
    # about twice as many as are needed, of which the first in the order of another hash are taken
    near = labelled.where(F.pmod(F.xxhash64("text", "doc_id"), share) == 0)
    first = W.partitionBy("lang").orderBy(F.xxhash64("doc_id", "text"))
    sample = written(near.withColumn("n", F.row_number().over(first)).where(F.col("n") <= TRAIN_PER_LANG).select("text", "lang"), "labelled")

    def by_language(batches, most=500_000):
        """(language, texts) of a language at a time, of about ``most`` characters together."""
        held: dict[str, list[str]] = {}
        size: dict[str, int] = {}
        for b in batches:
            for text, lang in zip(b.column(0), b.column(1)):
                text, lang = text.as_py(), lang.as_py()
                held.setdefault(lang, []).append(text)
                size[lang] = size.get(lang, 0) + len(text)
                if size[lang] > most:
                    yield lang, held.pop(lang)
                    del size[lang]
        yield from held.items()

    def letters(batches):
        import pyarrow as pa

        for lang, own in by_language(batches):
            c, n = np.unique(code_points("".join(own).lower()), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array([chr(x) for x in c], pa.string()), pa.array(n, pa.int64())], ["lang", "letter", "n"])

    found: dict[str, list] = {}
    for r in sample.mapInArrow(letters, "lang string, letter string, n long").groupBy("lang", "letter").agg(F.sum("n").alias("n")).collect():
        if r["letter"].isalpha():
            found.setdefault(r["lang"], []).append((-r["n"], r["letter"]))
    alphabet = "".join(sorted({x for own in found.values() for _, x in sorted(own)[:LETTERS]}))
    sent = docs.sparkSession.sparkContext.broadcast(letter_table(alphabet))

    def count(batches):
        import pyarrow as pa

        for lang, own in by_language(batches):
            at, n = counted(np.concatenate([sequences(text, sent.value) for text in own]))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "sequence", "n"])

    totals = sample.mapInArrow(count, "lang string, sequence long, n long").groupBy("lang", "sequence").agg(F.sum("n").alias("n"))
    # a profile a language is collected
    best = W.partitionBy("lang").orderBy(F.desc("n"), "sequence")
    tops: dict[str, list[int]] = {}
    for r in totals.withColumn("place", F.row_number().over(best)).where(F.col("place") <= size).orderBy("lang", "place").collect():
        tops.setdefault(r["lang"], []).append(r["sequence"])
    return Profiles(alphabet, tops, size)


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, default all) with lang_pred and score, which take the place of columns so named in any case.

    A null text, or one without a letter, is ``und`` with score 0, as is every
    text if nothing was learned. Texts of any length are ranked whole; repeated
    rows give one row each, an empty table none.
    """
    sent = docs.sparkSession.sparkContext.broadcast((profiles, letter_table(profiles.letters)))

    def run(batches):
        import pyarrow as pa

        held, table = sent.value
        for b in batches:
            out = [held.classify(x.as_py(), table) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], [*b.schema.names[1:], "lang_pred", "score"])

    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("lang_pred", "score")]
    # numbered names, as the names of columns may hold anything
    rows = docs.select(F.col(text_col).cast("string").alias("_text"), *(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)))
    schema = T.StructType([*rows.schema.fields[1:], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema).toDF(*keep, "lang_pred", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), fit(docs), keep=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
