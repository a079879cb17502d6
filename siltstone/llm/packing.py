"""Packing of tokenised documents into sequences by minimum bin slack.

Documents are tokenised where they lie. What the packing needs of them is how
many pieces have each length: a histogram of at most ``capacity`` entries
however large the corpus, so the bins are planned on it exactly. Each bin takes
the longest length left and, by bitset subset-sum dynamic programming over the
lengths still available, the combination that fills the rest best; that
combination is removed as often as the counts allow. The pieces of a length are
then numbered in parallel, and their numbers are looked up in the plan.
"""

from __future__ import annotations

import json
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .bpe import byte_alphabet
from .common import FEW_ROWS, read_table, row_key, written

CAPACITY = 4096
END_ID = 1
ROWS_PER_BUCKET = 50_000  # pieces numbered in one group at most, about
CACHED = 300_000  # words of each of the two generations of a worker's memo
LATIN_END = "\u0250"  # letters below are composed and have one lower case
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")  # end a word, and are prepared as one stretch

_memos: dict[str, WordIds] = {}  # of this worker, by vocabulary file


def fill(counts: dict[int, int], room: int) -> list[int]:
    """Lengths of a sub-multiset of ``counts`` with the largest sum that fits in ``room``; long ones first."""
    goal, mask, bits = 1 << room, (1 << room + 1) - 1, 1
    steps = []  # (length, how often, bits before)
    for length in sorted((k for k, n in counts.items() if n > 0 and k <= room), reverse=True):
        left, times = min(counts[length], room // length), 1
        while left:
            take = min(times, left)
            steps.append((length, take, bits))
            bits |= bits << length * take & mask
            left -= take
            times *= 2
        if bits & goal:
            break
    at, out = bits.bit_length() - 1, []
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            out += [length] * take
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(how many bins, lengths in each), together holding every counted piece."""
    counts = {k: n for k, n in histogram.items() if n > 0}
    out = []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        rest = fill(counts, capacity - longest)
        counts[longest] += 1
        lengths = [longest, *rest]
        uses = {k: lengths.count(k) for k in set(lengths)}
        times = min(counts[k] // n for k, n in uses.items())
        for k, n in uses.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
        out.append((times, lengths))
    return out


class Slots:
    """Sequence and offset of the i-th piece of each length, by a plan."""

    def __init__(self, bins: list[tuple[int, list[int]]]):
        runs: dict[int, list] = {}
        first = 0
        for times, lengths in bins:
            at: dict[int, list[int]] = {}
            offset = 0
            for k in lengths:
                at.setdefault(k, []).append(offset)
                offset += k
            for k, offsets in at.items():
                runs.setdefault(k, []).append((first, times, offsets))
            first += times
        #: Of each length, run by run: its first piece's number, first bin, pieces in a bin, and where its offsets begin in the last array.
        self.of = {}
        for k, own in runs.items():
            uses = np.array([len(o) for _, _, o in own])
            pieces = uses * np.array([t for _, t, _ in own])
            self.of[k] = np.cumsum(pieces) - pieces, np.array([f for f, _, _ in own]), uses, np.cumsum(uses) - uses, np.array([x for _, _, o in own for x in o])

    def __call__(self, length: int, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the pieces numbered ``i`` of one length."""
        starts, first, uses, begin, offsets = self.of[length]
        run = np.searchsorted(starts, i, "right") - 1
        times, use = np.divmod(i - starts[run], uses[run])
        return first[run] + times, offsets[begin[run] + use]


class WordIds(dict):
    """Little-endian ids of the stretches between spaces, as the library gives them.

    For tokenizers that drop white space and split at it, a text's ids are those
    of its stretches end to end. Vocabularies of which that is not known, or
    that prepare words in another way, are refused. Words met since the memo was
    last full stay, with those met in the time before it: frequent ones never go.
    """

    #: How a vocabulary must prepare texts (fixed values).
    NORMALIZERS = ["NFC", "Replace", "Lowercase"]
    PRE_TOKENIZERS = ["Split", "ByteLevel"]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])], [x["type"] for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        if steps != (self.NORMALIZERS, self.PRE_TOKENIZERS) or not spec["pre_tokenizer"]["pretokenizers"][0]["invert"] or spec["pre_tokenizer"]["pretokenizers"][1]["add_prefix_space"]:
            raise ValueError(f"{path} does not prepare words as these pieces need")
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = {b: c for c, b in byte_alphabet().items()}
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.coded(word)
        if len(word) <= 48:
            if len(self) >= CACHED:
                self.older = {}  # gone before its place is taken
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def coded(self, word: str) -> bytes:
        if word.isalpha():
            if word.isascii():
                return self.plain(word.lower())
            if max(word) < LATIN_END and (data := word.lower()).isalpha():  # composed letters of one word: all that the library's steps before the model do is known
                return self.plain("".join(map(self.letters.__getitem__, data.encode())))
        else:
            bare = word.rstrip(MARKS)
            if len(bare) < len(word) and bare.isalpha() and max(bare) < LATIN_END and bare.lower().isalpha():
                return self[bare] + self[word[len(bare):]]
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes() if word else b""

    def plain(self, letters: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, key_a, key_b): every document's ids and the end id, cut at ``capacity``."""

    def run(batches):
        import pyarrow as pa

        memo, size = _memos[path] if path in _memos else _memos.setdefault(path, WordIds(path)), 4 * capacity
        end = end_id.to_bytes(4, "little")
        for b in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for i, value in enumerate(b.column(1)):
                ids = memo.encode(value.as_py() or "") + end
                for p, lo in enumerate(range(0, len(ids), size)):
                    part = ids[lo:lo + size]
                    rows.append(i)
                    piece.append(p)
                    start.append(lo // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), b.column(2).take(at), b.column(3).take(at)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "key_a", "key_b"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.select("doc_id", "text", *row_key("doc_id", "text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, key_a long, key_b long")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with ``length`` from 1 to ``capacity``) with sequence_id and offset."""
    spark = pieces.sparkSession
    pieces = written(pieces, "pieces", **FEW_ROWS)
    n = pieces.count()
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    sent = spark.sparkContext.broadcast(Slots(plan(histogram, capacity)))
    # the pieces of a length, however many, are numbered in parallel: within a bucket, after all lower buckets
    buckets = max(1, -(-n // ROWS_PER_BUCKET))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("key_a", "key_b", "piece"), F.lit(buckets)))
    before = (
        pieces.groupBy("length", "bucket").count()
        .withColumn("before", F.sum("count").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)))
        .select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    )
    within = W.partitionBy("length", "bucket").orderBy("key_a", "key_b", "piece")
    numbered = pieces.withColumn("i", F.row_number().over(within) - 1).join(before, ["length", "bucket"]).withColumn("i", F.col("i") + F.col("before"))

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def place(length, i):
        import pandas as pd

        length, i = length.to_numpy(), i.to_numpy()
        sequence, offset = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        for k in np.unique(length).tolist():
            own = np.flatnonzero(length == k)
            sequence[own], offset[own] = sent.value(k, i[own])
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    return (
        numbered.withColumn("at", place("length", "i"))
        .select("doc_id", "piece", "start", "length", "ids_crc32", F.col("at.sequence_id").alias("sequence_id"), F.col("at.offset").alias("offset"))
    )


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. Repeated rows and null ids are
    packed each on its own; an empty table gives no rows. Other columns are
    ignored. Only documents longer than ``capacity`` are cut.
    """
    return pack(cut_pieces(docs, path, capacity), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
