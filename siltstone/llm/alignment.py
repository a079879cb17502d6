"""Alignment of two tokenizers' tokens over the same bytes, as joins and windows.

Both tokenizers split a text at each single space between two other characters
and code what stands between, a stretch, alike wherever it occurs. Tokens are
therefore aligned once for each distinct stretch of the corpus: posexploded,
given byte offsets by a windowed cumulative length, and joined on (stretch,
end); an end that both sides have is a cut, and the running count of cuts names
the groups. Every piece of bytes between neighbouring ends lies in one token of
each side, so the range join for the links needs each end's next token of
either side, which a window carries. A stretch without such a space, be it a
whole text, is one stretch.

Documents are dealt to blocks of about ``BLOCK_BYTES`` of text. A block meets
each of its distinct stretches once, so a word in every document is one row a
block. What was found of them is put together to whole documents within a block,
by looking its stretches up; exploded, every word of the corpus would be a row.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .bpe import byte_alphabet
from .common import drop, join_unevenly, read_table, repeated, written

BLOCK_BYTES = 16_000_000  # of text in a block, about
LEAST_BYTES = 1_000_000  # of text in a block, if there are fewer blocks than tasks
#: A single space between two characters that no tokenizer takes for white space.
SPLIT_AT = r"(?U) (?<=[^\s\x1c-\x1f\u0085\u180e\u200b\ufeff] )(?=[^\s\x1c-\x1f\u0085\u180e\u200b\ufeff])"
SPACE_MARK = "▁"

@lru_cache(maxsize=2)
def _load(path_a: str, path_b: str) -> tuple:
    """(tokenizer A, bytes of its ids, tokenizer B, bytes of its ids); files of another kind are refused.

    Read once a worker: the cache belongs to this function, which tasks get by
    name. A dict named in a task's own function would come to each task empty.
    """
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2
    from tokenizers import Tokenizer

    with open(path_a, encoding="utf-8") as f:
        spec = json.load(f)
    if spec["model"]["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
        raise ValueError(f"{path_a} is no plain byte-level vocabulary")
    a, letters = Tokenizer.from_file(path_a), byte_alphabet()
    a.encode_special_tokens = True
    a.no_truncation()
    a.no_padding()
    a_bytes = {i: bytes(letters[c] for c in token) for token, i in spec["model"]["vocab"].items() if all(c in letters for c in token)}
    held = sentencepiece_model_pb2.ModelProto()
    with open(path_b, "rb") as f:
        held.ParseFromString(f.read())
    rules, pieces = held.normalizer_spec, [p.piece for p in held.pieces]
    across = any(x != SPACE_MARK and y == SPACE_MARK for p in pieces for x, y in zip(p, p[1:]))
    if not held.trainer_spec.byte_fallback or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or not rules.escape_whitespaces or held.trainer_spec.treat_whitespace_as_suffix or across:
        raise ValueError(f"{path_b} does not code words on their own")
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    b_bytes = {i: bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)}
    return a, a_bytes, b, b_bytes


def encoded(stretches: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(stretch, a, b) of rows (stretch): the tokens of either side as arrays of (id, len)."""

    def run(batches):
        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        a, a_bytes, b, b_bytes = _load(path_a, path_b)
        sizes = [np.zeros(max(t) + 1, np.int32) for t in (a_bytes, b_bytes)]
        for size, table in zip(sizes, (a_bytes, b_bytes)):
            for i, x in table.items():
                size[i] = len(x)

        def column(texts, wants, found, table, size):
            ids = list(itertools.chain.from_iterable(found))
            bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])
            own = size[ids]
            ends = np.concatenate([[0], np.cumsum(own, dtype=np.int64)])[bounds]
            if b"".join(map(table.__getitem__, ids)) != b"".join(wants) or (np.diff(ends) != np.fromiter(map(len, wants), np.int64, len(wants))).any():
                raise ValueError(f"the tokens do not give back all of {[t[:40] for t in texts[:9]]}")
            parts = pa.StructArray.from_arrays([pa.array(ids, pa.int32()), pa.array(own)], ["id", "len"])
            return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), parts)

        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.column(0).slice(lo, 1000)
                texts = part.to_pylist()
                spaced = [" " + t for t in texts]
                wants = [t.encode() for t in spaced]
                own_a = [x.ids for x in a.encode_batch_fast(spaced, add_special_tokens=False)]
                own_b = b.encode(texts, num_threads=1)
                yield pa.RecordBatch.from_arrays([part, column(texts, wants, own_a, a_bytes, sizes[0]), column(texts, wants, own_b, b_bytes, sizes[1])], ["stretch", "a", "b"])

    tokens = "array<struct<id:int,len:int>>"
    return stretches.select("stretch").mapInArrow(run, f"stretch string, a {tokens}, b {tokens}")


def aligned(tokens: DataFrame) -> DataFrame:
    """A row for each byte offset at which a token of either side ends: s, end, a_id, b_id, group, a_over, b_over.

    ``a_id`` and ``b_id`` are the tokens that end there; with both, the row is a
    cut. ``a_over`` and ``b_over`` cover the bytes just before it, so each row
    is one link. Groups count down to 1. ``tokens`` (s, a, b) are dealt by
    ``s`` while a row still holds all tokens of a stretch; windows and the join
    of the ends stay in that deal (``COPARTITIONED``).
    """
    tokens = tokens.repartition("s")

    def side(name):
        rows = tokens.select("s", F.posexplode(name).alias("pos", "t"))
        end = F.sum("t.len").over(W.partitionBy("s").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
        return rows.select("s", end.cast("int").alias("end"), F.col("t.id").alias(f"{name}_id"))

    ends = side("a").join(side("b"), ["s", "end"], "full")
    cut = (F.col("a_id").isNotNull() & F.col("b_id").isNotNull()).cast("int")
    back = W.partitionBy("s").orderBy(F.desc("end")).rowsBetween(W.unboundedPreceding, 0)
    return ends.select(
        "*", F.sum(cut).over(back).cast("int").alias("group"), F.last("a_id", ignorenulls=True).over(back).alias("a_over"), F.last("b_id", ignorenulls=True).over(back).alias("b_over"))


#: With it a join of rows that are dealt by some of its keys does not deal them again.
COPARTITIONED = {"spark_sql_requireAllClusterKeysForCoPartition": "false"}


def grouped(ends: DataFrame) -> DataFrame:
    """(s, n_a, n_b, n_groups, n_links, groups, links) of ``aligned`` rows.

    ``groups`` is in the order of the bytes; ``links`` are pairs of ids as one
    number each (A's in the upper half), as often as they occur.
    """
    def of(side):
        return F.filter("row", lambda x: x[side].isNotNull())

    def ids(side):
        return F.array_join(F.transform(of(side), lambda x: x[side].cast("string")), ",")

    one = ends.groupBy("s", "group").agg(F.sort_array(F.collect_list(F.struct("end", "a_id", "b_id", "a_over", "b_over"))).alias("row"))
    links = F.transform("row", lambda x: F.shiftleft(x["a_over"].cast("long"), 32) + x["b_over"])
    said = F.concat_ws("|", ids("a_id"), ids("b_id"))
    one = one.select("s", F.struct((-F.col("group")).alias("k"), said.alias("said"), links.alias("links"), F.size(of("a_id")).alias("n_a"), F.size(of("b_id")).alias("n_b")).alias("g"))
    whole = one.groupBy("s").agg(F.sum("g.n_a").alias("n_a"), F.sum("g.n_b").alias("n_b"), F.sort_array(F.collect_list("g")).alias("g"))
    links = F.flatten(F.transform("g", lambda x: x["links"]))
    return whole.select("s", "n_a", "n_b", F.size("g").cast("long").alias("n_groups"), F.size(links).cast("long").alias("n_links"), F.array_join(F.transform("g", lambda x: x["said"]), ";").alias("groups"), links.alias("links"))


def scores(entries: DataFrame, counts: DataFrame) -> DataFrame:
    """(s, n_best, count_sum) by the links of ``entries`` and counts (pair, docs, best).

    A link carries its stretch's number: the stretch itself would pass both shuffles once a link.
    """
    links = entries.select("s", F.explode("links").alias("pair"))
    n = entries.agg(F.sum("n_links")).first()[0] or 0
    return join_unevenly(links, counts, "pair", n).groupBy("s").agg(F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("docs").alias("count_sum"))


def _looked_up(found):
    """(place of each stretch in ``found``, a function from a text to its stretches in order)."""
    split = re.compile(SPLIT_AT.removeprefix("(?U)")).split
    return {stretch: i for i, stretch in enumerate(found.column("stretch").to_pylist())}.__getitem__, split


def _pairs_held(texts, found):
    """(pair, docs): how many documents of a block hold each pair of ids; a pair counts once a document."""
    import pyarrow as pa

    place, split = _looked_up(found)
    lists = found.column("pairs").combine_chunks()
    bounds = np.asarray(lists.offsets, np.int64) - (lists.offsets[0].as_py() if len(lists) else 0)
    names, own = np.unique(np.asarray(lists.flatten()), return_inverse=True)
    docs = np.zeros(len(names), np.int64)
    for text, copies in zip(texts.column("text").to_pylist(), texts.column("copies").to_pylist()):
        at = np.fromiter(map(place, set(split(text))), np.int64)
        n = bounds[at + 1] - bounds[at]
        held = own[np.repeat(bounds[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        docs[np.unique(held)] += copies
    return pa.table({"pair": pa.array(names, pa.int64()), "docs": docs})


SUMS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def _put_together(texts, found):
    """The documents of a block from what was found of their stretches: doc_id, copies, sums, groups_sha256."""
    import pyarrow as pa

    place, split = _looked_up(found)
    table = np.stack([np.asarray(found.column(c)) for c in SUMS], 1)
    groups, sums, digests = found.column("groups").to_pylist(), [], []
    for text in texts.column("text").to_pylist():
        at = list(map(place, split(text)))
        sums.append(table[at].sum(0))
        digests.append(hashlib.sha256(";".join(map(groups.__getitem__, at)).encode()).hexdigest())
    sums = np.array(sums, np.int64).reshape(-1, len(SUMS))
    columns = {"doc_id": texts.column("doc_id"), "copies": texts.column("copies"), **{c: sums[:, i] for i, c in enumerate(SUMS)}, "groups_sha256": pa.array(digests, pa.string())}
    return pa.table(columns)


def align_documents(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A null or empty text, or one that B does not give back (it holds U+2581),
    has no tokens: zeros and ''. Rows equal in id and text are aligned once,
    count as a document each, and come out each; null ids are ids like others.
    An empty table gives no rows; other columns are ignored. The most that a
    task holds of one row is its text with its tokens and groups.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).groupBy("doc_id", "text").agg(F.count("*").alias("copies"))
    taken = F.coalesce((F.col("text") != "") & ~F.contains("text", F.lit(SPACE_MARK)), F.lit(False))
    rows = written(rows.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", F.when(taken, F.col("text")).alias("text"), "copies"), "texts")
    size, parts = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0, int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = 1 + max(size // BLOCK_BYTES, min(parts, size // LEAST_BYTES))
    texts = rows.where("text is not null").select("doc_id", "text", "copies", F.pmod("key", F.lit(blocks)).cast("int").alias("block"))
    split = F.split("text", SPLIT_AT)

    # the distinct stretches of each block; the tokens of each stretch of the corpus side by side
    met = written(texts.repartition(blocks, "block").select("block", F.explode(F.array_distinct(split)).alias("stretch")).distinct(), "met")
    tokens = encoded(met.select("stretch").distinct(), path_a, path_b).withColumn("s", F.monotonically_increasing_id())
    tokens = written(tokens, "tokens")  # stored, as a lost task must not number them anew
    numbered = written(grouped(aligned(tokens.select("s", "a", "b"))), "numbered", **COPARTITIONED)
    entries = written(numbered.join(tokens.select("s", "stretch"), "s"), "entries")
    drop(tokens)
    drop(numbered)

    def by_block(found, run, schema):
        return texts.groupBy("block").cogroup(met.join(found, "stretch").groupBy("block")).applyInArrow(run, schema)

    # documents that hold a pair
    held = by_block(entries.select("stretch", F.array_distinct("links").alias("pairs")), _pairs_held, "pair long, docs long")
    documents = written(held.groupBy("pair").agg(F.sum("docs").alias("docs")), "documents")
    a_id = F.shiftright("pair", 32).alias("a_id")
    most = documents.groupBy(a_id).agg(F.max("docs").alias("most"))
    counts = written(documents.select(a_id, "pair", "docs").join(most, "a_id").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")), "counts")
    drop(documents)

    # every document's stretches in order, with what was found of each
    scored = written(scores(entries, counts), "scored")
    found = written(entries.drop("links").join(scored, "s").drop("s"), "found")
    for table in (entries, counts, scored):
        drop(table)
    whole = by_block(found, _put_together, f"doc_id long, copies long, {', '.join(f'{c} long' for c in SUMS)}, groups_sha256 string")
    without = rows.where("text is null").select("doc_id", "copies", *(F.lit(0).cast("long").alias(c) for c in SUMS), F.lit("").alias("groups_sha256"))
    return repeated(whole.select(without.columns).unionByName(without), "copies")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
