"""Removal of long repeated passages by suffix arrays built in shards.

A corpus has no single suffix array that one machine could hold, so the strings
that might be equal are first brought together. Every window of ``LENGTH``
bytes has an anchor: its 64-byte gram of smallest hash, the first of several.
Equal windows have equal anchors, so consecutive windows with one anchor, or
with equal ones as in periodic text, travel as a piece under its hash. Anchors that occur once cannot lie in a
repeat and are dropped, and equal pieces are counted and sent once. Each shard then sorts the suffixes of its
pieces by induction and reads off the permuted common prefixes which windows
recur.

A passage that a large share of all documents contains makes pieces that agree
in the passage and differ around it. Where an anchor gathers more distinct
pieces than a shard should hold, its windows are divided by their place around
the anchor, again and again by half, each half keyed also by the bytes that all
of its windows share. Pieces of one byte's range are single windows, whose
distinct ones are compared by nothing else, so every group ends up small.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import FEW_ROWS, drop, held, read_table, row_key, slices, splitmix, text_bytes, written
from .suffix_array import permuted_lcp, suffix_array

LENGTH = 400
GRAM = 64
RUN = 4  # windows of a piece at most, in lengths
CHUNK = 1 << 18  # bytes hashed at once; longer texts are taken in overlapping stretches
SHARD = 1 << 19  # bytes of pieces under one suffix array, about
GROUP = 1 << 19  # bytes of distinct pieces that one anchor may bring to a shard
DIVISION = 16 << 20  # bytes of pieces a task sorts, in shards
SEPARATOR = 0xFF  # never a byte of UTF-8

_powers: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _power(n: int):
    """Powers of an odd base and of its inverse modulo 2^64, and random values of the bytes."""
    size = 1 << max(16, n.bit_length())
    if size not in _powers:
        base = np.uint64(0x9E3779B97F4A7C55)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        with np.errstate(over="ignore"):
            up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, base)]), dtype=np.uint64)
            down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, inverse)]), dtype=np.uint64)
            _powers[size] = up, down, splitmix(np.arange(256, dtype=np.uint64))
    return _powers[size]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each ``gram`` consecutive bytes."""
    n = len(data)
    up, down, values = _power(n)
    total = np.concatenate([[np.uint64(0)], np.cumsum(values[data] * up[:n], dtype=np.uint64)])
    return splitmix((total[gram:] - total[:-gram]) * down[: n - gram + 1])


def _smallest(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive keys."""
    n = len(key)
    padded = np.concatenate([key, np.full(-n % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1: n])


def _anchored(data: np.ndarray, bounds: np.ndarray, length: int, gram: int):
    """Of the windows within the texts ``data[bounds[i]:bounds[i + 1]]``: text number, first byte, place and hash of the anchor."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.view(np.uint64)
    hashes = gram_hashes(data, gram)
    place = np.arange(len(hashes), dtype=np.uint64)
    bits = np.uint64((1 << 28) - 1)
    least = _smallest(hashes & ~bits | place, length - gram + 1) & bits
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(least)]
    at = np.flatnonzero(np.arange(len(least)) + length <= bounds[text + 1])
    anchor = least[at].astype(np.int64)
    return text[at], at, anchor, hashes[anchor]


def anchors(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Pieces of the texts ``data[bounds[i]:bounds[i + 1]]``.

    Returns arrays: text number, anchor hash, first byte and end in ``data``,
    and how many anchors the piece has. Each window lies in exactly one piece; a piece has at most ``RUN`` times
    ``length`` windows.
    """
    text, at, anchor, h = _anchored(data, bounds, length, gram)
    if not len(at):
        return text, h, at, at, at
    place = np.arange(len(at))
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])])
    within = place - np.maximum.accumulate(np.where(new, place, 0))
    first = np.flatnonzero(within % (RUN * length) == 0)
    last = np.append(first[1:], len(at)) - 1
    moved = np.concatenate([[0], np.cumsum(anchor[1:] != anchor[:-1])])
    return text[first], h[first], at[first], at[last] + length, moved[last] - moved[first] + 1


def stretches(bounds: np.ndarray, length: int, chunk: int = CHUNK):
    """(first text, last text, bytes to skip in the first, end in it) so that each stretch is about ``chunk`` bytes.

    Stretches of one long text overlap by a window less one byte.
    """
    for first, last in slices(bounds, chunk):
        size = bounds[last] - bounds[first]
        if last - first > 1 or size <= 2 * chunk:
            yield first, last, 0, int(size)
        else:
            for lo in range(0, int(size) - length + 1, chunk):
                yield first, last, lo, min(int(size), lo + chunk + length - 1)


def batch_pieces(column, length: int, gram: int):
    """For each stretch of an Arrow string column: row, hash, first byte and end within the row, number of anchors, and the bytes of the pieces."""
    data, bounds = text_bytes(column)
    for first, last, lo, hi in stretches(bounds, length):
        base = bounds[first] + lo
        part = data[base: bounds[first] + hi]
        own = np.clip(bounds[first: last + 1] - base, 0, len(part))
        text, h, start, end, n = anchors(part, own, length, gram)
        shift = own[text] - (lo if last - first == 1 else 0)
        yield text + first, h.view(np.int64), start - shift, end - shift, n, part, start, end


def _digests(data: bytes, starts, ends) -> np.ndarray:
    import xxhash

    whole = memoryview(data)
    joined = b"".join([xxhash.xxh3_128_digest(whole[a:b]) for a, b in zip(starts, ends)])
    return np.frombuffer(joined, "<i8").reshape(-1, 2)


def recurring(pieces: list[tuple[bytes, bool]], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Per piece the ranges (first, last) of starts of its windows that occur again among ``pieces``.

    A piece marked True occurs more than once in the corpus: its suffixes stand
    for several, so that a window recurs even where no neighbour shares it.
    """
    parts, starts, at = [], [], 0
    mark = bytes([SEPARATOR])
    for data, _ in pieces:
        starts.append(at)
        parts += [data, mark]
        at += len(data) + 1
    t = np.frombuffer(b"".join(parts), np.uint8)
    sa = suffix_array(t, 256)
    lcp = permuted_lcp(t, sa)
    long = lcp >= length
    follow = np.zeros(len(t), bool)  # the suffix after it in order shares as much
    follow[sa[:-1]] = long[sa[1:]]
    again = long | follow
    out = []
    for (data, several), s in zip(pieces, starts):
        own = np.concatenate([[False], again[s: s + len(data) - length + 1] | several, [False]])
        edge = np.flatnonzero(own[1:] != own[:-1])
        out.append(list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist())))
    return out


def _count_anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(h): the anchor hashes that occur more than once."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for _, h, _, _, n, *_ in batch_pieces(b.column(0), length, gram):
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n.astype(np.int64))], ["h", "n"])

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")


def _occurrences(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(key_a, key_b, h, start, size, c_a, c_b): where each piece lies, and its digest."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for row, h, start, end, _, data, lo, hi in batch_pieces(b.column(2), length, gram):
                c = _digests(data.tobytes(), lo.tolist(), hi.tolist())
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(rows), b.column(1).take(rows), *map(pa.array, (h, start, (end - start).astype(np.int32), c[:, 0].copy(), c[:, 1].copy()))],
                    ["key_a", "key_b", "h", "start", "size", "c_a", "c_b"])

    return docs.select("key_a", "key_b", "text").mapInArrow(run, "key_a long, key_b long, h long, start long, size int, c_a long, c_b long")


def _cut_out(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Bytes of the pieces ``wanted`` from the texts."""
    per_text = wanted.groupBy("key_a", "key_b").agg(F.collect_list(F.struct("h", "c_a", "c_b", "start", "size", "copies")).alias("pieces"))
    # rows equal in id and text share a key; one of them is enough
    joined = docs.select("key_a", "key_b", "text").join(per_text, ["key_a", "key_b"])

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):
                data = b.column(2)[i].as_py().encode()
                pieces = b.column(3)[i].values
                f = {n: pieces.field(n) for n in ("h", "c_a", "c_b", "start", "size", "copies")}
                cut = [data[s: s + n] for s, n in zip(f["start"].to_pylist(), f["size"].to_pylist())]
                yield pa.RecordBatch.from_arrays([f["h"], f["c_a"], f["c_b"], f["copies"], pa.array(cut, pa.binary())], ["h", "c_a", "c_b", "copies", "data"])

    out = joined.mapInArrow(run, "h long, c_a long, c_b long, copies long, data binary")
    return out


def _divide(hot: DataFrame, width: int, length: int, gram: int) -> DataFrame:
    """Pieces of crowded anchors by place of their windows around the anchor, ``width`` places together."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        for b in batches:
            rows, lo, keys, digests, parts = [], [], [], [], []
            for i, (old, h, data) in enumerate(zip(*(b.column(n).to_pylist() for n in ("lo", "h", "data")))):
                # a piece of periodic text has several anchors; in each range of windows under one of them, window w has it ``at - w`` places in
                _, at, anchor, _ = _anchored(np.frombuffer(data, np.uint8), np.array([0, len(data)]), length, gram)
                cut = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
                for a, z, at_ in zip(at[cut].tolist(), at[np.append(cut[1:], len(at)) - 1].tolist(), anchor[cut].tolist()):
                    for q in range((at_ - z) // width, (at_ - a) // width + 1):
                        first, end = max(a, at_ - (q + 1) * width + 1), min(z, at_ - q * width)
                        if first > end:
                            continue
                        own = data[first: end + length]
                        core = data[max(0, at_ - q * width): max(0, at_ - (q + 1) * width + 1 + length)]  # in every window of this place
                        keys.append(xxhash.xxh3_64_intdigest(core, h & (2**64 - 1) ^ (q * 1_000_003 + width)) - 2**63)
                        digests.append(xxhash.xxh3_128_digest(own))
                        rows.append(i)
                        lo.append(old + first)
                        parts.append(own)
            c = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(n).take(take) for n in ("h", "c_a", "c_b", "copies")), pa.array(lo, pa.int32()), pa.array(keys, pa.int64()), pa.array(c[:, 0].copy()), pa.array(c[:, 1].copy()), pa.array(parts, pa.binary())],
                ["h", "c_a", "c_b", "copies", "lo", "key", "d_a", "d_b", "data"])

    return hot.mapInArrow(run, "h long, c_a long, c_b long, copies long, lo int, key long, d_a long, d_b long, data binary")


def _sort_shards(pieces: DataFrame, length: int, total: int) -> DataFrame:
    """(key, d_a, d_b, runs) of the distinct pieces (key, d_a, d_b, copies, data), of ``total`` bytes at most, with windows that recur."""
    tasks = max(pieces.sparkSession.sparkContext.defaultParallelism, -(-total // DIVISION))

    def run(batches):
        import pyarrow as pa

        def sort(held):
            found = recurring([(p[4], p[3] > 1) for p in held], length)
            keep = [(p, r) for p, r in zip(held, found) if r]
            return pa.RecordBatch.from_arrays(
                [*(pa.array([p[i] for p, _ in keep], pa.int64()) for i in range(3)), pa.array([[{"first": a, "last": b} for a, b in r] for _, r in keep], pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))],
                ["key", "d_a", "d_b", "runs"])

        held, size = [], 0
        for b in batches:
            for p in zip(*(c.to_pylist() for c in b.columns)):
                if size >= SHARD and p[0] != held[-1][0]:  # between two keys
                    yield sort(held)
                    held, size = [], 0
                held.append(p)
                size += len(p[4])
        if held:
            yield sort(held)

    rows = pieces.select("key", "d_a", "d_b", "copies", "data").repartition(int(tasks), "key").sortWithinPartitions("key")
    return rows.mapInArrow(run, "key long, d_a long, d_b long, runs array<struct<first:int,last:int>>")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(key_a, key_b, spans): byte ranges (first, end) of each text covered by repeated windows, not merged.

    ``docs`` has key_a, key_b (``row_key``) and text. Texts without one are left out.
    """
    repeated = written(_count_anchors(docs, length, gram), "anchors")
    found = written(_occurrences(docs, length, gram).join(repeated, "h", "left_semi"), "pieces")
    drop(repeated)
    distinct = found.groupBy("h", "c_a", "c_b").agg(F.count("*").alias("copies"), F.min_by(F.struct("key_a", "key_b", "start", "size"), F.struct("key_a", "key_b", "start")).alias("one"))
    wanted = distinct.select("h", "c_a", "c_b", "copies", "one.*")
    # equal rows share a key and would each give the piece
    pieces = written(_cut_out(docs, wanted).dropDuplicates(["h", "c_a", "c_b"]), "bytes")
    rest = pieces.select("h", "c_a", "c_b", "copies", F.lit(0).alias("lo"), F.col("h").alias("key"), F.col("c_a").alias("d_a"), F.col("c_b").alias("d_b"), "data")
    # what is stored on the way; of each division only the pieces that are not divided again are read later
    stored, settled, width = [pieces], [], length // 4
    crowded = rest.groupBy("key").agg(F.sum(F.length("data")).alias("bytes")).where(F.col("bytes") > GROUP).select("key")
    while width and not crowded.isEmpty():
        crowded = written(crowded, "crowded")
        settled.append(rest.join(crowded, "key", "left_anti"))
        divided = written(_divide(rest.join(crowded, "key", "left_semi"), width, length, gram), "divided")
        # what no other piece shares is unique from here on
        several = divided.groupBy("key").agg(F.sum("copies").alias("n")).where("n > 1").select("key")
        rest = written(divided.join(several, "key", "left_semi"), "divided")
        drop(divided)
        stored += [crowded, rest]
        once = rest.groupBy("key", "d_a", "d_b").agg(F.first(F.length("data")).alias("bytes"))
        crowded = once.groupBy("key").agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") > GROUP).select("key")
        width //= 2
    settled.append(rest)
    places = reduce(DataFrame.unionByName, settled)
    total = places.agg(F.sum(F.length("data"))).first()[0] or 0  # copies counted: to tell them apart here would shuffle all bytes once more
    # undivided pieces are distinct; parts of different widths never share a key
    once = [part if i == 0 else part.groupBy("key", "d_a", "d_b").agg(F.sum("copies").alias("copies"), F.first("data").alias("data")) for i, part in enumerate(settled)]
    whole = written(_sort_shards(reduce(DataFrame.unionByName, (part.select("key", "d_a", "d_b", "copies", "data") for part in once)), length, total), "runs")
    places = places.select("h", "c_a", "c_b", "lo", "key", "d_a", "d_b")
    runs = places.join(whole, ["key", "d_a", "d_b"]).select("h", "c_a", "c_b", F.transform("runs", lambda r: F.struct((r["first"] + F.col("lo")).alias("first"), (r["last"] + F.col("lo")).alias("last"))).alias("runs"))
    runs = written(runs.groupBy("h", "c_a", "c_b").agg(F.flatten(F.collect_list("runs")).alias("runs")), "runs") if len(settled) > 1 else whole.select(F.col("key").alias("h"), F.col("d_a").alias("c_a"), F.col("d_b").alias("c_b"), "runs")
    for table in [*stored, *([whole] if len(settled) > 1 else [])]:  # bytes of pieces, done with
        drop(table)
    span = F.transform("runs", lambda r: F.struct((F.col("start") + r["first"]).alias("first"), (F.col("start") + r["last"] + length).alias("end")))
    return found.join(runs, ["h", "c_a", "c_b"]).groupBy("key_a", "key_b").agg(F.flatten(F.collect_set(span)).alias("spans"))


def _merged(first: list[int], end: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(zip(first, end)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _with_spans(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """text (null: empty), row (a struct of whether there is a text, and of the other columns) and spans of each row."""
    others = F.struct(F.col("text").isNotNull().alias("text"), *(F.col(c) for c in docs.columns if c != "text"))  # a text goes to tasks once
    keyed = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), others.alias("row"), *row_key("doc_id", "text"))
    with held(docs.sparkSession, **FEW_ROWS):
        spans = repeated_spans(keyed, length, gram)
    return keyed.join(spans, ["key_a", "key_b"], "left").select("text", "row", "spans")


def _kept(data: bytes, spans) -> tuple[bytes, list[tuple[int, int]]]:
    merged = _merged(spans.field("first").to_pylist(), spans.field("end").to_pylist()) if spans is not None else []
    if not merged:
        return data, merged
    cuts = [0, *(x for span in merged for x in span), len(data)]
    return b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2])), merged


def deduplicate(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A null text counts as empty; texts below ``length`` bytes keep all. Rows
    repeated in full count as two documents and lose what they share; ids may be
    null or repeated. Columns other than doc_id and text are ignored, whatever
    their names. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for i in range(b.num_rows):
                data = b.column(0)[i].as_py().encode()
                kept, merged = _kept(data, b.column(2)[i].values)
                out.append((len(data), len(data) - len(kept), len(merged), hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([b.column(1), *(pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string())))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = _with_spans(docs, length, gram).select("text", "row.doc_id", "spans")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def strip_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with the repeated passages cut out of ``text`` and n_chars, where present, renewed.

    Bytes of a character that a cut has split are dropped. Every row stays, and
    a null text stays null.
    """
    def run(batches):
        import pyarrow as pa

        for b in batches:
            text = []
            for i in range(b.num_rows):
                whole = b.column(0)[i].as_py()
                kept, merged = _kept(whole.encode(), b.column(2)[i].values)
                text.append(kept.decode("utf-8", "ignore") if merged else whole)
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), b.column(1)], ["text", "row"])

    rows = _with_spans(docs, length, gram)
    cut = rows.mapInArrow(run, T.StructType(rows.schema.fields[:2]))
    row, text = F.col("row"), F.when(F.col("row")["text"], F.col("text"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return cut.select(*[new.get(c, row[c]).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(read_table(spark, sf_dir, "documents"))
