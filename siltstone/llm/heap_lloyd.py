"""Compression of vectors to codes of their parts by Lloyd's rounds over heaps of bounds.

A vector is cut into ``PARTS`` parts, and each part position has a codebook. A
part that has been compared with all entries knows how much nearer its own
entry was than the next: lower bound minus upper bound, its slack. Entries move
when they are replaced, and the slack can only shrink by how far its own entry
and the farthest mover among the others went. These drifts are summed up for
each entry, so a part's key, slack plus the drift at the time it was compared,
stays as it is, and the part may change its entry only once the drift of today
has reached the key.

Each block of vectors keeps a heap of keys for each entry. A heap's items are
sorted runs, one for each round that compared some of its parts, with the run
of the least key on top; popping takes the violated head of the top run until
no head is violated. Only popped parts are compared again, exactly, with all
entries. Blocks and their heaps are stored between the rounds, each round is
one pass over them, and what leaves a block are the sums that its changed parts
move from entry to entry.

Components are integers. Where their squares stay exact in double precision,
numpy computes with them; larger ones are computed with Python's integers, so
results are exact at any size.
"""

from __future__ import annotations

import hashlib
import heapq
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, join_unevenly, read_table, written

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
BLOCK_ROWS = 1024  # vectors of a block
LIMB = 32  # bits of the digits that sums are sent in
EXACT = 2.0**52  # squared distances below it are exact in double precision
CAREFUL = 1e-9  # of distances, beyond what their rounding can be


def whole_numbers(values: np.ndarray, wide: bool) -> np.ndarray:
    """floor(SCALE * x) of an array of doubles, as doubles or, if ``wide``, as Python's integers."""
    if not wide:
        return np.floor(values * SCALE)
    return np.array([_floored(x) for x in values.ravel().tolist()], object).reshape(values.shape)


def _floored(x: float) -> int:
    n, d = x.as_integer_ratio()
    return n * SCALE // d


def squared(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``x`` to those of ``book``, exact."""
    out = (x * x).sum(1)[:, None] + (book * book).sum(1)[None]
    return out - 2 * np.dot(x, book.T)


def lengths(squares) -> np.ndarray:
    return np.sqrt(squares) if squares.dtype != object else np.array([math.sqrt(v) for v in squares.ravel().tolist()]).reshape(squares.shape)


class Heap:
    """Rows by key as a heap of sorted runs: (least key, run number, keys, rows)."""

    def __init__(self, runs=()):
        self.runs = [(keys[0], i, keys, rows) for i, (keys, rows) in enumerate(runs) if len(keys)]
        heapq.heapify(self.runs)
        self.made = len(self.runs)

    def push(self, keys: np.ndarray, rows: np.ndarray) -> None:
        if len(keys):
            order = np.argsort(keys, kind="stable")
            heapq.heappush(self.runs, (keys[order[0]], self.made, keys[order], rows[order]))
            self.made += 1

    def pop(self, drift: float) -> np.ndarray:
        """Rows whose key the drift has reached, which leave the heap."""
        out = []
        while self.runs and self.runs[0][0] <= drift:
            _, i, keys, rows = self.runs[0]
            n = int(np.searchsorted(keys, drift, "right"))
            out.append(rows[:n])
            if n < len(keys):
                heapq.heapreplace(self.runs, (keys[n], i, keys[n:], rows[n:]))
            else:
                heapq.heappop(self.runs)
        return np.concatenate(out) if out else np.zeros(0, np.int32)


def assign(x: np.ndarray, codes: np.ndarray | None, heaps: list[Heap], book: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, rows compared) of one part position after a pass; ``heaps`` are brought up to date."""
    rows = np.arange(len(x), dtype=np.int32) if codes is None else np.concatenate([h.pop(d) for h, d in zip(heaps, drift)])
    codes = np.zeros(len(x), np.uint8) if codes is None else codes.copy()
    if len(rows):
        d = squared(x[rows], book)
        own = np.argmin(d, 1)  # ties to the lower index
        codes[rows] = own
        upper = lengths(d[np.arange(len(rows)), own])
        if len(book) > 1:
            d[np.arange(len(rows)), own] = d.max() + 1
            lower = lengths(d.min(1))
            keys = (lower - upper) - CAREFUL * (lower + upper) + drift[own]
        else:
            keys = np.full(len(rows), np.inf)
        for e in np.unique(own).tolist():
            of = own == e
            heaps[e].push(keys[of], rows[of])
    return codes, rows


def limbs(value: int, n: int) -> list[int]:
    """``n`` digits of an integer in base 2**LIMB, the last signed; digits of many integers add up like the integers."""
    out = []
    for _ in range(n - 1):
        out.append(value & (1 << LIMB) - 1)
        value >>= LIMB
    return [*out, value]


def from_limbs(digits) -> int:
    return sum(int(d) << LIMB * i for i, d in enumerate(digits))


def moved_on(books: list[list[list[int]]], sums, counts) -> tuple[list[list[list[int]]], np.ndarray]:
    """(codebooks after their entries are replaced by floor(sum / count), drift of each entry in this round)."""
    new, drift = [], np.zeros((len(books), len(books[0]) if books else 0))
    for p, book in enumerate(books):
        new.append([[s // counts[p][e] for s in sums[p][e]] if counts[p][e] else entry for e, entry in enumerate(book)])
        gone = [math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y))) * (1 + CAREFUL) for x, y in zip(book, new[-1])]
        drift[p] = [g + max((h for j, h in enumerate(gone) if j != e), default=0.0) for e, g in enumerate(gone)]
    return new, drift


STATE = "ids array<long>, labels array<string>, x binary, codes binary, rows binary, keys binary, runs array<int>, moved array<long>, compared long"


def _blocks(rows: DataFrame, dim: int) -> DataFrame:
    """Rows (vec_id, label, v) gathered to blocks without codes or heaps."""

    def run(batches):
        import pyarrow as pa

        def block(ids, labels, x):
            none = b""
            return pa.RecordBatch.from_arrays([
                pa.array([ids], pa.list_(pa.int64())), pa.array([labels], pa.list_(pa.string())), pa.array([x.tobytes()], pa.binary()), *(pa.array([none], pa.binary()) for _ in range(3)),
                pa.array([[]], pa.list_(pa.int32())), pa.array([[]], pa.list_(pa.int64())), pa.array([0], pa.int64())], ["ids", "labels", "x", "codes", "rows", "keys", "runs", "moved", "compared"])

        ids, labels, parts = [], [], []
        for b in batches:
            x = np.asarray(b.column(2).flatten(), float).reshape(-1, dim)
            for lo in range(0, b.num_rows, BLOCK_ROWS):
                ids += b.column(0).slice(lo, BLOCK_ROWS).to_pylist()
                labels += b.column(1).slice(lo, BLOCK_ROWS).to_pylist()
                parts.append(x[lo: lo + BLOCK_ROWS])
                if len(ids) >= BLOCK_ROWS:
                    yield block(ids, labels, np.concatenate(parts))
                    ids, labels, parts = [], [], []
        if ids:
            yield block(ids, labels, np.concatenate(parts))

    return rows.mapInArrow(run, STATE)


def _pass(blocks: DataFrame, dim: int, books, drift: np.ndarray, wide: bool, digits: int) -> DataFrame:
    """The blocks after every part has the nearest entry of ``books``; ``moved`` holds what entries gained, sums and counts."""
    entries, width = len(books[0]), dim // PARTS

    def run(batches):
        import pyarrow as pa

        tables = [np.array(b, object if wide else float).reshape(entries, width) for b in books]
        for batch in batches:
            for i in range(batch.num_rows):
                held = {name: batch.column(name)[i] for name in batch.schema.names}
                ids = held["ids"].as_py()
                n = len(ids)
                x = whole_numbers(np.frombuffer(held["x"].as_py()).reshape(n, dim), wide)
                raw = held["codes"].as_py()
                codes = np.frombuffer(raw, np.uint8).reshape(PARTS, n) if raw else None
                rows, keys, runs = np.frombuffer(held["rows"].as_py(), np.int32), np.frombuffer(held["keys"].as_py()), held["runs"].as_py()
                at, heaps = 0, [[[] for _ in range(entries)] for _ in range(PARTS)]
                for p, e, size in zip(runs[0::3], runs[1::3], runs[2::3]):
                    heaps[p][e].append((keys[at: at + size], rows[at: at + size]))
                    at += size
                out_codes, out_rows, out_keys, out_runs, moved, compared = [], [], [], [], [], 0
                for p in range(PARTS):
                    own = x[:, p * width:(p + 1) * width]
                    hs = [Heap(h) for h in heaps[p]]
                    new, looked = assign(own, None if codes is None else codes[p], hs, tables[p], drift[p])
                    compared += len(looked)
                    sums, counts = np.zeros((entries, width), object), np.zeros(entries, np.int64)
                    was = None if codes is None else codes[p][looked]
                    for e in range(entries):
                        come = looked[(new[looked] == e) & (True if was is None else was != e)]
                        gone = looked[(was == e) & (new[looked] != e)] if was is not None else looked[:0]
                        counts[e] = len(come) - len(gone)
                        sums[e] = [int(v) for v in own[come].sum(0).tolist()] if len(come) else 0
                        if len(gone):
                            sums[e] = [a - int(v) for a, v in zip(sums[e], own[gone].sum(0).tolist())]
                    moved += [d for row in sums.tolist() for v in row for d in limbs(int(v), digits)] + counts.tolist()
                    out_codes.append(new)
                    for e, h in enumerate(hs):
                        for _, _, k, r in sorted(h.runs, key=lambda run: run[1]):
                            out_keys.append(k)
                            out_rows.append(r)
                            out_runs += [p, e, len(k)]
                yield pa.RecordBatch.from_arrays([
                    batch.column("ids").slice(i, 1), batch.column("labels").slice(i, 1), batch.column("x").slice(i, 1), pa.array([np.concatenate(out_codes).tobytes()], pa.binary()),
                    pa.array([np.concatenate(out_rows).astype(np.int32).tobytes()], pa.binary()), pa.array([np.concatenate(out_keys).astype(float).tobytes()], pa.binary()), pa.array([out_runs], pa.list_(pa.int32())),
                    pa.array([moved], pa.list_(pa.int64())), pa.array([compared], pa.int64())], list(held))

    return blocks.mapInArrow(run, STATE)


def _coded(blocks: DataFrame, dim: int, books, wide: bool) -> DataFrame:
    """(vec_id, label, code, error) of the vectors in blocks; an error beyond a long is null."""
    entries, width = len(books[0]), dim // PARTS

    def run(batches):
        import pyarrow as pa

        tables = np.array(books, object if wide else float).reshape(PARTS, entries, width)
        for b in batches:
            for i in range(b.num_rows):
                ids, labels = b.column(0)[i].values, b.column(1)[i].values
                codes = np.frombuffer(b.column(3)[i].as_py(), np.uint8).reshape(PARTS, len(ids))
                x = whole_numbers(np.frombuffer(b.column(2)[i].as_py()).reshape(len(ids), dim), wide)
                left = x - np.concatenate([tables[p][codes[p]] for p in range(PARTS)], 1)
                errors = [v if v < 2**63 else None for v in map(int, (left * left).sum(1).tolist())]
                hexed = [row.tobytes().hex() for row in np.ascontiguousarray(codes.T)]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(hexed, pa.string()), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    return blocks.select("ids", "labels", "x", "codes").mapInArrow(run, "vec_id long, label string, code string, error long")


def compress(rows: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list, list[int]]:
    """((vec_id, label, code, error), codebooks, parts compared in each pass); the label comes as text.

    Rows whose vector is null, empty or holds null or non-finite components take
    no part. Vectors have the dimension of the one with the smallest id, which
    must be a multiple of ``PARTS``; rows of another take no part either. Null
    ids come last, rows with equal ids in the order of their vectors, repeated
    rows each on its own. Fewer rows than entries make smaller codebooks. An
    empty table gives no rows.
    """
    spark = rows.sparkSession
    v = F.col("v")
    kept = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    kept = kept.where(v.isNotNull() & (F.size(v) > 0) & (F.size(v) % PARTS == 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    order = [F.col("vec_id").asc_nulls_last(), "v"]
    head = kept.orderBy(*order).first()
    if head is None:
        return spark.createDataFrame([], "vec_id long, label string, code string, error long"), [], []
    dim = len(head["v"])
    kept = kept.where(F.size(v) == dim)
    first = [r["v"] for r in kept.orderBy(*order).limit(entries).collect()]
    n, most = kept.agg(F.count("*"), F.max(F.array_max(F.transform(v, F.abs)))).first()
    width = dim // PARTS
    wide = width * (2 * (most * SCALE + 1)) ** 2 * BLOCK_ROWS >= EXACT
    digits = -(-(int(math.log2(most * SCALE + 1)) + 2 + n.bit_length() + 1) // LIMB)
    ints = [[int(x) for x in row] for row in whole_numbers(np.array(first), wide).tolist()]
    books = [[row[p * width:(p + 1) * width] for row in ints] for p in range(PARTS)]
    k = len(ints)
    sums, counts = [[[0] * width for _ in range(k)] for _ in range(PARTS)], [[0] * k for _ in range(PARTS)]
    drift, compared = np.zeros((PARTS, k)), []
    blocks = written(_blocks(kept, dim), "blocks")
    span = k * width * digits + k
    for r in range(rounds + 1):
        before, blocks = blocks, written(_pass(blocks, dim, books, drift, wide, digits), "blocks")
        drop(before)
        gained = {x["at"]: x["n"] for x in blocks.select(F.posexplode("moved").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect()}  # as many as there are components of entries
        compared.append(blocks.agg(F.sum("compared")).first()[0])
        if r == rounds:
            break
        for p in range(PARTS):
            for e in range(k):
                for c in range(width):
                    at = p * span + (e * width + c) * digits
                    sums[p][e][c] += from_limbs(gained[at + d] for d in range(digits))
                counts[p][e] += gained[p * span + k * width * digits + e]
        books, step = moved_on(books, sums, counts)
        drift = drift + step
    return _coded(blocks, dim, books, wide), books, compared


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error: its errors summed over equal labels, nulls together; null where a sum is beyond a long."""
    named = coded.select("*", F.coalesce(F.concat(F.lit("="), "label"), F.lit("")).alias("name"))
    sums = written(named.groupBy("name").agg(F.try_sum("error").alias("label_error")), "labels")
    return join_unevenly(named, sums, "name", named.count()).drop("name")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books, _ = compress(read_table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    coded = with_label_errors(written(coded, "codes"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql(rounds: int = ROUNDS) -> str:
    """The same rounds in SQL, each with all parts compared with all entries."""
    out = f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT r, p, v[p * len(v) // {PARTS} + 1:(p + 1) * len(v) // {PARTS}] AS v FROM kept, range({PARTS}) t(p)),
c0 AS MATERIALIZED (SELECT p, r - 1 AS e, v FROM parts WHERE r <= {ENTRIES})"""
    nearest = "(SELECT r, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT parts.r, parts.p, c.e, list_sum(list_transform(list_zip(parts.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts JOIN c{i} c ON parts.p = c.p) GROUP BY r, p)"
    for i in range(rounds):
        out += f""",
a{i} AS MATERIALIZED {nearest.format(i=i)},
s{i} AS MATERIALIZED (SELECT p, e, list(m ORDER BY i) AS v FROM (SELECT parts.p, a.e, i, (sum(v[i])::HUGEINT - (sum(v[i])::HUGEINT % count(*) + count(*)) % count(*)) // count(*) AS m FROM parts JOIN a{i} a ON parts.r = a.r AND parts.p = a.p, (SELECT unnest(range(1, (SELECT max(len(v)) FROM parts) + 1)) AS i) GROUP BY 1, 2, 3) GROUP BY 1, 2),
c{i + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(s.v::BIGINT[], c.v) AS v FROM c{i} c LEFT JOIN s{i} s ON c.p = s.p AND c.e = s.e)"""
    return out + f""",
z AS MATERIALIZED {nearest.format(i=rounds)},
w AS MATERIALIZED (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM z JOIN kept ON z.r = kept.r GROUP BY z.r, vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM c{rounds}) AS codebooks_sha256 FROM w"""


ORACLE_SQL = _sql()
