"""Maximum-inner-product search over score-aware quantised vectors.

Each vector is coded with four bits for every pair of dimensions. Codebooks and
codes minimise the anisotropic loss |r|^2 + (eta - 1) <r, x/|x|>^2 of the
residual r, so that error parallel to the vector, which shifts high inner
products most, costs eta times as much. A query scans tables of partial
products, two codes to a byte, and scores rows again in double precision on
the original vectors: first the best of every block, then each row whose
approximate score, plus the most that its residual can add, reaches the k-th
best score so found. What is returned is therefore exact.

The codebooks are fitted on a bounded sample (``TRAIN_ROWS``, those with the
smallest hashes of the whole table, so always the same); every row is indexed
and scanned. Vectors of different dimensions have no inner product: each
dimension has its own codebooks, and a query searches among its own.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import read_table, written

TRAIN_ROWS = 20_000  # bound of the sample that a dimension's codebooks are fitted on
CENTERS = 16  # four bits
THRESHOLD = 0.2  # cosine from which a score counts as high; sets eta
BLOCK_ROWS = 16_384  # rows scanned at once
RERANK = 256  # rows of a block that are scored first, for a score to beat
QUERY_BLOCK = 4096  # queries held by the driver and broadcast at once, about
K = 20


def eta(dim: int, threshold: float = THRESHOLD) -> float:
    """Weight of the parallel residual error."""
    return max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))


def _padded(x: np.ndarray) -> np.ndarray:
    """Dimensions filled up with zeros to whole bytes of two codes (four dimensions)."""
    return np.pad(x, ((0, 0), (0, -x.shape[1] % 4)))


def assign(x: np.ndarray, books: np.ndarray, sweeps: int = 3) -> np.ndarray:
    """Codes of the rows of ``x`` by coordinate descent on the anisotropic loss."""
    n, m = len(x), len(books)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    extra = eta(x.shape[1]) - 1
    codes = np.zeros((n, m), np.int64)
    parallel = np.zeros((n, m))
    for sweep in range(sweeps):
        for s in range(m):
            own, u = x[:, 2 * s:2 * s + 2], unit[:, 2 * s:2 * s + 2]
            rest = parallel.sum(1) - parallel[:, s] if sweep else np.zeros(n)
            r = own[:, None, :] - books[s][None]
            along = (r * u[:, None, :]).sum(2)
            loss = (r * r).sum(2) + extra * (rest[:, None] + along) ** 2
            codes[:, s] = loss.argmin(1)
            parallel[:, s] = along[np.arange(n), codes[:, s]]
    return codes


def fit(x: np.ndarray, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Codebooks (pairs of dimensions, 16, 2) for the rows of ``x``."""
    x = _padded(np.asarray(x, float))
    m, rng = x.shape[1] // 2, np.random.default_rng(seed)
    if not len(x):
        return np.zeros((m, CENTERS, 2))
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    extra = eta(x.shape[1]) - 1
    books = np.stack([x[rng.integers(0, len(x), CENTERS)][:, 2 * s:2 * s + 2] for s in range(m)])
    for _ in range(rounds):
        codes = assign(x, books, 2)
        r = x - books[np.arange(m), codes].reshape(len(x), -1)
        parallel = (r * unit).reshape(len(x), m, 2).sum(2)
        total = parallel.sum(1)
        for s in range(m):  # each centre: the minimum of a quadratic in two unknowns
            own, u, rest = x[:, 2 * s:2 * s + 2], unit[:, 2 * s:2 * s + 2], total - parallel[:, s]
            for c in range(CENTERS):
                of = codes[:, s] == c
                if of.any():
                    uu = u[of]
                    a = of.sum() * np.eye(2) + extra * uu.T @ uu
                    b = own[of].sum(0) + extra * (uu * (rest[of] + (own[of] * uu).sum(1))[:, None]).sum(0)
                    books[s, c] = np.linalg.solve(a, b)
            now = ((own - books[s][codes[:, s]]) * u).sum(1)
            total += now - parallel[:, s]
            parallel[:, s] = now
    return books


def pack(codes: np.ndarray) -> np.ndarray:
    return (codes[:, 0::2] | codes[:, 1::2] << 4).astype(np.uint8)


def tables(queries: np.ndarray, books: np.ndarray) -> np.ndarray:
    """(queries, bytes of a code, 256) partial products."""
    q = _padded(queries).reshape(len(queries), len(books), 2)
    t = np.einsum("qsd,scd->qsc", q, books)
    return (t[:, 1::2, :, None] + t[:, 0::2, None, :]).reshape(len(q), -1, 256).astype(np.float32)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of one query, one row an id, ties to the smaller id."""
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    _, first = np.unique(ids, return_index=True)
    first.sort()
    return ids[first[:k]], scores[first[:k]]


def residual_norms(vectors: np.ndarray, books: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Lengths of what packed codes leave of their vectors."""
    apart = np.stack([codes & 15, codes >> 4], 2).reshape(len(codes), -1)
    return np.linalg.norm(_padded(vectors) - books[np.arange(len(books)), apart].reshape(len(codes), -1), axis=1)


def scan(query_ids, queries, books, ids, vectors, codes, k=K, rerank=RERANK):
    """Per query the ids and exact scores of its k nearest in one block of rows."""
    found = []
    # a score is the table's sum and the residual's product, at most that of the lengths; the last terms cover rounding
    left = residual_norms(vectors, books, codes)
    size = np.linalg.norm(vectors, axis=1) + left
    for lo in range(0, len(query_ids), 128):
        q = queries[lo:lo + 128]
        t = tables(q, books)
        near = np.zeros((len(q), len(ids)), np.float32)
        for b in range(codes.shape[1]):
            near += t[:, b].take(codes[:, b], axis=1)
        near[query_ids[lo:lo + 128, None] == ids[None]] = -np.inf
        slack = np.abs(t).max(2).sum(1) * codes.shape[1] * 2.0**-22
        r = min(rerank, len(ids))
        rows = np.argpartition(-near, r - 1, axis=1)[:, :r]

        def exact(i, own):
            return (vectors[own] * q[i]).sum(1)  # row by row, so that equal vectors tie

        for i in range(len(q)):
            own = rows[i][ids[rows[i]] != query_ids[lo + i]]
            best = _best(ids[own], exact(i, own), k)
            length = np.linalg.norm(q[i])
            least = best[1][-1] if len(best[1]) == k else -np.inf
            may = (near[i] + length * (left + 1e-12 * size) + slack[i] >= least) & (ids != query_ids[lo + i])
            may[own] = False
            more = np.flatnonzero(may)
            if len(more):
                best = _best(np.concatenate([best[0], ids[more]]), np.concatenate([best[1], exact(i, more)]), k)
            found.append(best)
    return found


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, embedding as doubles) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    return (
        df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("embedding"))
        .where("vec_id is not null and embedding is not null")
        .where(~F.exists("embedding", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))
        .where(F.exists("embedding", lambda e: e != 0))
    )


def build_index(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, dict[int, np.ndarray]]:
    """The coded table (vec_id, dim, embedding, code), written to shared storage, and each dimension's codebooks."""
    rows = usable(df, id_col, vector_col).withColumn("dim", F.size("embedding"))
    counts = {r["dim"]: r["count"] for r in rows.groupBy("dim").count().collect()}  # a row a dimension
    books = {}
    for dim, n in sorted(counts.items()):
        # about twice as many as are needed, of which the first in the order of another hash are taken
        near = rows.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("embedding", "vec_id"), F.lit(max(1, n // (2 * TRAIN_ROWS)))) == 0))
        sample = near.orderBy(F.xxhash64("vec_id", "embedding"), "vec_id").limit(TRAIN_ROWS).select("embedding").toArrow().column(0).combine_chunks()
        books[dim] = fit(np.asarray(sample.flatten()).reshape(-1, dim))
    sent = df.sparkSession.sparkContext.broadcast(books)

    def encode(batches):
        import pyarrow as pa

        for b in batches:
            dims = np.asarray(b.column(1))
            for dim in np.unique(dims).tolist():
                own = b.filter(pa.array(dims == dim))
                for lo in range(0, own.num_rows, 2048):
                    part = own.slice(lo, 2048)
                    code = pack(assign(_padded(np.asarray(part.column(2).flatten()).reshape(-1, dim)), sent.value[dim]))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array([c.tobytes() for c in code], pa.binary())], ["vec_id", "dim", "embedding", "code"])

    return written(rows.select("vec_id", "dim", "embedding").mapInArrow(encode, "vec_id long, dim int, embedding array<double>, code binary"), "ann"), books


def _search_block(index: DataFrame, books: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, score): the ``k`` best that each task has for one block of queries, written."""
    sent = index.sparkSession.sparkContext.broadcast((query_ids, vectors, books))

    def run(batches):
        import pyarrow as pa

        query_ids, vectors, books = sent.value
        best = [(np.zeros(0, np.int64), np.zeros(0))] * len(query_ids)

        def take(part):
            nonlocal best
            ids = np.concatenate([np.asarray(b.column(0)) for b in part])
            x = np.concatenate([np.asarray(b.column(1).flatten()) for b in part]).reshape(len(ids), -1)
            codes = np.frombuffer(b"".join(c for b in part for c in b.column(2).to_pylist()), np.uint8).reshape(len(ids), -1)
            for lo in range(0, len(ids), BLOCK_ROWS):
                hi = lo + BLOCK_ROWS
                found = scan(query_ids, vectors, books, ids[lo:hi], x[lo:hi], codes[lo:hi], k)
                best = [_best(np.concatenate([a[0], f[0]]), np.concatenate([a[1], f[1]]), k) for a, f in zip(best, found)]

        part, n = [], 0
        for b in batches:
            if b.num_rows:
                part.append(b)
                n += b.num_rows
            if n >= BLOCK_ROWS:
                take(part)
                part, n = [], 0
        if part:
            take(part)
        ids = [a[0] for a in best]
        if sum(map(len, ids)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(query_ids, [len(i) for i in ids])), pa.array(np.concatenate(ids)), pa.array(np.concatenate([a[1] for a in best]))],
                ["query_id", "vec_id", "score"])

    out = written(index.select("vec_id", "embedding", "code").mapInArrow(run, "query_id long, vec_id long, score double"), "hits")
    sent.destroy()
    return out


def search(index: DataFrame, books: dict[int, np.ndarray], queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products of every query.

    ``queries`` has columns vec_id and embedding. A row never finds its own id;
    an id that several rows share is returned once, with its best score. Ties
    go to the smaller id; a query with fewer candidates of its dimension gets
    all. Queries are taken in blocks of about ``QUERY_BLOCK``, one after the
    other, each scanned against all rows; a task returns at most ``k`` rows a
    query. Dimensions that the index lacks find nothing.
    """
    asked = queries.select("vec_id", "embedding", F.size("embedding").alias("dim"))
    counts = {r["dim"]: r["count"] for r in asked.groupBy("dim").count().collect() if r["dim"] in books}
    blocks = {dim: -(-n // QUERY_BLOCK) for dim, n in counts.items()}
    number = F.lit(0)
    for dim, n in blocks.items():
        number = F.when(F.col("dim") == dim, F.pmod(F.xxhash64("vec_id"), F.lit(n))).otherwise(number)
    # a file a block, so that each is read alone
    asked = written(asked.withColumn("block", number.cast("long")).repartitionByRange(max(1, sum(blocks.values())), "dim", "block"), "queries")
    parts = [asked.select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0.0).alias("score")).limit(0)]
    for dim, n in sorted(blocks.items()):
        for block in range(n):
            held = asked.where((F.col("dim") == dim) & (F.col("block") == block)).select("vec_id", "embedding").toArrow()
            vectors = np.asarray(held.column(1).combine_chunks().flatten()).reshape(-1, dim)
            parts.append(_search_block(index.where(F.col("dim") == dim), books[dim], held.column(0).to_numpy(), vectors, k))
    merged = reduce(DataFrame.unionByName, parts).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    by_query = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, books = build_index(read_table(spark, sf_dir, "embeddings"))
    # a repeated query row asks once
    queries = index.where("vec_id % 20 = 0").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return search(index, books, queries)
