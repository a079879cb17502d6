"""Spherical k-means by cosine distance: seeding, fitting, silhouette, outliers, topics.

The fit runs over the whole table: each round one pass in which tasks sum
vectors by nearest centroid; only centroids and sums, whose size does not grow
with the data, reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as X
from . import ordered
from .inspection import upper_median

ROUNDS = 60
SILHOUETTE_SAMPLE = 600
SEED_SAMPLE = 10_000
BLOCK_ROWS = 1024  # vectors compared with the centroids at once


def default_k(n: int) -> int:
    return min(24, max(4, math.floor(math.sqrt(n) / 3 + 0.5)))


def unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def seeds(sample: np.ndarray, k: int, seed: int = 42) -> np.ndarray:
    """k-means++ on unit vectors, with squared cosine distances as weights."""
    rng, out = np.random.default_rng(seed), []
    out.append(sample[rng.integers(len(sample))])
    nearest = 1 - sample @ out[0]
    while len(out) < k:
        weight = np.maximum(nearest, 0) ** 2
        at = rng.choice(len(sample), p=weight / weight.sum()) if weight.sum() > 0 else rng.integers(len(sample))
        out.append(sample[at])
        nearest = np.minimum(nearest, 1 - sample @ out[-1])
    return np.array(out)


def strided(df: DataFrame, most: int, id_col: str = "id") -> DataFrame:
    """About ``most`` rows spread over the table by a hash of the id: the same rows on every run."""
    n = df.count()
    return df.where(F.pmod(F.xxhash64(id_col), F.lit(max(1, n // most))) == 0).orderBy(F.xxhash64(id_col), id_col).limit(most)


def assign(df: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance): the nearest centroid by cosine distance, the first of several."""
    sent = df.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                x = unit(np.asarray(b.column(1).flatten(), float).reshape(b.num_rows, -1))
                d = 1 - x @ sent.value.T
                c = d.argmin(1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c.astype(np.int32)), pa.array(d[np.arange(len(c)), c])], ["id", "cluster", "distance"])

    return df.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "id long, cluster int, distance double")


def _blocks(rows: DataFrame) -> DataFrame:
    """(block): the unit vectors of ``rows`` (id, embedding of doubles) as bytes, a batch a row, written once and read by every round."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                x = unit(np.asarray(b.column(0).flatten(), float).reshape(b.num_rows, -1))
                yield pa.RecordBatch.from_arrays([pa.array([x[at: at + BLOCK_ROWS].tobytes() for at in range(0, len(x), BLOCK_ROWS)], pa.binary())], ["block"])

    ordered.with_checkpoints(rows.sparkSession)
    return rows.select("embedding").mapInArrow(run, "block binary").checkpoint()


def fit(df: DataFrame, k: int | None = None, dim: int | None = None, seed: int = 42, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of the usable vectors of ``df`` (id, embedding)."""
    dim = dim or df.where("embedding is not null").select(F.size("embedding")).first()[0]
    rows = df.where(X.usable(F.col("embedding"), dim)).select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    blocks = _blocks(rows)
    sample = unit(np.array([r[0] for r in strided(rows, SEED_SAMPLE).select("embedding").collect()], float))
    k = min(k or default_k(rows.count()), len(sample))
    centroids = seeds(sample, k, seed)

    for _ in range(rounds):
        sent = df.sparkSession.sparkContext.broadcast(centroids)

        def run(batches, sent=sent):
            import pyarrow as pa

            total, n, far = np.zeros_like(sent.value), np.zeros(k, np.int64), (-1.0, np.zeros(dim))
            for b in batches:
                for block in b.column(0):
                    x = np.frombuffer(block.as_buffer()).reshape(-1, dim)
                    d = 1 - x @ sent.value.T
                    c = d.argmin(1)
                    total += (np.arange(k)[:, None] == c).astype(float) @ x
                    n += np.bincount(c, minlength=k)
                    least = d.min(1)
                    if least.max() > far[0]:
                        far = float(least.max()), x[least.argmax()]
            yield pa.RecordBatch.from_arrays([pa.array([*range(k), -1], pa.int32()), pa.array([*n.tolist(), 0]), pa.array([*total.tolist(), far[1].tolist()]), pa.array([0.0] * k + [far[0]])], ["cluster", "n", "total", "far"])

        parts = blocks.mapInArrow(run, "cluster int, n long, total array<double>, far double")
        found = parts.collect()  # k + 1 rows a task
        new, sums, members = centroids.copy(), np.zeros_like(centroids), np.zeros(k, np.int64)
        for r in found:
            if r["cluster"] >= 0:
                sums[r["cluster"]] += r["total"]
                members[r["cluster"]] += r["n"]
        new[members > 0] = sums[members > 0]
        empty = np.flatnonzero(members == 0)
        if len(empty):  # the farthest vector starts an empty cluster anew
            new[empty[0]] = max((r for r in found if r["cluster"] < 0), key=lambda r: r["far"])["total"]
        new = unit(new)
        moved = np.abs(new - centroids).max()
        centroids = new
        if moved < 1e-9:
            break
    return centroids


def outlier_threshold(assigned: DataFrame) -> DataFrame:
    """(cluster, median, threshold): upper median of distances plus twice the upper median deviation; none where that is 0."""
    mid = upper_median(assigned, "distance", ["cluster"])
    dev = assigned.join(mid, "cluster").withColumn("deviation", F.abs(F.col("distance") - F.col("median")))
    mad = upper_median(dev, "deviation", ["cluster"]).withColumnRenamed("median", "mad")
    return mid.join(mad, "cluster").select("cluster", "median", F.when(F.col("mad") > 0, F.col("median") + 2 * F.col("mad")).alias("threshold"))


def topics(df: DataFrame, centroids: np.ndarray, examples: int = 3) -> DataFrame:
    """(cluster, size, share, avg_distance, outliers, examples) of the assigned rows; outliers belong to no topic."""
    # assigned once: thresholds and topics read one exchange
    assigned = assign(df, centroids).repartition("id")
    found = assigned.join(outlier_threshold(assigned), "cluster")
    inside = F.col("threshold").isNull() | (F.col("distance") <= F.col("threshold"))
    place = F.row_number().over(W.partitionBy("cluster").orderBy(F.round("distance", 12), "id"))
    near = found.where(inside).withColumn("_n", place).where(F.col("_n") <= examples).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("_n", "id"))).alias("_e"))
    sizes = found.groupBy("cluster").agg(F.count_if(inside).alias("size"), F.avg(F.when(inside, F.col("distance"))).alias("avg_distance"), F.count_if(~inside).alias("outliers"))
    total = sizes.agg(F.sum(F.col("size") + F.col("outliers")).alias("_all"))
    return sizes.join(near, "cluster", "left").crossJoin(F.broadcast(total)).select("cluster", "size", (F.col("size") / F.col("_all")).alias("share"), "avg_distance", "outliers", F.transform("_e", lambda x: x["id"]).alias("examples"))


def silhouette(df: DataFrame, assigned: DataFrame, most: int = SILHOUETTE_SAMPLE) -> float:
    """Mean silhouette of a bounded sample: own cluster's mean distance against the best other's."""
    sample = strided(df.join(assigned.select("id", "cluster"), "id"), most).collect()
    if len(sample) < 2:
        return 0.0
    x = unit(np.array([r["embedding"] for r in sample], float))
    c = np.array([r["cluster"] for r in sample])
    d = np.maximum(1 - x @ x.T, 0)
    out = []
    for i in range(len(c)):
        own = (c == c[i]) & (np.arange(len(c)) != i)
        other = [d[i, c == o].mean() for o in np.unique(c) if o != c[i]]
        if own.any() and other:
            a, b = d[i, own].mean(), min(other)
            out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(out)) if out else 0.0


def suggest_k(df: DataFrame, dim: int, seed: int = 42) -> int:
    """Of 2, 3 and the default the k whose silhouette is best; a coarse one only if it is clearly better."""
    fine = default_k(df.count())
    score = {k: silhouette(df, assign(df, fit(df, k, dim, seed))) for k in sorted({2, 3, fine})}
    coarse = max((k for k in score if k < 4), key=lambda k: score[k])
    return coarse if score[coarse] > 1.25 * score[fine] else fine
