"""Maximal marginal relevance: a greedy choice per query, so it runs over each query's pool in one place."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_LAMBDA = 0.7


def choose(relevance: np.ndarray, vectors: np.ndarray, n: int, weight: float = DEFAULT_LAMBDA) -> list[int]:
    """Indices in order of choice; ties go to the earlier candidate."""
    weight = min(max(weight, 0.0), 1.0)
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, size, out=vectors.astype(float).copy(), where=size > 0)
    left, chosen = list(range(len(relevance))), []
    most = np.zeros(len(relevance))
    while left and len(chosen) < n:
        score = weight * relevance[left] - (1 - weight) * most[left]
        best = left[int(np.argmax(score))]
        left.remove(best)
        near = unit @ unit[best]
        most = near if not chosen else np.maximum(most, near)
        chosen.append(best)
    return chosen


def diversify(hits: DataFrame, n: int, weight: float = DEFAULT_LAMBDA) -> DataFrame:
    """``n`` diverse hits of each query (query_id, id, position, relevance, embedding): query_id, id, position.

    Hits with a vector that are not chosen are dropped; hits without one return
    to their relative place. A null relevance counts as ``1 - rank / total``.
    A pool is bounded by the candidate stage.
    """

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("position").reset_index(drop=True)
        has = pdf["embedding"].map(lambda v: v is not None and len(v) > 0).to_numpy(bool)
        if has.sum() < 2:
            out = pdf[["query_id", "id"]].head(n).copy()
        else:
            total = len(pdf)
            rel = pdf["relevance"].astype(float).to_numpy()
            rel = np.where(np.isnan(rel), 1 - np.arange(total) / total, rel)
            at = np.flatnonzero(has)
            picked = [int(at[i]) for i in choose(rel[at], np.stack([np.asarray(v, float) for v in pdf["embedding"][at]]), n, weight)]
            order = picked[:]
            for i in np.flatnonzero(~has):
                order.insert(min(int(i), len(order)), int(i))
            out = pdf.loc[order[:n], ["query_id", "id"]].copy()
        out["position"] = np.arange(1, len(out) + 1)
        return pd.DataFrame(out)

    slim = hits.select("query_id", "id", "position", F.col("relevance").cast("double").alias("relevance"), F.col("embedding").cast("array<double>").alias("embedding"))
    return slim.groupBy("query_id").applyInPandas(run, "query_id long, id long, position int")
