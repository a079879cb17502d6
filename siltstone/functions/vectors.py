"""Vector arithmetic on array columns, in double precision, folded left to right."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product; vectors of different length give 0."""
    total = F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total).otherwise(F.lit(0.0))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """Unit length; a zero or non-finite norm leaves the vector as it is."""
    n = norm(a)
    usable = (n > 0) & ~F.isnan(n) & (n < float("inf"))
    return F.when(usable, F.transform(doubles(a), lambda x: x / n)).otherwise(doubles(a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; empty, zero or mismatched vectors give 0."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(F.lit(0.0))


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Ascending distance: cosine ``1 - cos``, l2 squared, ip ``1 - dot``."""
    if metric == "cosine":
        return 1 - cosine(a, b)
    if metric == "l2":
        return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    if metric == "ip":
        return 1 - dot(a, b)
    raise ValueError(metric)


def similarity(d: Column, metric: str = "cosine") -> Column:
    """Similarity in [0, 1]; only cosine distances have one."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - d)) if metric == "cosine" else F.lit(None).cast("double")


def rendered(d: Column, metric: str = "cosine") -> Column:
    """A distance as people read it."""
    if metric == "cosine":
        return F.format_string("%d%% · d=%.4f", F.round(similarity(d) * 100).cast("int"), d)
    return F.format_string(f"{metric} %.4f", d)


def mean(vectors: Column, dim: int) -> Column:
    """Componentwise mean of an array of vectors."""
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(vectors, F.lit(0.0), lambda s, v: s + v[i].cast("double")) / F.size(vectors))


def usable(v: Column, dim: int) -> Column:
    """Right dimension, finite and not zero."""
    n = norm(v)
    return v.isNotNull() & (F.size(v) == dim) & (n > 0) & ~F.isnan(n) & (n < float("inf"))
