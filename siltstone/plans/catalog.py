"""Registered queries over the driver's tables and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import q_analytics, q_filters, q_more, q_retrieval, q_text

_MODULES = (q_filters, q_retrieval, q_analytics, q_text, q_more)
QUERIES: dict = {k: f for m in _MODULES for k, f in m.Q.items()}
ORACLE_SQL: dict = {k: q for m in _MODULES for k, q in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search, vectors and text fused, over the whole collection."""
    return q_retrieval.hybrid(spark, sf_dir)
