"""Connected components of an edge table that no machine has to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long): the smallest node it can reach.

    Each round hangs every component under its smallest neighbour, follows
    these pointers to their ends, and joins what became one. Hubs cost no more
    than others: neighbours are only ever minimised, never gathered.
    """
    edges = written(edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    label = written(nodes.select("node", F.col("node").alias("component")), "labels")
    while not edges.isEmpty():
        # in (a, b) b is smaller: components that are no local minimum get a parent
        parent = written(edges.groupBy("a").agg(F.min("b").alias("parent")), "parents")
        while True:
            up = parent.select(F.col("a").alias("parent"), F.col("parent").alias("top"))
            jumped = parent.join(up, "parent", "left").select("a", F.coalesce("top", "parent").alias("parent"), F.col("top").isNotNull().alias("moved"))
            jumped = written(jumped, "parents")
            parent = jumped.select("a", "parent")
            if jumped.where("moved").isEmpty():
                break
        to = parent.select(F.col("a").alias("component"), "parent")
        label = written(label.join(to, "component", "left").select("node", F.coalesce("parent", "component").alias("component")), "labels")
        a = edges.join(parent.select("a", F.col("parent").alias("pa")), "a", "left").select(F.coalesce("pa", "a").alias("a"), "b")
        ends = parent.select(F.col("a").alias("b"), F.col("parent").alias("pb"))
        both = a.join(ends, "b", "left").select("a", F.coalesce("pb", "b").alias("b")).where("a != b")
        edges = written(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    return label
