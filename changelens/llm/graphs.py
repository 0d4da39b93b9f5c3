"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang every neighbour of a node (the larger, or the smaller ones and the
    node itself) on the smallest of the node and its neighbours."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has a link; component is the
    smallest node reachable.

    Alternating large and small stars: the links of a round hang on local
    minima, so the number of rounds grows with the logarithm of the graph, and
    a node of many links is a sum combined map-side and a join that adaptive
    execution splits, never one task's list.
    """
    edges = save(links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        edges = save(_star(_star(edges, True), False))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now
