"""Connected groups of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def connected(links: DataFrame, a: str = "a_id", b: str = "b_id") -> DataFrame:
    """(node, family) of every node that has a link; family is the smallest node
    reachable.

    Star contraction: in turn every node hangs its larger neighbours, then its
    smaller ones, on the smallest of them, until the links form stars around
    smallest nodes.  Rounds grow with the logarithm of the longest path; a
    node of very many links is a minimum combined map-side and a join with a
    unique right side, which adaptive execution splits.
    """
    one = links.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y")
    edges = materialize(one.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())
    seen = None
    while True:
        # larger neighbours hang on the smallest of a node and its neighbours
        both = edges.union(edges.select("y", "x")).toDF("x", "y")
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        edges = both.filter("y > x").join(low, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).filter("x <> y").distinct()
        # so do the node and its smaller neighbours
        low = edges.groupBy("x").agg(F.min("y").alias("m"))
        edges = (edges.join(low, "x").select(F.col("y").alias("x"), F.col("m").alias("y"))
                 .union(low.select("x", F.col("m").alias("y"))).filter("x <> y").distinct())
        edges = materialize(edges)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("x").alias("node"), F.col("y").alias("family")).union(
        edges.select("y", "y").distinct())
