"""Connected components of a graph that is held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize


def _settled(edges: DataFrame) -> bool:
    """Whether every edge leads from a node to the least node of its component."""
    ends = edges.select("u", F.lit(0).alias("inner")).union(edges.select("v", F.lit(1)).distinct())
    return ends.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every end of an edge ``a, b``; the component is its smallest node.

    Alternates two steps until nothing changes: every node hands its larger
    neighbours to its smallest one, then its smaller neighbours too. The least
    node of each neighbourhood is written out first, so that both sides of each
    join are plain shuffles and a node with very many neighbours is split.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(e, "cc-edges")
    while not _settled(e):
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select("v", "u"))
        least = materialize(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")), "cc-least")
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "cc-large")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).distinct()
        e = materialize(small, "cc-edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
