"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, scratch


def connected(edges: DataFrame) -> DataFrame:
    """(node, component): for every node of the edges (a, b), two longs, the least node that it reaches.

    Each round is some shuffles of at most twice the edges; their number grows
    with the logarithm of the longest path. Nothing is gathered on the driver;
    it ends when no node has two lesser neighbours or a lesser and a greater one.
    """
    now = scratch(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = scratch(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        drop(now, least)
        least = scratch(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = scratch(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop(large, least)
        ends = now.select(F.col("u").alias("node"), "v").union(now.select("v", F.lit(None).cast("long")))
        odd = ends.groupBy("node").agg(F.min("v").alias("a"), F.max("v").alias("b"), F.max(F.col("v").isNull()).alias("root")).where("a <> b or (root and a is not null)")
        if odd.isEmpty():
            break
    out = scratch(now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct()), "components")
    drop(now)
    return out
