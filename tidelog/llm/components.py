"""Connected components by alternating large-star and small-star steps, each a shuffle; nothing goes to the driver but two sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import drop, stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).union(moved).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge that isn't itself a root; root is the smallest node that it reaches.

    edges has two columns of long; loops and repeats are ignored, no edges give no rows.
    """
    a, b = (F.col(c) for c in edges.columns[:2])
    now, path = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "edges")
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.hash("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == mark or not seen["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen
        after, old = stored(_small_star(_large_star(now)), "edges"), path
        now, path = after
        drop(edges.sparkSession, old)
