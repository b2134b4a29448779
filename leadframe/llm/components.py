"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadframe.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """links: rows (a, b) -> rows (id, comp), comp the smallest id reachable; one row per id.

    Each step is a minimum per node (combined map-side, so a node with a third
    of all links sends one row per task) and a join, written to the shared
    folder. It ends when the links form stars: no node has two parents, or a
    parent and a child. The number of steps grows with the logarithm of the
    longest chain.
    """
    # a > b from here on
    edges = scratch.put(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .distinct(), "edges")
    while True:
        ends = edges.select(F.col("a").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            edges.select(F.col("b").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1 AND up > 0").isEmpty():
            break
        # large star: every larger neighbour of a node goes to the node's minimum
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = scratch.put(both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")), "large")
        # small star: a node and its smaller neighbours go to their minimum
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = scratch.put(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "small")
        scratch.drop(edges, large)
        edges = new
    return edges.select(F.col("a").alias("id"), F.col("b").alias("comp")).unionByName(
        edges.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct())
