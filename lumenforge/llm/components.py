"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges: u, v (any order, any type that sorts). Returns node, root for every node of an edge; root is the least node of its component.

    Each step takes minima by key (combined before the shuffle) and one join, so
    no node's neighbours are gathered in one place; lineage is cut every round.
    """
    now = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(down.union(low.select("u", F.col("m").alias("v"))).distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = state
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
