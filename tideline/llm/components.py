"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import stage


def _with_least(edges: DataFrame, name: str) -> DataFrame:
    """Edges (u, v) with ``m``, the least of u and all its v. Hubs are split by adaptive execution: both sides are plain tables."""
    least = stage(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("_u", "m").alias("m")), name)
    return edges.join(least, F.col("u") == F.col("_u")).drop("_u")


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns a, b, of one ordered type): root is the least node of its component.

    Each round moves the neighbours of a node to the least of them, first the larger neighbours, then the smaller; rounds grow
    with the logarithm of the longest path. Loops are ignored and nodes that only have loops are not listed. Edges stay in
    tables in the shared folder from step to step; nothing is collected but two totals.
    """
    pairs = edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    pairs = stage(pairs.distinct(), "edges")

    def state(df):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    seen = state(pairs)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, "least").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.distinct(), "large_star")
        least = _with_least(large, "least")
        small = least.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        pairs = stage(small.distinct(), "small_star")
        now = state(pairs)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
