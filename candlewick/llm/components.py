"""Connected components by alternating large and small stars.

Every round joins the links with the smallest neighbour of each node; nothing is gathered per node, so a hub costs
no more than its links (aggregation combines before its shuffle, skewed joins can be split). Each round is
written to the shared folder, which cuts the lineage. The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.functions.staging import stage


def _state(e: DataFrame):
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """node and label (smallest node reachable) for every node that has a link; links are pairs (u, v)."""
    e = stage(links.select("u", "v").where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct())
    before = _state(e)
    while before[0]:
        e = stage(_small(_large(e)))
        now = _state(e)
        if now == before:
            break
        before = now
    stars = e.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("label"))
    return stars.unionByName(stars.select(F.col("label").alias("node"), "label").distinct())
