"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.llm.common import drop_stored, store

MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, component), component being the least node reachable, for every node of ``edges`` (a, b).

    Each round hangs a node's larger neighbours on its least one, then its smaller ones; edges stay as many as
    nodes and links at most, and only their count and sum come to the driver. The rounds needed grow with the
    logarithm of the longest chain. A written table ends the lineage of each round.
    """
    now = store(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    for _ in range(MOST_ROUNDS):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v") \
            .unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        after = store(small)
        drop_stored(now)
        now = after
        seen = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    pairs = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return pairs.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
