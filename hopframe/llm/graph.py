"""Connected components of an edge table, distributed, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopframe.llm.common import checkpointed


def _minimum(both: DataFrame) -> DataFrame:
    """u, m: the least of u and its neighbours; partial minima are taken before the shuffle."""
    return both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root for every node of edges (a, b): root is the least node it is connected with.

    Each round links every node to the least of its neighbours, first for the larger ones and then for the smaller
    (Kiveris et al., 2014), which ends in stars after about log2 of the longest path rounds. Nothing is collected:
    the joins split hot nodes by themselves, and every round's edges are written to the checkpoint folder.
    """
    now = checkpointed(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_minimum(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        new = small.select("u", F.col("m").alias("v")).union(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        new = checkpointed(new)
        # stars: no node is both a centre and a leaf, and every leaf has one centre
        unsettled = new.groupBy("u").count().filter("count > 1").limit(1).count() or new.join(new.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        now = new
        if not unsettled:
            break
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
