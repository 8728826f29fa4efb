"""Feature vectors sent along the edges: normalised adjacency, steps, gated mixing, importance. A vector is one array."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopframe.functions import vectors as V


def adjacency(nodes: DataFrame, und: DataFrame) -> DataFrame:
    """u, v, w: the symmetric normalised adjacency of distinct links (u, v) with self-loops."""
    a = und.select("u", "v").unionByName(nodes.select(F.col("node_idx").alias("u"), F.col("node_idx").alias("v"))).distinct()
    k = a.groupBy("u").agg(F.count("*").cast("double").alias("k"))
    return a.join(k, "u").join(k.select(F.col("u").alias("v"), F.col("k").alias("kv")), "v").select("u", "v", (1 / F.sqrt(F.col("k") * F.col("kv"))).alias("w"))


def step(a: DataFrame, x: DataFrame, dim: int) -> DataFrame:
    """What each node receives: node_idx, x. Sums are taken before the shuffle."""
    sent = a.join(x.withColumnRenamed("node_idx", "v"), "v")
    return sent.groupBy(F.col("u").alias("node_idx")).agg(V.vector_sum(F.col("x"), dim, F.col("w")).alias("x"))


def propagated(a: DataFrame, x: DataFrame, steps: int, dim: int) -> DataFrame:
    """The sum of 1 .. steps steps; x itself for none. Every node of an adjacency has a loop, so none drops out."""
    if not steps:
        return x
    now = total = step(a, x, dim)
    for _ in range(steps - 1):
        now = step(a, now, dim)
        total = total.join(now.withColumnRenamed("x", "_y"), "node_idx").select("node_idx", V.plus(F.col("x"), F.col("_y")).alias("x"))
    return total


def gated(x: DataFrame, message: DataFrame, gates: DataFrame) -> DataFrame:
    """node_idx, x, moved: g * x + (1 - g) * message and the norm of (1 - g) * (message - x), a gate a node (node_idx, g)."""
    both = x.join(message.withColumnRenamed("x", "m"), "node_idx").join(gates, "node_idx")
    moved = F.zip_with("x", "m", lambda a, b: (1 - F.col("g")) * (b - a))
    return both.select("node_idx", F.zip_with("x", "m", lambda a, b: F.col("g") * a + (1 - F.col("g")) * b).alias("x"), V.norm(moved).alias("moved"))


def importance(a: DataFrame, x: DataFrame, gates: DataFrame, layers: int, dim: int) -> DataFrame:
    """node_idx, importance: the mean over the layers of how far a layer's gated message moves the node."""
    now, total = x, None
    for _ in range(layers):
        mixed = gated(now, step(a, now, dim), gates)
        now = mixed.select("node_idx", "x")
        moved = mixed.select("node_idx", F.col("moved").alias("d"))
        total = moved if total is None else total.join(moved.withColumnRenamed("d", "_d"), "node_idx").select("node_idx", (F.col("d") + F.col("_d")).alias("d"))
    return total.select("node_idx", (F.col("d") / layers).alias("importance"))
