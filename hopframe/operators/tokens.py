"""Graph tokens for a decoder: pooled or ordered node vectors, annotated, projected, and optionally disturbed.

A sequence is rows (qid, pos, mask, x). Learned tables and weights are given, rows of numbers by index; they belong to a
model, not to the data. Padding rows, where asked for, carry mask = false: no bias, residual or disturbance touches them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopframe.functions import vectors as V
from hopframe.functions.hashing import h2
from hopframe.operators.layers import project


@dataclass
class Tables:
    """What a model has learned; what is None does not take part."""

    degree: tuple | None = None  # weight and bias of a layer from one number
    role: list | None = None
    distance_src: list | None = None  # by distance, the last entry for the disconnected
    distance_dst: list | None = None
    corridor: tuple | None = None  # weight and bias of a layer from one number
    corridor_alpha: float = 0.5
    identity: list | None = None  # by position
    projector: tuple[str, list] | None = None  # its kind and layers
    role_residual: list | None = None
    role_alpha: float = 1.0
    role_clip: float = 0.0
    distance_src_residual: list | None = None  # by coarse distance, or role and coarse distance
    distance_dst_residual: list | None = None
    by_role: bool = False
    distance_alpha: float = 1.0
    distance_clip: float = 0.0
    roles: int = field(default=4)


def entry(table: list, index: Column) -> Column:
    return F.get(F.array(*(V.literal(r) for r in table)), index.cast("int"))


def from_one(layer: tuple, x: Column) -> Column:
    """A layer from one number, by columns."""
    weight, bias = layer
    return F.zip_with(V.literal([w[0] for w in weight]), V.literal(bias), lambda w, b: w * x + b)


def distance_bucket(d: Column, size: int) -> Column:
    """A distance as an index of a table of this size; negative ones and those beyond are the last."""
    return F.when(d < 0, size - 1).otherwise(F.least(d, F.lit(size - 1)))


def coarse_bucket(d: Column, size: int) -> Column:
    """0, 1, 2, ... up to the last but one, and the last for negative distances."""
    return F.when(d < 0, size - 1).otherwise(F.least(d, F.lit(size - 2)))


def clipped(residual: Column, base: Column, ratio: float) -> Column:
    return V.times(residual, V.clip_residual(base, residual, ratio)) if ratio > 0 else residual


def pooled(x: DataFrame, dim: int) -> DataFrame:
    """qid, x: the mean over a graph's target nodes if any graph of the batch has one, and zeros for graphs that then
    have none; else over all nodes. x: qid, node_idx, x, target.
    """
    sums = x.groupBy("qid").agg(
        V.vector_sum(F.col("x"), dim, F.col("target").cast("double")).alias("_t"), F.sum(F.col("target").cast("long")).alias("_nt"), V.vector_sum(F.col("x"), dim).alias("_a"), F.count("*").alias("_na")
    )
    any_ = F.max("_nt").over(Window.partitionBy(F.lit(0))) > 0  # a row a graph of one batch
    return sums.select("qid", F.when(any_, V.times(F.col("_t"), 1.0 / F.greatest("_nt", F.lit(1)))).otherwise(V.times(F.col("_a"), 1.0 / F.col("_na"))).alias("x"))


def annotated(tokens: DataFrame, t: Tables) -> DataFrame:
    """tokens (qid, pos, x, bias, role, d_src, d_dst, delta, active) with the biases before the projector added to x."""
    parts = []
    if t.role is not None:
        parts.append(entry(t.role, F.col("role")))
    if t.distance_src is not None and t.distance_dst is not None:
        parts += [entry(table, distance_bucket(F.col(c), len(table))) for table, c in ((t.distance_src, "d_src"), (t.distance_dst, "d_dst"))]
    if t.corridor is not None:
        weight = F.when(F.col("delta") >= 0, F.exp(-t.corridor_alpha * F.col("delta"))).otherwise(0.0)
        parts.append(from_one(t.corridor, weight))
    x = F.col("x")
    if t.degree is not None:
        x = V.plus(x, from_one(t.degree, F.col("bias")))
    if parts:
        x = F.when(F.col("active"), V.plus(x, *parts)).otherwise(x)
    if t.identity is not None:
        x = V.plus(x, entry(t.identity, F.col("pos")))
    return tokens.withColumn("x", x)


def residuals(tokens: DataFrame, t: Tables) -> DataFrame:
    """tokens with the residuals after the projector, each clipped to a share of the projected token's norm."""
    x = F.col("x")
    if t.role_residual is not None:
        x = V.plus(x, clipped(V.times(entry(t.role_residual, F.col("role")), F.lit(float(t.role_alpha))), F.col("x"), t.role_clip))
    if t.distance_src_residual is not None and t.distance_dst_residual is not None:
        size = len(t.distance_src_residual) // (t.roles if t.by_role else 1)
        at = lambda c: (F.col("role") * size if t.by_role else F.lit(0)) + coarse_bucket(F.col(c), size)
        both = V.plus(entry(t.distance_src_residual, at("d_src")), entry(t.distance_dst_residual, at("d_dst")))
        x = V.plus(x, clipped(V.times(both, F.lit(float(t.distance_alpha))), F.col("x"), t.distance_clip))
    return tokens.withColumn("x", F.when(F.col("active"), x).otherwise(F.col("x")))


def shuffled(tokens: DataFrame, seed: int) -> DataFrame:
    """Valid tokens of each sequence in the order of a hash; padding stays where it is."""
    by = Window.partitionBy("qid", "mask").orderBy(h2("qid", "pos", seed), "pos")
    return tokens.withColumn("pos", F.when(F.col("mask"), F.row_number().over(by) - 1).otherwise(F.col("pos")).cast("int"))


def corrupted(tokens: DataFrame, dim: int, seed: int) -> DataFrame:
    """Valid tokens replaced by noise of their own norm: uniform numbers from a hash of question, place and dimension."""
    noise = F.array(*(h2(F.col("qid") * 1000 + F.col("pos"), F.lit(i), seed) / 2147483647.0 - 0.5 for i in range(dim)))
    scale = F.greatest(V.norm(F.col("x")), F.lit(1e-6)) / F.greatest(V.norm(noise), F.lit(1e-6))
    return tokens.withColumn("x", F.when(F.col("mask"), V.times(noise, scale)).otherwise(F.col("x")))


def assembled(tokens: DataFrame, x: DataFrame, t: Tables, mode: str, dim: int, pad: bool = False) -> DataFrame:
    """qid, pos, node_idx, mask, x of a batch of questions.

    tokens: qid, pos, node_idx, role, d_src, d_dst, delta, active, bias, target, in order within their budget. x:
    node_idx, x. mode: `disabled` gives no rows, `single` a pooled row a question, `nodes` a row a token; pad fills
    every question up to the longest.
    """
    given = tokens.join(x, "node_idx")
    if mode == "disabled":
        return given.select("qid", F.lit(0).alias("pos"), "node_idx", F.lit(False).alias("mask"), "x").limit(0)
    layers = lambda c: project(c, *t.projector) if t.projector is not None else c
    if mode == "single":
        return pooled(given.select("qid", "node_idx", "x", "target"), dim).select("qid", F.lit(0).alias("pos"), F.lit(None).cast("long").alias("node_idx"), F.lit(True).alias("mask"), layers(F.col("x")).alias("x"))
    if mode != "nodes":
        raise ValueError(f"no such mode: {mode}")
    out = annotated(given.withColumn("mask", F.lit(True)), t)
    out = residuals(out.withColumn("x", layers(F.col("x"))), t) if t.projector is not None else out
    out = out.select("qid", F.col("pos").cast("int").alias("pos"), "node_idx", "mask", "x")
    if not pad:
        return out
    n = tokens.groupBy("qid").agg(F.count("*").alias("_n"))
    longest = n.agg(F.max("_n").alias("_m"))  # one row
    empty = n.join(F.broadcast(longest), F.col("_n") < F.col("_m")).select("qid", F.explode(F.sequence(F.col("_n").cast("int"), F.col("_m").cast("int") - 1)).alias("pos"))
    return out.unionByName(empty.select("qid", "pos", F.lit(None).cast("long").alias("node_idx"), F.lit(False).alias("mask"), layers(V.literal([0] * dim)).alias("x")))
