"""Graph convolution stacks and projectors with given weights, forward only.

Nodes carry their vector as one array column (node_idx, x); edges are (src_idx, dst_idx) rows and may repeat. Dense
products run an Arrow batch at a time, messages are joins of edges with their source, and sums over a node's incoming
edges are taken before the shuffle, so no operator makes a row a dimension. Nodes without edges keep a row.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopframe.functions import vectors as V
from hopframe.session import checkpointed

#: Slope of the leaky rectifier of attention, and what keeps its sums from zero.
SLOPE, TINY = 0.2, 1e-16


def gcn(x: DataFrame, edges: DataFrame, weight, bias=None) -> DataFrame:
    """Symmetrically normalised sum over incoming edges and one loop a node, of weight x; then bias."""
    dim = len(weight)
    links = edges.filter("src_idx <> dst_idx").select("src_idx", "dst_idx")
    deg = links.groupBy(F.col("dst_idx").alias("node_idx")).agg(F.count("*").alias("k"))
    z = x.select("node_idx", V.dense(F.col("x"), weight).alias("z")).join(deg, "node_idx", "left")
    z = z.select("node_idx", (1 / F.sqrt(F.coalesce("k", F.lit(0)) + 1.0)).alias("r"), "z")
    z = checkpointed(z)
    got = links.join(z.select(F.col("node_idx").alias("src_idx"), V.times(F.col("z"), F.col("r")).alias("m")), "src_idx")
    got = got.groupBy(F.col("dst_idx").alias("node_idx")).agg(V.vector_sum(F.col("m"), dim).alias("m"))
    own = V.times(F.col("z"), F.col("r"))
    out = z.join(got, "node_idx", "left")
    total = V.times(F.when(F.col("m").isNull(), own).otherwise(V.plus(own, F.col("m"))), F.col("r"))
    return out.select("node_idx", (total if bias is None else V.plus(total, V.literal(bias))).alias("x"))


def _softmax(links: DataFrame, heads: int, value: Column, dim: int) -> DataFrame:
    """dst_idx, m: for each head the softmax over a node's incoming links of their logits `l`, times its slice of the
    value. The greatest logit first, then the sums of exponentials and of weighted values in one aggregation.
    """
    top = links.groupBy("dst_idx").agg(F.array(*(F.max(F.col("l")[h]) for h in range(heads))).alias("top"))
    e = links.join(top, "dst_idx").select("dst_idx", F.zip_with("l", "top", lambda a, b: F.exp(a - b)).alias("e"), value.alias("v"))
    c = dim // heads
    sums = [F.sum(F.col("e")[i // c] * F.col("v")[i]) / (F.sum(F.col("e")[i // c]) + TINY) for i in range(dim)]
    return e.groupBy("dst_idx").agg(F.array(*sums).alias("m"))


def gat(x: DataFrame, edges: DataFrame, weight, att_src, att_dst, bias=None, edge_weight=None, att_edge=None) -> DataFrame:
    """Attention over incoming edges and one loop a node, the mean of the heads, then bias.

    weight: heads * c rows; att_src, att_dst, att_edge: a row of c numbers a head. With edge_weight, edges carry an
    array `e`; the loop's edge vector is the mean of those that come in.
    """
    import numpy as np

    w, a, b = (np.asarray(v, float) for v in (weight, att_src, att_dst))
    heads, c = a.shape
    per_head = lambda att, m: np.concatenate([att[h : h + 1] @ m[h * c : (h + 1) * c] for h in range(heads)])
    # the logits' halves are linear in x too: one product gives all
    z = x.select("node_idx", V.dense(F.col("x"), np.concatenate([w, per_head(a, w), per_head(b, w)])).alias("z"))
    part = lambda at, n: F.slice("z", at + 1, n)
    z = checkpointed(z.select("node_idx", part(0, heads * c).alias("v"), part(heads * c, heads).alias("s"), part(heads * c + heads, heads).alias("d")))
    links = edges.filter("src_idx <> dst_idx")
    loops = z.select(F.col("node_idx").alias("src_idx"), F.col("node_idx").alias("dst_idx"))
    zero = V.literal([0] * heads)
    if edge_weight is None:
        links = links.select("src_idx", "dst_idx", zero.alias("le"))
        loops = loops.withColumn("le", zero)
    else:
        links = links.select("src_idx", "dst_idx", V.dense(F.col("e"), per_head(np.asarray(att_edge, float), np.asarray(edge_weight, float))).alias("le"))
        mean = links.groupBy("dst_idx").agg(F.array(*(F.avg(F.col("le")[h]) for h in range(heads))).alias("le"))
        loops = loops.join(mean, "dst_idx", "left").select("src_idx", "dst_idx", F.coalesce("le", zero).alias("le"))
    links = links.unionByName(loops)
    links = links.join(z.select(F.col("node_idx").alias("src_idx"), "v", "s"), "src_idx").join(z.select(F.col("node_idx").alias("dst_idx"), "d"), "dst_idx")
    links = links.select("dst_idx", "v", F.transform(V.plus(F.col("s"), F.col("d"), F.col("le")), lambda t: F.when(t >= 0, t).otherwise(SLOPE * t)).alias("l"))
    got = _softmax(checkpointed(links), heads, F.col("v"), heads * c)
    mean = F.array(*(sum((F.col("m")[h * c + i] for h in range(heads)), F.lit(0.0)) / heads for i in range(c)))
    return got.select(F.col("dst_idx").alias("node_idx"), (mean if bias is None else V.plus(mean, V.literal(bias))).alias("x"))


def transformer(x: DataFrame, edges: DataFrame, query, key, value, skip, heads: int, edge=None) -> DataFrame:
    """Dot-product attention over incoming edges, heads side by side, plus a skip connection.

    query, key, value and skip are (weight, bias); with `edge`, a weight, edges carry an array `e` whose product joins
    keys and values.
    """
    import numpy as np

    (wq, bq), (wk, bk), (wv, bv), (ws, bs) = query, key, value, skip
    dim, c = len(wv), len(wv) // heads
    stacked = V.dense(F.col("x"), np.concatenate([wq, wk, wv, ws]), np.concatenate([bq, bk, bv, bs]))
    part = lambda k: F.slice("z", k * dim + 1, dim)
    z = checkpointed(x.select("node_idx", stacked.alias("z")).select("node_idx", part(0).alias("q"), part(1).alias("k"), part(2).alias("v"), part(3).alias("s")))
    links = edges.join(z.select(F.col("node_idx").alias("src_idx"), "k", "v"), "src_idx").join(z.select(F.col("node_idx").alias("dst_idx"), "q"), "dst_idx")
    if edge is not None:
        links = links.withColumn("e", V.dense(F.col("e"), edge)).withColumns({"k": V.plus(F.col("k"), F.col("e")), "v": V.plus(F.col("v"), F.col("e"))})
    products = F.zip_with("q", "k", lambda a, b: a * b)
    sums = F.array(*(F.aggregate(F.slice(products, h * c + 1, c), F.lit(0.0), lambda s, t: s + t) / c**0.5 for h in range(heads)))
    got = _softmax(checkpointed(links.select("dst_idx", "v", sums.alias("l"))), heads, F.col("v"), dim)
    out = z.select("node_idx", "s").join(got.withColumnRenamed("dst_idx", "node_idx"), "node_idx", "left")
    return out.select("node_idx", F.when(F.col("m").isNull(), F.col("s")).otherwise(V.plus(F.col("s"), F.col("m"))).alias("x"))


def normalized(x: DataFrame, mean, variance, weight, bias, eps: float = 1e-5) -> DataFrame:
    """Batch normalisation with given statistics, then the rectifier."""
    scale = [w / (v + eps) ** 0.5 for w, v in zip(weight, variance, strict=True)]
    shift = [b - m * s for b, m, s in zip(bias, mean, scale, strict=True)]
    y = V.plus(F.zip_with("x", V.literal(scale), lambda a, b: a * b), V.literal(shift))
    return x.select("node_idx", F.transform(y, lambda t: F.greatest(t, F.lit(0.0))).alias("x"))


def stack(x: DataFrame, edges: DataFrame, layers: list[tuple[Callable[..., DataFrame], dict]], norms: list[tuple]) -> DataFrame:
    """Layers (a convolution and its weights) with batch normalisation and the rectifier between them."""
    if not layers or len(norms) != len(layers) - 1:
        raise ValueError("a stack needs at least one layer, and statistics between layers")
    for i, (layer, weights) in enumerate(layers):
        x = layer(x, edges, **weights)
        if i < len(norms):
            x = normalized(x, *norms[i])
    return x


# ---- projectors


def projected(x: Column, layers: list[tuple], between: Callable[[Column], Column]) -> Column:
    """Dense layers (weight, bias) with a function between them."""
    for i, (w, b) in enumerate(layers):
        x = V.dense(F.transform(x, between) if i else x, w, b)
    return x


def projector(kind: str) -> tuple[int, Callable[[Column], Column]]:
    """How many dense layers a kind of projector has and what stands between them: linear, sigmoid-mlp, N-layer-mlp."""
    if kind == "linear":
        return 1, V.gelu
    if kind == "sigmoid-mlp":
        return 2, V.sigmoid
    m = re.fullmatch(r"([0-9]+)-layer-mlp", kind)
    if not m:
        raise ValueError(f"no such projector: {kind}")
    return max(int(m.group(1)), 1), V.gelu


def project(x: Column, kind: str, layers: list[tuple]) -> Column:
    n, between = projector(kind)
    if len(layers) != n:
        raise ValueError(f"{kind} takes {n} layers, not {len(layers)}")
    return projected(x, layers, between)
