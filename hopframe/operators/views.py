"""Two views of a graph for contrastive training: edges dropped, or feature entries set to zero, each by its own hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopframe.functions.hashing import h, h2

RANGE = 2147483647


def drop_edges(edges: DataFrame, rate: float, seed: int) -> DataFrame:
    """edges (edge_id and others) less a share of them; all for a rate of zero or less."""
    return edges if rate <= 0 else edges.filter(h("edge_id", seed) >= rate * RANGE)


def mask_features(x: DataFrame, rate: float, seed: int) -> DataFrame:
    """x (node_idx, x and others) with a share of all entries set to zero."""
    if rate <= 0:
        return x
    return x.withColumn("x", F.transform("x", lambda v, i: F.when(h2(F.col("node_idx"), i.cast("long"), seed) >= rate * RANGE, v).otherwise(F.lit(0.0))))


def build_views(x: DataFrame, edges: DataFrame, enabled: bool, query_rate: float, key_mode: str, key_edge_rate: float, key_mask_rate: float, seed: int) -> tuple[tuple[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]:
    """(x, edges) of the query view and of the key view: the query's loses edges, the key's edges (`dropedge`) or
    feature entries; where views are not enabled both are the graph itself."""
    if not enabled:
        return (x, edges), (x, edges)
    query = x, drop_edges(edges, query_rate, seed)
    key = (x, drop_edges(edges, key_edge_rate, seed + 1)) if key_mode == "dropedge" else (mask_features(x, key_mask_rate, seed + 2), edges)
    return query, key
