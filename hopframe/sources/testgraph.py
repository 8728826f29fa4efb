"""The star schema read as a typed graph: nodes with dense indices and a directed edge multiset.

node_idx is an offset by type plus the table's dense key, so no global window numbers the nodes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopframe.session import few

TYPES = (("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("supplier", "s_suppkey", "s_name"), ("customer", "c_custkey", "c_name"), ("part", "p_partkey", "p_name"), ("orders", "o_orderkey", None))
TYPE_NAMES = {"region": "region_nodes", "nation": "nation_nodes", "supplier": "supplier_nodes", "customer": "customer_nodes", "part": "part_nodes", "orders": "order_nodes"}
SMALL = ("region", "nation", "supplier", "customer")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_COUNTED: dict[tuple, int] = {}


def counted(df: DataFrame) -> int:
    """The rows of a table, counted once for the same files in an application."""
    key = (df.sparkSession.sparkContext.applicationId, *sorted(df.inputFiles()))
    if key not in _COUNTED:
        _COUNTED[key] = df.count()
    return _COUNTED[key]


def offsets(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    """First node_idx of each type; counts come from file footers."""
    out, at = {}, 0
    for name, _, _ in TYPES:
        out[name] = at
        at += counted(table(spark, sf_dir, name))
    return out


def nodes(spark: SparkSession, sf_dir: str, small: bool = False) -> DataFrame:
    """node_idx, node_id, node_type, node_attr."""
    off = offsets(spark, sf_dir)
    parts = []
    for name, key, label in TYPES:
        if small and name not in SMALL:
            continue
        kind = TYPE_NAMES[name]
        attr = F.concat(F.lit(f"type={kind}; name: "), F.col(label)) if label else F.lit(f"type={kind}; ")
        parts.append(table(spark, sf_dir, name).select((F.col(key).cast("long") + off[name]).alias("node_idx"), F.concat(F.lit(f"{name}:"), F.col(key).cast("string")).alias("node_id"), F.lit(kind).alias("node_type"), attr.alias("node_attr")))
    return reduce(DataFrame.unionByName, parts)


def most_lines(lines: DataFrame) -> int:
    """The most lines of an order, counted once for the same files in an application."""
    key = ("most", lines.sparkSession.sparkContext.applicationId, *sorted(lines.inputFiles()))
    if key not in _COUNTED:
        _COUNTED[key] = lines.groupBy("l_orderkey").count().agg(F.max("count")).first()[0] or 0
    return _COUNTED[key]


def edges(spark: SparkSession, sf_dir: str, small: bool = False, numbered: bool = False, around: DataFrame | None = None) -> DataFrame:
    """src_idx, dst_idx, src_id, dst_id, edge_attr; a lineitem gives its order two edges.

    numbered adds edge_id, which no two edges share: the source's index where a source has one edge, and beyond all
    indices two numbers a lineitem, by its order and its place among the order's lines. around (node_idx) leaves the
    edges with an end among these nodes: only the orders of such lines are numbered.
    """
    off = offsets(spark, sf_dir)

    def link(df: DataFrame, a: str, ka: str, b: str, kb: str, attr: str, edge_id: Column | None = None) -> DataFrame:
        ends = [((F.col(k).cast("long") + off[t]).alias(f"{e}_idx"), F.concat(F.lit(f"{t}:"), F.col(k).cast("string")).alias(f"{e}_id")) for e, t, k in (("src", a, ka), ("dst", b, kb))]
        number = [(ends[0][0] if edge_id is None else edge_id).alias("edge_id")] if numbered else []
        return touching(df.select(ends[0][0], ends[1][0], ends[0][1], ends[1][1], F.lit(attr).alias("edge_attr"), *number), "src_idx", "dst_idx")

    near = None if around is None else few(around.select("node_idx").distinct().withColumn("_near", F.lit(True)))

    def touching(df: DataFrame, *ends: str) -> DataFrame:
        if near is None:
            return df
        marks = [f"_near_{c}" for c in ends]
        for c, mark in zip(ends, marks, strict=True):
            df = df.join(near.withColumnsRenamed({"node_idx": c, "_near": mark}), c, "left")
        return df.filter(F.coalesce(*marks, F.lit(False))).drop(*marks)

    t = lambda n: table(spark, sf_dir, n)
    parts = [link(t("nation"), "nation", "n_nationkey", "region", "n_regionkey", "region"), link(t("customer"), "customer", "c_custkey", "nation", "c_nationkey", "nation"), link(t("supplier"), "supplier", "s_suppkey", "nation", "s_nationkey", "nation")]
    if not small:
        lines, first, second = t("lineitem"), None, None
        if numbered:
            most = most_lines(lines)
            if around is not None:
                index = lambda n, k: (F.col(k).cast("long") + off[n]).alias(n)
                asked = touching(lines.select("l_orderkey", index("orders", "l_orderkey"), index("part", "l_partkey"), index("supplier", "l_suppkey")), "orders", "part", "supplier")
                lines = lines.join(few(asked.select("l_orderkey").distinct()), "l_orderkey", "left_semi")
            # keys of lines may repeat, so the place is by all columns
            place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*(c for c in lines.columns if c != "l_orderkey"))) - 1
            lines = lines.withColumn("_place", F.col("l_orderkey").cast("long") * most + place)
            first = off["orders"] + counted(t("orders")) + 2 * F.col("_place")
            second = first + 1
        parts += [link(t("orders"), "orders", "o_orderkey", "customer", "o_custkey", "customer"), link(lines, "orders", "l_orderkey", "part", "l_partkey", "part", first), link(lines, "orders", "l_orderkey", "supplier", "l_suppkey", "supplier", second)]
    return reduce(DataFrame.unionByName, parts)


def undirected(e: DataFrame) -> DataFrame:
    """u, v of every edge in both directions, duplicates kept."""
    return e.select(F.col("src_idx").alias("u"), F.col("dst_idx").alias("v")).unionByName(e.select(F.col("dst_idx").alias("u"), F.col("src_idx").alias("v")))
