"""Subgraphs made ready for a model: local ids, role masks, budgeted edges, descriptions, gathered features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def local_ids(sub: DataFrame) -> DataFrame:
    """qid, node_idx, local_idx: the place of each node in its question's subgraph, by node_idx."""
    return sub.withColumn("local_idx", (F.row_number().over(Window.partitionBy("qid").orderBy("node_idx")) - 1).cast("int"))


def role_masks(sub: DataFrame, queries: DataFrame) -> DataFrame:
    """sub with is_src and is_dst: the first and second of a question's query nodes (qid, query_nodes); absent, neither."""
    x = sub.join(queries, "qid", "left")
    at = lambda k: F.coalesce(F.col("node_idx") == F.get("query_nodes", F.lit(k)), F.lit(False))
    return x.withColumns({"is_src": at(0), "is_dst": at(1)}).drop("query_nodes")


def budgeted_edges(sub: DataFrame, edges: DataFrame, max_nodes: int) -> DataFrame:
    """qid, src_idx, dst_idx, edge_attr: the first max(4, 4 * max_nodes) edges of each subgraph, by their ends."""
    ends = lambda c: sub.select("qid", F.col("node_idx").alias(c))
    x = edges.join(ends("src_idx"), "src_idx").join(ends("dst_idx"), ["qid", "dst_idx"], "left_semi")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("src_idx", "dst_idx", "edge_attr"))
    return x.withColumn("_rn", rank).filter(F.col("_rn") <= max(4, 4 * max_nodes)).select("qid", "src_idx", "dst_idx", "edge_attr")


def _lines(df: DataFrame, order: list[str], line: Column, name: str) -> DataFrame:
    """qid and its lines in order, as one text; few by the budgets."""
    rows = df.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))).alias("_l"))
    return rows.select("qid", F.array_join(F.transform("_l", lambda x: x["_line"]), "\n").alias(name))


def sampled_nodes(sub: DataFrame, nodes: DataFrame, edges: DataFrame, max_nodes: int) -> DataFrame:
    """qid, description: the first nodes of a subgraph with their texts, then its edges within the budget."""
    first = local_ids(sub).filter(F.col("local_idx") < max_nodes).join(nodes.select("node_idx", "node_attr"), "node_idx")
    n = _lines(first, ["node_idx"], F.concat_ws(",", F.col("node_idx").cast("string"), "node_attr"), "_n")
    e = budgeted_edges(sub, edges, max_nodes)
    e = _lines(e, ["src_idx", "dst_idx", "edge_attr"], F.concat_ws(",", F.col("src_idx").cast("string"), "edge_attr", F.col("dst_idx").cast("string")), "_e")
    x = n.join(e, "qid", "left")
    return x.select("qid", F.concat(F.lit("nodes:\n"), "_n", F.coalesce(F.concat(F.lit("\nedges:\n"), F.col("_e")), F.lit(""))).alias("description"))


def missing(needed: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """The needed rows whose key the table lacks."""
    return needed.join(table.select(key), key, "left_anti")


def node_features(sub: DataFrame, features: DataFrame) -> DataFrame:
    """sub with the stored vectors of its nodes as floats; the sampled side is the small one, only its rows are read."""
    return sub.join(features.select("node_idx", F.col("x").cast("array<float>").alias("x")), "node_idx")


def edge_features(edges: DataFrame, types: DataFrame) -> DataFrame:
    """edges with `features`: their own edge_attr, else their type's vector (edge_type, vector; a row a type), else null."""
    return edges.join(F.broadcast(types), "edge_type", "left").withColumn("features", F.coalesce("edge_attr", "vector")).drop("vector")


def graph_summary(domain: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """description: one row on the whole graph."""
    n, e = nodes.agg(F.count("*").alias("_n")), edges.agg(F.count("*").alias("_e"))
    text = F.concat(F.lit(f"Graph Domain: {domain}. Nodes: "), F.col("_n").cast("string"), F.lit(". Edges: "), F.col("_e").cast("string"), F.lit("."))
    return n.join(F.broadcast(e), F.col("_n") >= 0).select(text.alias("description"))  # one row each


def query_adjacency(sub: DataFrame, edges: DataFrame, queries: DataFrame, max_nodes: int) -> DataFrame:
    """qid, description of each question's sampled subgraph: its query nodes, a table of nodes, a list of edges.

    sub: qid, node_idx, local_idx. edges: qid, src_idx, dst_idx, pos. queries: qid, query_nodes. The query nodes that
    the subgraph has come first, each once, then the others in local order up to max_nodes (one beyond the query nodes
    at least); edges between those follow in their order, max(4, 4 * max_nodes) of them. Without any such edge the text
    is empty.
    """
    asked = queries.select("qid", F.posexplode(F.array_distinct("query_nodes")).alias("_q", "node_idx"))
    n = sub.join(asked, ["qid", "node_idx"], "left")
    first = Window.partitionBy("qid").orderBy(F.col("_q").asc_nulls_last(), "local_idx")
    whole = Window.partitionBy("qid")
    n = n.withColumns({"_rank": F.row_number().over(first) - 1, "_asked": F.count("_q").over(whole)})
    n = n.filter((F.col("_rank") < max_nodes) | (F.col("_rank") <= F.col("_asked")))
    role = F.when(F.col("_rank") == 0, "src").when(F.col("_rank") == 1, "dst").otherwise(F.concat(F.lit("query_"), F.col("_rank").cast("string")))
    node = F.concat(F.lit("node_idx="), F.col("node_idx").cast("string"))
    end = lambda c: n.select("qid", F.col("node_idx").alias(c))
    e = edges.select("qid", "src_idx", "dst_idx", "pos").join(end("src_idx"), ["qid", "src_idx"], "left_semi").join(end("dst_idx"), ["qid", "dst_idx"], "left_semi")
    e = e.withColumn("_rn", F.row_number().over(Window.partitionBy("qid").orderBy("pos"))).filter(F.col("_rn") <= max(4, 4 * max_nodes))
    a = _lines(n.filter(F.col("_q").isNotNull()), ["_rank"], F.concat(role, F.lit(": "), node), "_a")
    b = _lines(n, ["_rank"], node, "_b")
    c = _lines(e, ["pos"], F.concat(F.col("src_idx").cast("string"), F.lit(" -> "), F.col("dst_idx").cast("string")), "_c")
    x = b.join(a, "qid", "left").join(c, "qid", "left")
    parts = F.concat_ws("\n", F.lit("Serialized query-centered sampled subgraph."), F.lit("Query nodes:"), F.coalesce("_a", F.lit("unknown")), F.lit("Node table:"), "_b", F.lit("Adjacency list:"), "_c")
    return x.select("qid", F.when(F.col("_c").isNull(), "").otherwise(parts).alias("description"))


def described(mode: str, questions: DataFrame, domain: str, nodes: DataFrame, edges: DataFrame, adjacency: DataFrame | None = None, max_nodes: int = 16) -> DataFrame:
    """qid, description for each question: `none`, `summary`, `sampled_nodes` (a table of the first nodes) or
    `query_adjacency`, which falls back to the summary where a question has none."""
    if mode == "none":
        return questions.select("qid", F.lit("").alias("description"))
    if mode == "sampled_nodes":
        head = nodes.orderBy("node_idx").limit(max_nodes)  # the table's head is the feature
        quoted = lambda c: F.when(F.col(c).rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(c))
        line = F.concat_ws(",", F.col("node_idx").cast("string"), quoted("node_id"), quoted("node_type"), quoted("node_attr"))
        rows = head.agg(F.array_sort(F.collect_list(F.struct("node_idx", line.alias("_l")))).alias("_r"))
        text = rows.select(F.concat(F.lit("node_idx,node_id,node_type,node_attr\n"), F.array_join(F.transform("_r", lambda r: F.concat(r["_l"], F.lit("\n"))), "")).alias("description"))
        return questions.select("qid").join(F.broadcast(text), F.lit(True))  # one row
    whole = F.broadcast(graph_summary(domain, nodes, edges).withColumnRenamed("description", "_s"))
    if mode == "summary":
        return questions.select("qid").join(whole, F.lit(True)).select("qid", F.col("_s").alias("description"))
    if mode != "query_adjacency" or adjacency is None:
        raise ValueError(f"no such description: {mode}")
    own = questions.select("qid").join(adjacency.filter("description <> ''"), "qid", "left").join(whole, F.lit(True))
    return own.select("qid", F.coalesce("description", "_s").alias("description"))
