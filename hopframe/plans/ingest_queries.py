"""Reading raw documents and stores that Spark writes from the tables, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopframe import preprocess
from hopframe.functions import text as T
from hopframe.functions import vectors as V
from hopframe.session import scratch
from hopframe.operators.layout import IGNORED, text_layout
from hopframe.sources import files, vectors

#: The tokenizer of decoder layouts.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def written_graph(s: SparkSession, d: str) -> str:
    """Regions, nations, suppliers and customers as raw graph documents, one a type, in a folder."""
    path = scratch(s, "graph")
    for kind, key, name, up in (("region", "r_regionkey", "r_name", None), ("nation", "n_nationkey", "n_name", "region:n_regionkey"), ("supplier", "s_suppkey", "s_name", "nation:s_nationkey"), ("customer", "c_custkey", "c_name", "nation:c_nationkey")):
        t = s.read.parquet(f"{d}/{kind}.parquet").withColumn("k", F.col(key).cast("long"))
        near = F.create_map().cast("map<string,array<string>>")
        if up:
            far, column = up.split(":")
            near = F.create_map(F.lit(far), F.array(F.concat(F.lit(f"{far}:"), F.col(column).cast("string"))))
        value = F.to_json(F.struct(F.create_map(F.lit("name"), F.col(name)).alias("features"), near.alias("neighbors")))
        first = t.agg(F.min("k")).first()[0]
        node = F.concat(F.when(F.col("k") > first, ",").otherwise(""), F.lit(f'"{kind}:'), F.col("k").cast("string"), F.lit('": '), value)
        lines = t.select("k", node.alias("value"))
        edge = s.createDataFrame([(-(2**62), f'{{"{kind}_nodes": {{'), (2**62, "}}")], "k long, value string")
        lines.unionByName(edge).coalesce(1).sortWithinPartitions("k").select("value").write.text(f"{path}/{kind}")
    return path


_RAW = """
WITH n AS (
  SELECT 'customer:' || c_custkey AS id, 1 AS t, c_custkey AS k FROM customer UNION ALL SELECT 'nation:' || n_nationkey, 2, n_nationkey FROM nation
  UNION ALL SELECT 'region:' || r_regionkey, 3, r_regionkey FROM region UNION ALL SELECT 'supplier:' || s_suppkey, 4, s_suppkey FROM supplier
), i AS (SELECT id, row_number() OVER (ORDER BY t, k) - 1 AS node_idx FROM n), e AS (
  SELECT 'customer:' || c_custkey AS src_id, 'nation:' || c_nationkey AS dst_id, 'nation' AS edge_attr FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'nation' FROM supplier
  UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'region' FROM nation
)
SELECT a.node_idx AS src_idx, b.node_idx AS dst_idx, src_id, dst_id, edge_attr FROM e JOIN i a ON a.id = src_id JOIN i b ON b.id = dst_id
"""


@query(_RAW)
def raw_json_ingest(s, d):
    """The edge table of raw graph documents that hold the small tables; types in the order of their files."""
    return preprocess.graph_tables(s, written_graph(s, d) + "/*", "dblp")[1]


@query(
    """
SELECT p_partkey,
       'name: ' || p_name || '; size: ' || p_size || '; large: ' || CASE WHEN p_size > 25 THEN 'True' ELSE 'False' END || '; half: ' || CAST(p_size / 2.0::DOUBLE AS VARCHAR)
       || '; none: None; like_json: [1, 2]; tags: ' || p_brand || ', {''y'': ' || p_size || '}, None, True; deep: a: b: c: d: ' || p_size || '; e: ' AS node_attr
FROM part"""
)
def flatten_nested(s, d):
    """Features of every type and depth as text."""
    value = lambda x: F.regexp_extract(F.to_json(F.create_map(F.lit("v"), F.col(x))), r'^\{"v":(.*)\}$', 1)
    size = F.col("p_size").cast("string")
    doc = F.concat(
        F.lit('{"name": '), value("p_name"), F.lit(', "size": '), size, F.lit(', "large": '), (F.col("p_size") > 25).cast("string"), F.lit(', "half": '), (F.col("p_size") / 2.0).cast("string"),
        F.lit(', "none": null, "like_json": "[1, 2]", "tags": ['), value("p_brand"), F.lit(', {"y": '), size, F.lit('}, null, true], "deep": {"a": {"b": {"c": {"d": '), size, F.lit('}}}, "e": []}}'),
    )
    return s.read.parquet(f"{d}/part.parquet").select("p_partkey", T.flattened(preprocess.feature_texts(doc)).alias("node_attr"))


@query(
    """
SELECT vec_id AS node_idx, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS total,
       round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 5) AS norm, 256 AS bytes
FROM embeddings WHERE vec_id % 100 = 0"""
)
def vector_store_gather(s, d):
    """All embeddings written to a store of fixed stride; the vectors of a sample of ids read from it, one read each."""
    path = scratch(s, "vectors")
    vectors.write(s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("node_idx"), F.col("embedding").alias("x")), path, 64, "float32", segment=20_000)
    ids = s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("node_idx")).filter("node_idx % 100 = 0")
    got = vectors.gather(ids, path, s)
    x = F.col("x").cast("array<double>")
    return got.select("node_idx", F.round(F.aggregate(x, F.lit(0.0), lambda a, b: a + b), 5).alias("total"), F.round(V.norm(x), 5).alias("norm"), F.col("read").cast("int").alias("bytes"))


@query("SELECT raw_index, item_id, text FROM (SELECT row_number() OVER (ORDER BY item_id) - 1 AS raw_index, item_id, text FROM benchmark) WHERE raw_index % 7 = 3")
def jsonl_random_access(s, d):
    """The benchmark as JSON lines; every seventh record by its offset, a read each."""
    path = scratch(s, "lines")
    items = s.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text")
    files.write_jsonl(items.repartitionByRange(4, "item_id").sortWithinPartitions("item_id"), path)
    offsets = files.jsonl_offsets(s, path)
    wanted = offsets.select("raw_index").filter("raw_index % 7 = 3")
    return files.jsonl_records(wanted, offsets, "item_id long, text string").select("raw_index", "item_id", "text")


@query(
    """
SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN p_name || ' (part_nodes)' WHEN 1 THEN p_brand || ' (part_nodes)' WHEN 2 THEN p_type || ' (part_nodes)' WHEN 3 THEN p_brand || ' (part_nodes)'
       ELSE 'part_nodes:part:' || p_partkey END AS display
FROM part"""
)
def display_names_by_key(s, d):
    """Parts named by the first of five features that is a text and not blank."""
    value = lambda x: F.regexp_extract(F.to_json(F.create_map(F.lit("v"), F.col(x))), r'^\{"v":(.*)\}$', 1)
    docs = [
        F.concat(F.lit('{"title": "other", "name": '), value("p_name"), F.lit("}")),
        F.concat(F.lit('{"name": "  ", "title": '), value("p_brand"), F.lit("}")),
        F.concat(F.lit('{"name": 7, "title": ["x"], "label": '), value("p_type"), F.lit("}")),
        F.concat(F.lit('{"display_name": "other", "term": '), value("p_brand"), F.lit("}")),
        F.concat(F.lit('{"name": "part:'), F.col("p_partkey").cast("string"), F.lit('", "display_name": "other"}')),
        F.lit('{"size": 3}'),
    ]
    doc = F.get(F.array(*docs), (F.col("p_size") % 6).cast("int"))
    name = T.display_name(doc, F.lit("part_nodes"), F.concat(F.lit("part:"), F.col("p_partkey").cast("string")))
    return s.read.parquet(f"{d}/part.parquet").select("p_partkey", name.alias("display"))


@query()
def conversation_layout(s, d):
    """Every user's turn and the answer to it as a decoder input, a conversation a batch: its length, padding, where the
    graph's span begins, and how many ids are answered for."""
    c = s.read.parquet(f"{d}/conversations.parquet")
    u = c.filter("role = 'user'").select(F.col("conv_id").alias("batch"), F.col("turn").alias("id"), F.col("text").alias("question"))
    a = c.filter("role = 'assistant'").select(F.col("conv_id").alias("batch"), (F.col("turn") - 1).alias("id"), F.col("text").alias("label"))
    x = u.join(a, ["batch", "id"]).withColumns({"desc": F.lit(""), "graph_tokens": (F.col("id") % 5).cast("int")})
    y = text_layout(x, VOCABULARY, 0, 64, 32)
    pad, answered = F.size(F.filter("attention", lambda v: v == 0)), F.size(F.filter("labels", lambda v: v != IGNORED))
    return y.select(F.col("batch").alias("conv_id"), F.col("id").alias("turn"), F.size("token_ids").alias("length"), pad.alias("padding"), "graph_start", answered.alias("answered"))
