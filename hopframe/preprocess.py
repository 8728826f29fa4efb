"""From a raw graph and its questions to tables: nodes, edges, features, seeds, samples, and a sidecar that seals them.

A raw graph is one JSON document, or a folder of them, of node types, node ids, features and neighbours; a file of any
size is read by many tasks (sources/raw_graph.py). Everything is written as Parquet under one folder, the
sidecar last: a folder without a sidecar that fits it is incomplete and is written anew.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from hopframe.functions import text as T
from hopframe.functions.relations import resolve_relation
from hopframe.operators import graph
from hopframe.operators.splits import ranked
from hopframe.session import checkpointed
from hopframe.sources import raw_graph
from hopframe.sources.checkpoint import read_text, replace_text

#: Seeds kept with a graph; the sanitiser's version, which the sidecar must name.
SEEDS, VERSION = 4096, 1
TABLES = ("nodes", "edges", "features", "seeds")
#: Domains whose features are cleaned before they are joined.
SANITIZED = ("goodreads", "biomedical")


#: An entry as its parts; features stay JSON, in which texts and numbers can be told apart.
ENTRY = "map<string,struct<features:string,neighbors:map<string,variant>>>"


def _printed(v) -> str:
    if isinstance(v, dict):
        return "; ".join(f"{k}: {_printed(x)}" for k, x in v.items())
    return ", ".join(map(str, v)) if isinstance(v, list) else str(v)


@F.arrow_udf(MapType(StringType(), StringType()))
def _printed_features(features: pa.Array) -> pa.Array:
    said = [None if v is None else [(k, _printed(x)) for k, x in json.loads(v).items()] for v in features.to_pylist()]
    return pa.array(said, pa.map_(pa.string(), pa.string()))


def feature_texts(features: Column) -> Column:
    """Features (a JSON object) as name to text: lists joined by commas, objects as name: value to any depth, the items
    of lists, numbers, truth values and nulls as Python prints them. Objects of plain texts stay in the engine.
    """
    kinds = F.map_values(F.from_json(features, "map<string,variant>"))
    plain = ~F.exists(kinds, lambda v: v.isNull() | (F.schema_of_variant(v) != "STRING"))
    return F.when(plain, F.from_json(features, "map<string,string>")).otherwise(_printed_features(F.when(~plain, features)))


def read_raw(spark: SparkSession, path: str, domain: str) -> DataFrame:
    """file, at, type_pos, node_type, node_id, text, neighbors (relation to ids) of every entry; a malformed document is
    an error."""
    name = F.get_json_object(F.concat(F.lit('{"t":'), F.col("node_type"), F.lit("}")), "$.t").alias("node_type")
    entry = F.from_json(F.concat(F.lit("{"), "entry", F.lit("}")), ENTRY, {"mode": "FAILFAST"})
    x = raw_graph.entries(spark, path).select("file", "at", "type_pos", name, F.explode(entry).alias("node_id", "info"))
    x = x.select("file", "at", "type_pos", "node_type", "node_id", F.coalesce("info.features", F.lit("{}")).alias("f"), "info.neighbors")
    if domain.lower() in SANITIZED:
        clean = F.transform_values(T.sanitized_features(F.from_json("f", "map<string,string>"), F.lit(domain)), lambda k, v: F.coalesce(v, F.lit("None")))
    else:
        clean = feature_texts(F.col("f"))
    ids = lambda k, v: F.when(F.schema_of_variant(v).startswith("OBJECT"), F.map_keys(F.variant_get(v, "$", "map<string,variant>"))).otherwise(F.variant_get(v, "$", "array<string>"))
    return x.select("file", "at", "type_pos", "node_type", "node_id", T.flattened(clean).alias("text"), F.transform_values("neighbors", ids).alias("neighbors"))


def graph_tables(spark: SparkSession, path: str, domain: str) -> tuple[DataFrame, DataFrame]:
    """The node and edge tables. Nodes are numbered type by type in the order the types and nodes come in; neighbours
    are a list or an object's names; those that resolve to no node are dropped. The document is parsed once."""
    raw = checkpointed(read_raw(spark, path, domain))
    first = raw.groupBy("node_type").agg(F.min(F.struct("file", "type_pos")).alias("_first"))  # a row a type
    types = F.array(*(F.lit(r[0]) for r in first.orderBy("_first").collect()))
    nodes = ranked(raw.join(F.broadcast(first), "node_type"), ["_first", "file", "at"], "node_idx")
    nodes = nodes.select("node_idx", "node_id", "node_type", F.concat(F.lit("type="), F.col("node_type"), F.lit("; "), "text").alias("node_attr"), "neighbors")
    out = nodes.select(F.col("node_idx").alias("src_idx"), F.col("node_id").alias("src_id"), "node_type", F.explode("neighbors").alias("edge_attr", "ids"))
    out = out.select("src_idx", "src_id", resolve_relation(F.col("edge_attr"), F.col("node_type"), types).alias("dst_type"), "edge_attr", F.explode("ids").alias("dst_id"))
    far = nodes.select(F.col("node_type").alias("dst_type"), F.col("node_id").alias("dst_id"), F.col("node_idx").alias("dst_idx"))
    return nodes.drop("neighbors"), out.join(far, ["dst_type", "dst_id"]).select("src_idx", "dst_idx", "src_id", "dst_id", "edge_attr")


def read_meta(spark: SparkSession, out: str) -> dict:
    """The sidecar; one that is missing or unreadable is empty."""
    try:
        found = json.loads(read_text(spark, f"{out}/meta.json") or "{}")
        return found if isinstance(found, dict) else {}
    except ValueError:
        return {}


def _counts(spark: SparkSession, out: str) -> dict[str, int] | None:
    try:
        return {t: spark.read.parquet(f"{out}/{t}").count() for t in TABLES}
    except AnalysisException:
        return None


def complete(spark: SparkSession, out: str, **wanted) -> bool:
    """Whether the tables are all there, hold nodes, and edges if there are several nodes, in the sidecar's numbers,
    under the sanitiser of today and the given settings."""
    meta, n = read_meta(spark, out), _counts(spark, out)
    if not meta or n is None or meta.get("version") != VERSION or any(meta.get(k) != v for k, v in wanted.items()):
        return False
    full = n["nodes"] >= 1 and (n["edges"] > 0 or n["nodes"] == 1)
    return full and n["nodes"] == n["features"] == meta.get("node_count") and n["edges"] == meta.get("edge_count")


def build(spark: SparkSession, graph_path: str, data_path: str | None, out: str, domain: str, dim: int = 16, reuse: bool = True) -> dict:
    """Writes the tables under `out` and returns the sidecar; what is there is kept if it is complete and fits."""
    if dim < 8:
        raise ValueError("the features need at least 8 numbers")
    wanted = {"domain": domain, "dim": dim, "graph": graph_path}
    if reuse and complete(spark, out, **wanted):
        return read_meta(spark, out)
    # the old sidecar goes first: while tables are being written, nothing may call the folder complete
    replace_text(spark, f"{out}/meta.json", "{}")
    nodes, edges = graph_tables(spark, graph_path, domain)
    nodes.write.mode("overwrite").parquet(f"{out}/nodes")
    nodes = spark.read.parquet(f"{out}/nodes")
    codes = graph.sorted_codes(edges, "edge_attr", "edge_type")
    edges.join(F.broadcast(codes), "edge_attr").select("src_idx", "dst_idx", "src_id", "dst_id", "edge_attr", "edge_type").write.mode("overwrite").parquet(f"{out}/edges")
    edges = spark.read.parquet(f"{out}/edges")
    graph.light_features(nodes, edges, dim).select("node_idx", "x").write.mode("overwrite").parquet(f"{out}/features")
    n = nodes.count()
    seeds = nodes.select(F.col("node_idx").alias("ord"), "node_idx") if n <= SEEDS else graph.top_by_degree(nodes, edges, SEEDS).select("ord", "node_idx")
    seeds.write.mode("overwrite").parquet(f"{out}/seeds")
    samples = 0
    if data_path is not None:
        from hopframe.sources.files import indexed_jsonl

        indexed_jsonl(spark, data_path, "qid string, question string, answer string, path array<string>").write.mode("overwrite").parquet(f"{out}/samples")
        samples = spark.read.parquet(f"{out}/samples").count()
    kinds = sorted(r[0] for r in nodes.select("node_type").distinct().collect())  # type names
    meta = {**wanted, "version": VERSION, "node_count": n, "edge_count": edges.count(), "samples": samples, "node_types": kinds, "edge_types": sorted(r[0] for r in edges.select("edge_attr").distinct().collect())}
    replace_text(spark, f"{out}/meta.json", json.dumps(meta, sort_keys=True))
    return read_meta(spark, out)


def load(spark: SparkSession, out: str, **wanted) -> tuple[dict[str, DataFrame], dict]:
    """The tables of a folder, with the samples where it has them, and its sidecar. A folder that is not complete, or was
    built under other settings, is an error."""
    if not complete(spark, out, **wanted):
        raise ValueError(f"{out} holds no complete tables" + (f" of {wanted}" if wanted else ""))
    meta = read_meta(spark, out)
    names = (*TABLES, *(("samples",) if meta.get("samples") else ()))
    return {t: spark.read.parquet(f"{out}/{t}") for t in names}, meta


BUILDERS: dict[str, Callable[..., dict]] = {"graph": build}


def builder(name: str) -> Callable[..., dict]:
    if name not in BUILDERS:
        raise ValueError(f"no such builder: {name}; there are: {', '.join(sorted(BUILDERS))}")
    return BUILDERS[name]
