"""Split, filter and description queries, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopframe.operators import describe, splits
from hopframe.plans.graph_queries import _SAMPLE, _labelled, _ROLES, hash_sql, hop_records, rec, seeds
from hopframe.plans.qa_queries import PR, predictions
from hopframe.sources.testgraph import edges, nodes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


@query(PR + "SELECT id, family FROM g WHERE family IN ('author_lookup', 'venue_lookup', 'collab_rank', 'citation_rank', 'graph_lookup', 'other')")
def task_filter_entity(s, d):
    from hopframe.functions.text import task_family

    return splits.task_filtered(predictions(s, d), "entity").select("id", task_family(F.col("question")).alias("family"))


@query(PR + "SELECT id FROM g WHERE family = 'path_witness'")
def task_filter_witness_domain(s, d):
    return splits.task_filtered(predictions(s, d), "hop", "x_path_witness").select("id")


@query(
    PR + """, k AS (SELECT id AS raw_index, row_number() OVER (ORDER BY id) - 1 AS sample_index FROM g WHERE family = 'hop'),
    li AS (SELECT id AS raw_index, CASE WHEN (id // 7) % 3 = 0 THEN 'train' WHEN (id // 7) % 3 = 1 THEN 'val' ELSE 'test' END AS split FROM g WHERE family = 'hop')
    SELECT split, sample_index FROM li JOIN k USING (raw_index)"""
)
def split_explicit_checked(s, d):
    kept = splits.numbered(splits.task_filtered(predictions(s, d), "hop").select(F.col("id").alias("raw_index")), "raw_index", "sample_index")
    turn = F.floor(F.col("raw_index") / 7) % 3
    listed = kept.select("raw_index", F.when(turn == 0, "train").when(turn == 1, "val").otherwise("test").alias("split"))
    return splits.explicit_split(listed, kept, kept.count())


def _turn_sql(name: str, before: str, target: str) -> str:
    return f"""{name}_r AS (SELECT *, CASE WHEN sum(lft) OVER () > 0 THEN lft * {target} / CAST(sum(lft) OVER () AS DOUBLE) ELSE 0 END AS raw FROM {before}),
    {name}_b AS (SELECT *, least(lft, floor(raw)) AS base FROM {name}_r),
    {name}_t AS (SELECT *, CAST(base + CASE WHEN row_number() OVER (ORDER BY base < lft DESC, raw - base DESC, lft - base DESC, k DESC) <= {target} - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS {name} FROM {name}_b),
    {name}_x AS (SELECT * EXCLUDE (raw, base) REPLACE (lft - {name} AS lft) FROM {name}_t)"""


@query(
    "WITH e AS (SELECT event_id AS id, event_type AS k FROM events), z AS (SELECT count(*) AS n FROM e), c AS (SELECT k, count(*) AS lft FROM e GROUP BY 1), "
    + _turn_sql("train", "c", "(SELECT CAST(floor(n * 0.7) AS BIGINT) FROM z)") + ", " + _turn_sql("val", "train_x", "(SELECT CAST(floor(n * 0.1) AS BIGINT) FROM z)")
    + ", r AS (SELECT e.*, row_number() OVER (PARTITION BY k ORDER BY " + hash_sql("id", 9) + ", id) AS rn FROM e) "
    "SELECT id, CASE WHEN rn <= train THEN 'train' WHEN rn <= train + val THEN 'val' ELSE 'test' END AS split FROM r JOIN val_x USING (k)"
)
def split_stratified(s, d):
    e = s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), "event_type")
    n = e.count()
    a, b = n * 7 // 10, n // 10
    return splits.stratified_split(e, "id", "event_type", (a, b, n - a - b), 9)


@query("SELECT event_id AS id, CAST(event_id % 3 AS INTEGER) AS rank, event_id < count(*) OVER () // 3 * 3 AS read FROM events")
def epoch_shards(s, d):
    e = s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"))
    rank, read = splits.epoch_shard(F.col("id"), 3, e.count(), drop_last=True)
    return e.select("id", rank.alias("rank"), read.alias("read"))


@query("SELECT sum(CAST(event_id % 10 < 6 AS BIGINT)) AS train, sum(CAST(event_id % 10 IN (6, 7) AS BIGINT)) AS val, sum(CAST(event_id % 10 > 7 AS BIGINT)) AS test FROM events")
def split_mask_counts(s, d):
    i = F.col("event_id") % 10
    masks = s.read.parquet(f"{d}/events.parquet").select((i < 6).alias("train"), i.isin(6, 7).alias("val"), (i > 7).alias("test"))
    return masks.agg(*(F.sum(F.col(c).cast("long")).alias(c) for c in ("train", "val", "test")))


_MON = "m AS (SELECT event_id // 50 AS step, round(avg(CAST(event_id % 3 = 0 OR value > 60 AS INTEGER)), 6) AS em FROM events GROUP BY 1)"


@query("WITH " + _MON + ", f AS (SELECT * FROM m WHERE step > 0 AND step % 2 = 0) SELECT step, em, coalesce(em > max(em) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS better FROM f")
def monitor_steps(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    m = e.groupBy(F.floor(F.col("event_id") / 50).alias("step")).agg(F.round(F.avg(((F.col("event_id") % 3 == 0) | (F.col("value") > 60)).cast("int")), 6).alias("em"))
    return splits.monitor_steps(m, 2)


@query(rec("SELECT q.qid, q.node_idx, (SELECT 1) IS NULL AS found FROM (SELECT qid, node_idx + 18000 AS node_idx FROM qs) q WHERE q.node_idx NOT IN (SELECT node_idx FROM gn)", *_SAMPLE))
def missing_metadata(s, d):
    """Needed ids that the node table lacks: seeds shifted out of it."""
    need = seeds(hop_records(s, d)).select("qid", (F.col("node_idx") + 18000).alias("node_idx"))
    return describe.missing(need, nodes(s, d), "node_idx").withColumn("found", F.lit(False))


@query(rec("SELECT qid, local_idx, node_idx, CASE WHEN role < 2 THEN role END AS mask FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY node_idx) - 1 AS local_idx FROM rl)", *_ROLES))
def local_ids_and_role_masks(s, d):
    lab = _labelled(s, d)
    ends = lab.filter("role < 2").groupBy("qid").agg(F.min(F.when(F.col("role") == 0, F.col("node_idx"))).alias("src"), F.min(F.when(F.col("role") == 1, F.col("node_idx"))).alias("dst"))
    local = describe.local_ids(lab.select("qid", "node_idx"))
    x = describe.role_masks(local, ends.select("qid", F.array("src", "dst").alias("query_nodes")))
    return x.select("qid", F.col("local_idx").cast("long").alias("local_idx"), "node_idx", F.when(F.col("is_src"), 0).when(F.col("is_dst"), 1).alias("mask"))


_EDGES_IN = "ie AS (SELECT s.qid, e.src_idx, e.dst_idx, e.edge_attr, row_number() OVER (PARTITION BY s.qid ORDER BY e.src_idx, e.dst_idx, e.edge_attr) AS rn FROM rl s JOIN se e ON e.src_idx = s.node_idx JOIN rl t ON t.qid = s.qid AND t.node_idx = e.dst_idx)"


@query(rec("SELECT qid, src_idx, dst_idx, edge_attr FROM ie WHERE rn <= greatest(4, 4 * 3)", *_ROLES, _EDGES_IN))
def induced_edges_in_budget(s, d):
    return describe.budgeted_edges(_labelled(s, d).select("qid", "node_idx"), edges(s, d, True), 3)


@query(
    rec(
        """SELECT n.qid, 'nodes:' || chr(10) || n.t || coalesce(chr(10) || 'edges:' || chr(10) || e.t, '') AS description
        FROM (SELECT rl.qid, string_agg(rl.node_idx || ',' || g.node_attr, chr(10) ORDER BY rl.node_idx) AS t FROM
                (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY node_idx) AS k FROM rl) rl JOIN gn g ON g.node_idx = rl.node_idx WHERE rl.k <= 3 GROUP BY 1) n
        LEFT JOIN (SELECT qid, string_agg(src_idx || ',' || edge_attr || ',' || dst_idx, chr(10) ORDER BY src_idx, dst_idx, edge_attr) AS t FROM ie WHERE rn <= 12 GROUP BY 1) e ON e.qid = n.qid""",
        *_ROLES, _EDGES_IN,
    )
)
def sampled_nodes_desc(s, d):
    return describe.sampled_nodes(_labelled(s, d).select("qid", "node_idx"), nodes(s, d, True), edges(s, d, True), 3)


@query(
    "WITH r AS (SELECT event_id AS id, event_id % 5 AS src, CASE WHEN event_id % 4 = 0 THEN [event_id % 3 + 1.0::DOUBLE, 2.0::DOUBLE] END AS attr, CAST(event_id % 3 AS INTEGER) AS edge_type FROM events) "
    "SELECT id, array_to_string(list_transform(coalesce(attr, CASE WHEN edge_type < 2 THEN [edge_type * 1.0::DOUBLE, 0.5::DOUBLE] END), lambda x: CAST(x AS DECIMAL(9, 2))), ' ') AS attr FROM r"
)
def edge_attr_gather(s, d):
    i = F.col("event_id")
    rows = s.read.parquet(f"{d}/events.parquet").select(i.alias("id"), F.when(i % 4 == 0, F.array(i % 3 + F.lit(1.0), F.lit(2.0))).alias("edge_attr"), (i % 3).cast("int").alias("edge_type"))
    types = s.createDataFrame([(0, [0.0, 0.5]), (1, [1.0, 0.5])], "edge_type int, vector array<double>")
    x = describe.edge_features(rows, types)
    return x.select("id", F.array_join(F.transform("features", lambda v: v.cast("decimal(9,2)").cast("string")), " ").alias("attr"))


@query("SELECT event_id - 1 AS raw_index, event_id AS id FROM (SELECT row_number() OVER (ORDER BY event_id) AS event_id FROM events)")
def jsonl_index(s, d):
    """Rows of a JSONL file with blank lines by their place among the others."""
    from hopframe.session import scratch
    from hopframe.sources.files import indexed_jsonl

    path = scratch(s, "jsonl")
    e = splits.numbered(s.read.parquet(f"{d}/events.parquet"), "event_id", "k")
    # a file a range of the order, so the files' names are in its order too
    lines = e.repartitionByRange("k").sortWithinPartitions("k").select(F.concat(F.lit('{"id": '), (F.col("k") + 1).cast("string"), F.lit("}\n ")).alias("value"))
    lines.write.text(path)
    return indexed_jsonl(s, path, "id long")
