"""Graph queries over the star schema read as a graph, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopframe.functions.hashing import h
from hopframe.functions.relations import resolve_relation
from hopframe.operators import graph, hopqa
from hopframe.sources.testgraph import edges, nodes, undirected

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NODES = """
o AS (SELECT (SELECT count(*) FROM region) AS a, (SELECT count(*) FROM nation) AS b, (SELECT count(*) FROM supplier) AS c, (SELECT count(*) FROM customer) AS d, (SELECT count(*) FROM part) AS e),
gn AS (
  SELECT CAST(r_regionkey AS BIGINT) AS node_idx, 'region:' || r_regionkey AS node_id, 'region_nodes' AS node_type, 'type=region_nodes; name: ' || r_name AS node_attr FROM region
  UNION ALL SELECT a + n_nationkey, 'nation:' || n_nationkey, 'nation_nodes', 'type=nation_nodes; name: ' || n_name FROM nation, o
  UNION ALL SELECT a + b + s_suppkey, 'supplier:' || s_suppkey, 'supplier_nodes', 'type=supplier_nodes; name: ' || s_name FROM supplier, o
  UNION ALL SELECT a + b + c + c_custkey, 'customer:' || c_custkey, 'customer_nodes', 'type=customer_nodes; name: ' || c_name FROM customer, o
  UNION ALL SELECT a + b + c + d + p_partkey, 'part:' || p_partkey, 'part_nodes', 'type=part_nodes; name: ' || p_name FROM part, o
  UNION ALL SELECT a + b + c + d + e + o_orderkey, 'orders:' || o_orderkey, 'order_nodes', 'type=order_nodes; ' FROM orders, o),
sn AS (SELECT * FROM gn WHERE node_type IN ('region_nodes', 'nation_nodes', 'supplier_nodes', 'customer_nodes'))"""
EDGES = """,
se AS (
  SELECT a + n_nationkey AS src_idx, CAST(n_regionkey AS BIGINT) AS dst_idx, 'nation:' || n_nationkey AS src_id, 'region:' || n_regionkey AS dst_id, 'region' AS edge_attr FROM nation, o
  UNION ALL SELECT a + b + c + c_custkey, a + c_nationkey, 'customer:' || c_custkey, 'nation:' || c_nationkey, 'nation' FROM customer, o
  UNION ALL SELECT a + b + s_suppkey, a + s_nationkey, 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'nation' FROM supplier, o),
ge AS (
  SELECT * FROM se
  UNION ALL SELECT a + b + c + d + e + o_orderkey, a + b + c + o_custkey, 'orders:' || o_orderkey, 'customer:' || o_custkey, 'customer' FROM orders, o
  UNION ALL SELECT a + b + c + d + e + l_orderkey, a + b + c + d + l_partkey, 'orders:' || l_orderkey, 'part:' || l_partkey, 'part' FROM lineitem, o
  UNION ALL SELECT a + b + c + d + e + l_orderkey, a + b + l_suppkey, 'orders:' || l_orderkey, 'supplier:' || l_suppkey, 'supplier' FROM lineitem, o),
su AS (SELECT src_idx AS u, dst_idx AS v FROM se UNION ALL SELECT dst_idx, src_idx FROM se),
gdeg AS (SELECT n.node_idx, n.node_type, coalesce(i.c, 0) AS in_deg, coalesce(q.c, 0) AS out_deg, coalesce(i.c, 0) + coalesce(q.c, 0) AS total_deg FROM gn n
  LEFT JOIN (SELECT dst_idx, count(*) AS c FROM ge GROUP BY 1) i ON i.dst_idx = n.node_idx LEFT JOIN (SELECT src_idx, count(*) AS c FROM ge GROUP BY 1) q ON q.src_idx = n.node_idx),
sdeg AS (SELECT n.node_idx, n.node_type, coalesce(i.c, 0) + coalesce(q.c, 0) AS total_deg, coalesce(q.c, 0) AS out_deg FROM sn n
  LEFT JOIN (SELECT dst_idx, count(*) AS c FROM se GROUP BY 1) i ON i.dst_idx = n.node_idx LEFT JOIN (SELECT src_idx, count(*) AS c FROM se GROUP BY 1) q ON q.src_idx = n.node_idx)"""


def hash_sql(x: str, seed: int) -> str:
    y = f"((({x}) * 1327217885 + {seed} * 69621 + 12345) % 2147483647)"
    return f"(({y} * ({y} % 65521 + 1)) % 2147483647)"


def hash2_sql(a: str, b: str, seed: int) -> str:
    return hash_sql(f"{hash_sql(a, seed)} + {b}", seed)


#: Ten anchors for breadth-first queries, and their levels up to four hops.
ANCHORS = "ka AS (SELECT node_idx FROM sn WHERE node_type = 'customer_nodes' ORDER BY " + hash_sql("node_idx", 3) + ", node_idx LIMIT 10)"
LEVELS = "bw(src, node, d) AS (SELECT node_idx, node_idx, 0 FROM {0} UNION SELECT bw.src, su.v, bw.d + 1 FROM bw JOIN su ON bw.node = su.u WHERE bw.d < {1}),\nlv AS (SELECT src, node, min(d) AS d FROM bw GROUP BY src, node)"


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def rec(body: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + NODES.strip() + EDGES + "".join(",\n" + c for c in ctes) + "\n" + body


@query("WITH " + NODES + " SELECT * FROM gn")
def graph_nodes(s, d):
    return nodes(s, d)


@query(rec("SELECT * FROM ge"))
def graph_edges(s, d):
    return edges(s, d)


#: relation, source type, target among paper_nodes, author_nodes, venue_nodes, Disease_nodes and genes_nodes.
_RELATIONS = (
    ("author", "paper_nodes", "author_nodes"), ("cited_by", "paper_nodes", "paper_nodes"), ("reference", "paper_nodes", "paper_nodes"), ("venue", "paper_nodes", "venue_nodes"),
    ("papers", "author_nodes", "paper_nodes"), ("paper_nodes", "author_nodes", "paper_nodes"), ("paper-writes-author", "paper_nodes", "author_nodes"), ("unknown", "paper_nodes", None),
    ("Author", "paper_nodes", None), ("Disease-x-gene", "Disease_nodes", "genes_nodes"), ("Disease - has - gene", "genes_nodes", "Disease_nodes"), ("disease-x-gene", "Disease_nodes", None),
    ("a-b", "paper_nodes", None), ("paper--cites--cited_by", "paper_nodes", "paper_nodes"),
)


@query(
    "WITH r AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{r}', '{t}', " + (f"'{x}'" if x else "NULL") + ")" for i, (r, t, x) in enumerate(_RELATIONS)) + ") t(i, relation, source_type, target_type))\n"
    f"SELECT relation, source_type, target_type, count(*) AS n FROM events JOIN r ON r.i = user_id % {len(_RELATIONS)} GROUP BY 1, 2, 3"
)
def relation_resolution(s, d):
    """Events as uses of relations, each user with one of them; the use of every relation and where it leads."""
    used = F.get(F.array(*(F.struct(F.lit(r).alias("relation"), F.lit(t).alias("source_type")) for r, t, _ in _RELATIONS)), (F.col("user_id") % len(_RELATIONS)).cast("int"))
    rows = s.read.parquet(f"{d}/events.parquet").select(used.alias("u")).select("u.*")
    types = F.array(*(F.lit(f"{t}_nodes") for t in ("paper", "author", "venue", "Disease", "genes")))
    return rows.groupBy("relation", "source_type").agg(F.count("*").alias("n")).withColumn("target_type", resolve_relation(F.col("relation"), F.col("source_type"), types))


@query("WITH " + NODES + " SELECT node_type, CAST(row_number() OVER (ORDER BY node_type) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT node_type FROM gn)")
def type_codes_sorted(s, d):
    return graph.sorted_codes(nodes(s, d), "node_type")


@query("WITH " + NODES + " SELECT node_type, min(node_idx) AS first_pos, CAST(row_number() OVER (ORDER BY min(node_idx)) - 1 AS INTEGER) AS code FROM gn GROUP BY node_type")
def type_codes_first_seen(s, d):
    return graph.first_seen_codes(nodes(s, d), "node_type", "node_idx")


@query(rec("SELECT edge_attr, count(*) AS n, CAST(row_number() OVER (ORDER BY edge_attr) - 1 AS INTEGER) AS code FROM ge GROUP BY edge_attr"))
def edge_type_histogram(s, d):
    n = edges(s, d).groupBy("edge_attr").agg(F.count("*").alias("n"))
    return n.withColumn("code", (F.row_number().over(Window.orderBy("edge_attr")) - 1).cast("int"))


@query(rec("SELECT (SELECT count(*) FROM gn) AS node_count, (SELECT string_agg(DISTINCT node_type, ',' ORDER BY node_type) FROM gn) AS node_types, (SELECT count(*) FROM ge) AS edge_count, true AS valid"))
def node_stream_info(s, d):
    n = nodes(s, d).agg(F.count("*").alias("node_count"), F.array_join(F.array_sort(F.collect_set("node_type")), ",").alias("node_types"))
    e = edges(s, d).agg(F.count("*").alias("edge_count"))
    return n.join(F.broadcast(e), how="cross").withColumn("valid", (F.col("node_count") > 0) & ((F.col("edge_count") > 0) | (F.col("node_count") <= 1)))  # one row each


@query(rec("SELECT node_idx, in_deg, out_deg, total_deg FROM gdeg"))
def degree_table(s, d):
    return graph.degrees(nodes(s, d), edges(s, d))


@query(rec("SELECT g.node_idx, c.code, round(ln(1 + in_deg), 6) AS l_in, round(ln(1 + out_deg), 6) AS l_out, round(ln(1 + total_deg), 6) AS l_total, CAST(in_deg > 0 AS DOUBLE) AS has_in, CAST(out_deg > 0 AS DOUBLE) AS has_out, 16 AS dim, 1.0::DOUBLE AS hot FROM gdeg g JOIN c USING (node_type)", "c AS (SELECT node_type, CAST(row_number() OVER (ORDER BY node_type) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT node_type FROM gn))"))
def light_features(s, d):
    x = graph.light_features(nodes(s, d), edges(s, d))
    at = lambda i: F.element_at("x", i)
    return x.select("node_idx", "code", *(F.round(at(7 + k), 6).alias(c) for k, c in enumerate(("l_in", "l_out", "l_total"))), at(10).alias("has_in"), at(11).alias("has_out"), F.size("x").alias("dim"), F.element_at("x", F.col("code") + 1).alias("hot"))


@query(rec("SELECT src_idx AS u, dst_idx AS v FROM ge UNION ALL SELECT dst_idx, src_idx FROM ge"))
def undirected_edges(s, d):
    return undirected(edges(s, d))


@query("SELECT 'nation:' || c_nationkey AS node_id, count(DISTINCT c_custkey) AS n, string_agg(DISTINCT 'customer:' || c_custkey, ',' ORDER BY 'customer:' || c_custkey) AS neighbors FROM customer GROUP BY c_nationkey")
def pubmed_style_neighbors(s, d):
    c = s.read.parquet(f"{d}/customer.parquet").select("c_nationkey", F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("x"))
    g = c.groupBy("c_nationkey").agg(F.array_sort(F.collect_set("x")).alias("x"))
    return g.select(F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")).alias("node_id"), F.size("x").cast("long").alias("n"), F.array_join("x", ",").alias("neighbors"))


@query(rec("SELECT src_idx, dst_idx FROM se WHERE src_idx IN (SELECT node_idx FROM k) AND dst_idx IN (SELECT node_idx FROM k)", "k AS (SELECT node_idx FROM sn ORDER BY " + hash_sql("node_idx", 11) + ", node_idx LIMIT 800)"))
def induced_edges(s, d):
    k = nodes(s, d, True).select("node_idx").orderBy(h("node_idx", 11), "node_idx").limit(800)
    e = edges(s, d, True).select("src_idx", "dst_idx")
    return e.join(k.withColumnRenamed("node_idx", "src_idx"), "src_idx", "left_semi").join(k.withColumnRenamed("node_idx", "dst_idx"), "dst_idx", "left_semi").select("src_idx", "dst_idx")


def _normalized(s, d, binary: bool):
    e = edges(s, d, binary).select(F.col("src_idx").alias("u"), F.col("dst_idx").alias("v"))
    loops = nodes(s, d, binary).select(F.col("node_idx").alias("u"), F.col("node_idx").alias("v"), F.lit(1).alias("c"))
    return graph.normalized(e.withColumn("c", F.when(F.col("u") == F.col("v"), 2).otherwise(1)).unionByName(loops), binary)


_NORM = "SELECT a.u, a.v, round(a.w / sqrt(p.d * q.d), 6) AS w FROM a JOIN dg p ON p.u = a.u JOIN dg q ON q.u = a.v"


@query(rec(_NORM, "a AS (SELECT u, v, 1.0::DOUBLE AS w FROM (SELECT u, v FROM su UNION SELECT node_idx, node_idx FROM sn))", "dg AS (SELECT u, sum(w) AS d FROM a GROUP BY u)"))
def normalized_adjacency_binary(s, d):
    return _normalized(s, d, True)


@query(rec(_NORM, "a AS (SELECT u, v, CAST(count(*) AS DOUBLE) AS w FROM (SELECT src_idx AS u, dst_idx AS v FROM ge UNION ALL SELECT dst_idx, src_idx FROM ge UNION ALL SELECT node_idx, node_idx FROM gn) GROUP BY u, v)", "dg AS (SELECT u, sum(w) AS d FROM a GROUP BY u)"))
def normalized_adjacency_weighted(s, d):
    return _normalized(s, d, False)


@query(rec("SELECT row_number() OVER (ORDER BY total_deg DESC, node_idx) - 1 AS ord, node_idx FROM gdeg ORDER BY total_deg DESC, node_idx LIMIT 500"))
def persisted_seeds(s, d):
    return graph.top_by_degree(nodes(s, d), edges(s, d), 500)


@query(rec("SELECT row_number() OVER (ORDER BY t, o2) - 1 AS ord, node_idx FROM (SELECT node_idx, min(t) AS t, min_by(o2, t) AS o2 FROM k GROUP BY node_idx) ORDER BY t, o2 LIMIT 64", "k AS (SELECT node_idx, 0 AS t, row_number() OVER (ORDER BY node_idx) AS o2 FROM sn WHERE node_type = 'region_nodes' UNION ALL SELECT node_idx, 1, row_number() OVER (ORDER BY " + hash_sql("node_idx", 5) + ", node_idx) FROM (SELECT node_idx FROM sn WHERE node_type = 'nation_nodes') UNION ALL SELECT node_idx, 2, row_number() OVER (ORDER BY total_deg DESC, node_idx) FROM gdeg)"))
def seed_tiers(s, d):
    n = nodes(s, d)
    rank = lambda *k: F.row_number().over(Window.orderBy(*k))
    tier = lambda df, t: df.select("node_idx", F.lit(t).alias("t"), "o2")
    forced = n.filter("node_type = 'region_nodes'").withColumn("o2", rank("node_idx"))
    asked = n.filter("node_type = 'nation_nodes'").withColumn("o2", rank(h("node_idx", 5), F.col("node_idx")))
    # no more than the budget of the last tier can be used
    rest = graph.degrees(n, edges(s, d)).orderBy(F.desc("total_deg"), "node_idx").limit(64 + 64).withColumn("o2", rank(F.desc("total_deg"), F.col("node_idx")))
    best = tier(forced, 0).unionByName(tier(asked, 1)).unionByName(tier(rest, 2)).groupBy("node_idx").agg(F.min(F.struct("t", "o2")).alias("k"))
    best = best.orderBy("k").limit(64)
    return best.select((F.row_number().over(Window.orderBy("k")) - 1).cast("long").alias("ord"), "node_idx")


@query(rec("SELECT row_number() OVER (ORDER BY rn, node_type) - 1 AS ord, node_idx, node_type FROM (SELECT *, row_number() OVER (PARTITION BY node_type ORDER BY total_deg DESC, node_idx) AS rn FROM gdeg) ORDER BY rn, node_type LIMIT 20"))
def anchor_round_robin(s, d):
    return graph.round_robin_anchors(nodes(s, d), edges(s, d), 20)


@query(rec("SELECT node_idx, " + hash_sql("node_idx", 7) + " AS hash FROM gdeg WHERE total_deg > 0 ORDER BY hash, node_idx LIMIT 1000"))
def reservoir_sources(s, d):
    return hopqa.sources(nodes(s, d), edges(s, d), 1000, 7)


def _anchors(s, d):
    return nodes(s, d, True).filter("node_type = 'customer_nodes'").orderBy(h("node_idx", 3), "node_idx").limit(10).select("node_idx")


@query(rec("SELECT src, node, d FROM lv", ANCHORS, LEVELS.format("ka", 4)))
def bfs_levels(s, d):
    return graph.bfs(_anchors(s, d), undirected(edges(s, d, True)), 4)


@query(rec("SELECT a.node_idx AS anchor, n.node_idx, CAST(CASE WHEN lv.d IS NULL THEN 0 ELSE 4 - least(lv.d, 3) END AS INTEGER) AS proximity FROM ka a CROSS JOIN sn n LEFT JOIN lv ON lv.src = a.node_idx AND lv.node = n.node_idx", ANCHORS, LEVELS.format("ka", 3)))
def anchor_proximity(s, d):
    a = _anchors(s, d)
    return graph.proximity(graph.bfs(a, undirected(edges(s, d, True)), 3), nodes(s, d, True), a, 3)


@query(rec("SELECT src, node AS dst, d AS hop FROM (SELECT *, row_number() OVER (PARTITION BY src, d ORDER BY " + hash_sql("node", 9) + ", node) AS rn FROM lv WHERE d > 0) WHERE rn = 1", ANCHORS, LEVELS.format("ka", 4)))
def exact_hop_pairs(s, d):
    x = graph.bfs(_anchors(s, d), undirected(edges(s, d, True)), 4).filter("d > 0")
    best = x.groupBy("src", "d").agg(F.min(F.struct(h("node", 9).alias("hash"), "node")).alias("b"))
    return best.select("src", F.col("b.node").alias("dst"), F.col("d").alias("hop"))


_PATHS = (
    "pa AS (SELECT l.src, l.node, l.d, min(p.node) AS via FROM lv l JOIN su ON su.v = l.node JOIN lv p ON p.src = l.src AND p.node = su.u AND p.d = l.d - 1 WHERE l.d > 0 GROUP BY 1, 2, 3)",
    "pt(src, node, d, path) AS (SELECT src, node, 0, CAST(node AS VARCHAR) FROM lv WHERE d = 0 UNION ALL SELECT pa.src, pa.node, pa.d, pt.path || ',' || pa.node FROM pt JOIN pa ON pa.src = pt.src AND pa.via = pt.node AND pa.d = pt.d + 1)",
)


@query(rec("SELECT src, node, d AS hop FROM lv WHERE d > 0 AND (SELECT count(*) FROM lv x WHERE x.src = lv.src AND x.d <= lv.d) < 70", ANCHORS, LEVELS.format("ka", 4)))
def exact_hops_within_cap(s, d):
    """What each anchor reaches at levels up to which it has seen fewer than 70 nodes."""
    x = graph.bfs_paths(_anchors(s, d), undirected(edges(s, d, True)), 4, 70)
    return x.select("src", "node", (F.size("path") - 1).alias("hop")).filter("hop > 0")


@query(rec("SELECT src, node, path FROM pt", ANCHORS, LEVELS.format("ka", 4), *_PATHS))
def hop_paths(s, d):
    x = graph.bfs_paths(_anchors(s, d), undirected(edges(s, d, True)), 4)
    return x.select("src", "node", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


#: Questions of the corridor queries: pairs of anchors, with the nodes within two hops of either end.
_PAIRS = (
    "pr AS (SELECT row_number() OVER (ORDER BY node_idx) AS qid, node_idx AS src, lead(node_idx) OVER (ORDER BY node_idx) AS dst FROM ka)",
    "pq AS (SELECT * FROM pr WHERE dst IS NOT NULL)",
    "sb AS (SELECT DISTINCT pq.qid, lv.node AS node_idx FROM pq JOIN lv ON lv.src IN (pq.src, pq.dst) WHERE lv.d <= 2)",
    "sz AS (SELECT qid, count(*) AS n FROM sb GROUP BY qid)",
    # distances within each subgraph; none of these is wider than the bound
    "lk0 AS (SELECT DISTINCT a.qid, su.u, su.v FROM sb a JOIN su ON su.u = a.node_idx JOIN sb b ON b.qid = a.qid AND b.node_idx = su.v)",
    """lw(qid, src, node, d) AS (
      SELECT qid, src, src, 0 FROM pq UNION SELECT qid, dst, dst, 0 FROM pq
      UNION SELECT lw.qid, lw.src, lk0.v, lw.d + 1 FROM lw JOIN lk0 ON lk0.qid = lw.qid AND lk0.u = lw.node WHERE lw.d < 8)""",
    "ll AS (SELECT qid, src, node, min(d) AS d FROM lw GROUP BY 1, 2, 3)",
    "ro AS (SELECT sb.qid, sb.node_idx, pq.src, pq.dst, sz.n, coalesce(a.d, n + 1) AS d_src, coalesce(b.d, n + 1) AS d_dst, c.d AS sd FROM sb JOIN pq USING (qid) JOIN sz USING (qid) LEFT JOIN ll a ON a.qid = sb.qid AND a.src = pq.src AND a.node = sb.node_idx LEFT JOIN ll b ON b.qid = sb.qid AND b.src = pq.dst AND b.node = sb.node_idx LEFT JOIN ll c ON c.qid = sb.qid AND c.src = pq.src AND c.node = pq.dst)",
    "rd AS (SELECT qid, node_idx, src, dst, CAST(d_src AS INTEGER) AS d_src, CAST(d_dst AS INTEGER) AS d_dst, sd IS NULL AS disconnected, CAST(CASE WHEN sd IS NULL OR d_src > n OR d_dst > n THEN -1 ELSE greatest(0, d_src + d_dst - sd) END AS INTEGER) AS delta FROM ro)",
    "rl AS (SELECT qid, node_idx, d_src, d_dst, disconnected, delta, CASE WHEN node_idx = src THEN 0 WHEN node_idx = dst THEN 1 WHEN NOT disconnected AND delta = 0 THEN 2 ELSE 3 END AS role FROM rd)",
)
_ROLES = (ANCHORS, LEVELS.format("ka", 4), *_PAIRS)


def _labelled(s, d):
    a, und = _anchors(s, d), undirected(edges(s, d, True))
    w = Window.orderBy("node_idx")
    pairs = a.select(F.row_number().over(w).cast("long").alias("qid"), F.col("node_idx").alias("src"), F.lead("node_idx").over(w).alias("dst")).filter("dst IS NOT NULL")
    near = graph.bfs(a, und, 2)
    ends = pairs.select("qid", F.explode(F.array("src", "dst")).alias("src"))
    sub = ends.join(near, "src").select("qid", F.col("node").alias("node_idx")).distinct()
    return graph.roles(pairs, und, sub)


@query(rec("SELECT qid, node_idx, d_src, d_dst, disconnected, delta, role FROM rl", *_ROLES))
def corridor_roles(s, d):
    return _labelled(s, d)


@query(rec("SELECT qid, CAST(pos AS INTEGER) AS pos, node_idx, role FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY least(role, 2), CASE WHEN disconnected THEN 0 ELSE delta END, d_src + d_dst, CASE WHEN disconnected THEN 0 ELSE abs(d_src - d_dst) END, node_idx) - 1 AS pos FROM rl) WHERE pos < 32", *_ROLES))
def syntax_order(s, d):
    return graph.syntax_order(_labelled(s, d), 32)


@query(rec("SELECT qid, pos, node_idx FROM (SELECT qid, node_idx, row_number() OVER (PARTITION BY qid ORDER BY " + hash_sql("node_idx", 41) + ", node_idx) - 1 AS pos FROM rl) WHERE pos < 32", *_ROLES))
def token_shuffle(s, d):
    w = Window.partitionBy("qid").orderBy(h("node_idx", 41), "node_idx")
    return _labelled(s, d).select("qid", (F.row_number().over(w) - 1).cast("long").alias("pos"), "node_idx").filter("pos < 32")


@query(rec("SELECT qid, node_idx, least(d_src, 4) AS coarse, least(d_src, 33) AS exact, role * 6 + least(d_src, 4) AS embed_index FROM rl", *_ROLES))
def coarse_distance_buckets(s, d):
    coarse = F.when(F.col("d_src") < 0, 5).otherwise(F.least("d_src", F.lit(4)))
    exact = F.when(F.col("d_src") < 0, 33).otherwise(F.least("d_src", F.lit(33)))
    return _labelled(s, d).select("qid", "node_idx", coarse.alias("coarse"), exact.alias("exact"), (F.col("role") * 6 + coarse).alias("embed_index"))


@query(rec("SELECT qid, node_idx, round(CASE WHEN delta >= 0 THEN exp(-0.5::DOUBLE * delta) ELSE 0 END, 6) AS weight FROM rl", *_ROLES))
def corridor_weights(s, d):
    return _labelled(s, d).select("qid", "node_idx", F.round(F.when(F.col("delta") >= 0, F.exp(-0.5 * F.col("delta"))).otherwise(0.0), 6).alias("weight"))


@query(rec("SELECT count(*) AS n, round(avg(CAST(disconnected AS INTEGER)), 6) AS disconnect_rate FROM rl WHERE role > 1", *_ROLES))
def disconnect_rate(s, d):
    return _labelled(s, d).filter("role > 1").agg(F.count("*").alias("n"), F.round(F.avg(F.col("disconnected").cast("int")), 6).alias("disconnect_rate"))


@query(rec("SELECT qid, 'Nodes: ' || string_agg(gn.node_id, '; ' ORDER BY pos) AS description FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY least(role, 2), CASE WHEN disconnected THEN 0 ELSE delta END, d_src + d_dst, CASE WHEN disconnected THEN 0 ELSE abs(d_src - d_dst) END, node_idx) - 1 AS pos FROM rl) JOIN gn USING (node_idx) WHERE pos < 16 GROUP BY qid", *_ROLES))
def query_desc(s, d):
    x = graph.syntax_order(_labelled(s, d), 16).join(nodes(s, d, True).select("node_idx", "node_id"), "node_idx")
    return x.groupBy("qid").agg(F.concat(F.lit("Nodes: "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node_id"))), lambda r: r["node_id"]), "; ")).alias("description"))


@query(rec("SELECT node_idx, round(out_deg / CAST(greatest((SELECT max(out_deg) FROM gdeg), 1) AS DOUBLE), 6) AS bias FROM gdeg"))
def degree_bias(s, d):
    x = graph.degrees(nodes(s, d), edges(s, d))
    top = x.agg(F.greatest(F.max("out_deg"), F.lit(1)).alias("m"))  # one row
    return x.join(F.broadcast(top), how="cross").select("node_idx", F.round(F.col("out_deg") / F.col("m"), 6).alias("bias"))


@query(
    rec(
        """
SELECT 'full' AS scope, (SELECT count(*) FROM gn) AS n, (SELECT count(*) FROM gn) > 5000 AS disabled,
       CASE WHEN (SELECT count(*) FROM gn) <= 5000 THEN (SELECT count(*) FROM (SELECT DISTINCT src_id, dst_id FROM ge)) END AS edge_pairs
UNION ALL SELECT 'small', (SELECT count(*) FROM sn), (SELECT count(*) FROM sn) > 5000,
       CASE WHEN (SELECT count(*) FROM sn) <= 5000 THEN (SELECT count(*) FROM (SELECT DISTINCT src_id, dst_id FROM se)) END"""
    )
)
def graph_meta_guard(s, d):
    """Pairs of linked nodes of the full and of the small graph, unless a graph has over 5,000 nodes."""
    return graph.guarded_pairs(nodes(s, d), edges(s, d), 5000, "full").unionByName(graph.guarded_pairs(nodes(s, d, True), edges(s, d, True), 5000, "small"))


@query("WITH " + NODES + " SELECT node_idx, CASE WHEN node_attr LIKE '%name: %' THEN split_part(node_attr, 'name: ', 2) || ' (' || replace(node_type, '_nodes', '') || ')' ELSE replace(node_type, '_nodes', '') || ':' || node_id END AS display FROM gn")
def display_names(s, d):
    kind = F.regexp_replace("node_type", "_nodes$", "")
    name = F.nullif(F.trim(F.regexp_extract("node_attr", "name: (.*)$", 1)), F.lit(""))
    return nodes(s, d).select("node_idx", F.coalesce(F.concat(name, F.lit(" ("), kind, F.lit(")")), F.concat(kind, F.lit(":"), F.col("node_id"))).alias("display"))


#: HopQA rows: 40 questions over hops 1 to 4 from 40 sources.
HQ = (
    "hs AS (SELECT node_idx FROM sdeg WHERE total_deg > 0 ORDER BY " + hash_sql("node_idx", 13) + ", node_idx LIMIT 40)",
    LEVELS.format("hs", 4),
    *_PATHS,
    "hr AS (SELECT src, node AS dst, d AS hop, path, row_number() OVER (PARTITION BY d ORDER BY " + hash2_sql("src", "node", 13) + ", src, node) AS rn FROM pt WHERE d > 0)",
    "hq AS (SELECT CAST(hop * 100000 + rn AS BIGINT) AS qid, src, dst, CAST(hop AS INTEGER) AS hop, path, s.node_id AS src_id, t.node_id AS dst_id, CAST(hop AS VARCHAR) AS answer FROM hr JOIN gn s ON s.node_idx = src JOIN gn t ON t.node_idx = dst WHERE rn <= 50 + CAST(hop <= 0 AS INTEGER))",
    "hx AS (SELECT *, replace(replace([" + ", ".join(f"'{t}'" for t in hopqa.TEMPLATES) + "][1 + " + hash_sql("qid", 13) + " % 3], '{a}', src_id), '{b}', dst_id) AS question FROM hq)",
)


def hop_records(s, d):
    e = edges(s, d, True)
    return hopqa.records(nodes(s, d, True), e, undirected(e), 200, 4, 40, 13)


@query(rec("SELECT qid, CAST(t.i AS INTEGER) AS layer, CAST(greatest(1, floor(25 * power(0.7::DOUBLE, t.i))) AS INTEGER) AS fanout FROM hx, range(0, 4) t(i) WHERE t.i < hop", *HQ))
def hsgs_fanouts(s, d):
    """The fan-out of every layer for each HopQA question, as many layers as it has hops."""
    all_ = F.array(*(F.lit(n) for n in graph.fanouts(4, 25, 0.7)))
    return hop_records(s, d).select("qid", F.posexplode(F.slice(all_, 1, F.col("hop"))).alias("layer", "fanout"))


#: The full graph's edges with ids that no two share; a line's place is by all its columns.
NUMBERED = (
    """ln AS (
      SELECT l_orderkey, l_partkey, l_suppkey,
             l_orderkey * (SELECT max(c) FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey))
             + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS place
      FROM lineitem)""",
    """ne AS (
      SELECT src_idx, dst_idx, edge_attr, src_idx AS edge_id FROM ge WHERE edge_attr NOT IN ('part', 'supplier')
      UNION ALL SELECT a + b + c + d + e + l_orderkey, a + b + c + d + l_partkey, 'part', a + b + c + d + e + (SELECT count(*) FROM orders) + 2 * place FROM ln, o
      UNION ALL SELECT a + b + c + d + e + l_orderkey, a + b + l_suppkey, 'supplier', a + b + c + d + e + (SELECT count(*) FROM orders) + 2 * place + 1 FROM ln, o)""",
)
_SAMPLE = (
    *HQ,
    *NUMBERED,
    "qs AS (SELECT qid, src AS node_idx FROM hx UNION SELECT qid, dst FROM hx)",
    "ei AS (SELECT dst_idx AS s, src_idx AS t, 2 * edge_id AS id FROM ne UNION ALL SELECT src_idx, dst_idx, 2 * edge_id + 1 FROM ne)",
    "t1 AS (SELECT qid, s, t, id FROM (SELECT q.qid, e.s, e.t, e.id, row_number() OVER (PARTITION BY q.qid, e.t ORDER BY " + hash_sql("e.id", 23) + ", e.id) AS rn FROM qs q JOIN ei e ON e.t = q.node_idx) WHERE rn <= 16)",
    "f1 AS (SELECT DISTINCT qid, s AS node_idx FROM t1 EXCEPT SELECT qid, node_idx FROM qs)",
    "t2 AS (SELECT qid, s, t, id FROM (SELECT q.qid, e.s, e.t, e.id, row_number() OVER (PARTITION BY q.qid, e.t ORDER BY " + hash_sql("e.id", 23) + ", e.id) AS rn FROM f1 q JOIN ei e ON e.t = q.node_idx) WHERE rn <= 11)",
    "f2 AS (SELECT DISTINCT qid, s AS node_idx FROM t2 EXCEPT (SELECT qid, node_idx FROM qs UNION SELECT qid, node_idx FROM f1))",
)


def seeds(records: DataFrame) -> DataFrame:
    """qid, node_idx: both ends of each question."""
    return records.select("qid", F.explode(F.array("src", "dst")).alias("node_idx")).distinct()


def _sampled(s, d, records=None):
    """Both ends of each HopQA question are its seeds in the full graph; an edge's two directions have ids of their own.

    records: the questions, where the caller has them.
    """
    def into(front: DataFrame) -> DataFrame:
        e = edges(s, d, numbered=True, around=front)
        return e.select(F.col("dst_idx").alias("src_idx"), F.col("src_idx").alias("dst_idx"), (2 * F.col("edge_id")).alias("edge_id")).unionByName(e.select("src_idx", "dst_idx", (2 * F.col("edge_id") + 1).alias("edge_id")))

    return graph.sample_neighbourhood(seeds(hop_records(s, d) if records is None else records), into, graph.fanouts(2, 16, 0.7), 23)


@query(rec("SELECT qid, node_idx, 0 AS hop FROM qs UNION ALL SELECT qid, node_idx, 1 FROM f1 UNION ALL SELECT qid, node_idx, 2 FROM f2", *_SAMPLE))
def hsgs_sample_nodes(s, d):
    return _sampled(s, d)[0]


@query(rec("SELECT qid, s AS src_idx, t AS dst_idx, id AS edge_id, 1 AS hop FROM t1 UNION ALL SELECT qid, s, t, id, 2 FROM t2", *_SAMPLE))
def hsgs_sample_edges(s, d):
    return _sampled(s, d)[1]


@query(rec("SELECT src_idx, dst_idx, edge_attr FROM ne WHERE " + hash_sql("edge_id", 31) + " >= 0.2::DOUBLE * 2147483647", *NUMBERED))
def edge_dropout(s, d):
    return edges(s, d, numbered=True).filter(h("edge_id", 31) >= 0.2 * 2147483647).select("src_idx", "dst_idx", "edge_attr")


@query(rec("SELECT qid, src, dst, hop, path, src_id, dst_id, question, answer FROM hx", *HQ))
def hopqa_records(s, d):
    return hop_records(s, d).withColumn("path", F.array_join(F.col("path").cast("array<string>"), ","))


@query(rec("SELECT hop, count(*) AS n, 50 AS target FROM hx GROUP BY hop", *HQ))
def hopqa_hop_counts(s, d):
    return hop_records(s, d).groupBy("hop").agg(F.count("*").alias("n")).withColumn("target", F.lit(50))


@query(rec("SELECT qid, hop FROM (SELECT qid, hop FROM hx ORDER BY " + hash_sql("qid", 17) + ", qid LIMIT 32)", *HQ))
def monitor_subset(s, d):
    return hop_records(s, d).select("qid", "hop").orderBy(h("qid", 17), "qid").limit(32)


@query(
    rec(
        "SELECT qid, node_idx, CAST(row_number() OVER (PARTITION BY qid ORDER BY lev, k1, k2, node_idx) - 1 AS BIGINT) AS pos FROM z",
        *_ROLES,
        "lk AS (SELECT src_idx AS u, dst_idx AS v, src_idx AS p FROM se UNION ALL SELECT dst_idx, src_idx, src_idx FROM se)",
        "z0 AS (SELECT qid, node_idx, role AS rk FROM rl WHERE role < 2)",
        "c1 AS (SELECT z0.qid, lk.v AS node_idx, min(z0.rk * 1000000000 + lk.p) AS k FROM z0 JOIN lk ON lk.u = z0.node_idx JOIN rl ON rl.qid = z0.qid AND rl.node_idx = lk.v AND rl.role > 1 GROUP BY 1, 2)",
        "z1 AS (SELECT qid, node_idx, k, row_number() OVER (PARTITION BY qid ORDER BY k, node_idx) AS rk FROM c1)",
        "c2 AS (SELECT z1.qid, lk.v AS node_idx, min(z1.rk * 1000000000 + lk.p) AS k FROM z1 JOIN lk ON lk.u = z1.node_idx JOIN rl ON rl.qid = z1.qid AND rl.node_idx = lk.v AND rl.role > 1 WHERE NOT EXISTS (SELECT 1 FROM z1 y WHERE y.qid = z1.qid AND y.node_idx = lk.v) GROUP BY 1, 2)",
        "z AS (SELECT qid, node_idx, 0 AS lev, CAST(rk AS BIGINT) AS k1, 0::BIGINT AS k2 FROM z0 UNION ALL SELECT qid, node_idx, 1, k, 0 FROM z1 UNION ALL SELECT qid, node_idx, 2, k, 0 FROM c2 UNION ALL SELECT qid, node_idx, 3, 0, 0 FROM rl WHERE role > 1 AND NOT EXISTS (SELECT 1 FROM z1 WHERE z1.qid = rl.qid AND z1.node_idx = rl.node_idx) AND NOT EXISTS (SELECT 1 FROM c2 WHERE c2.qid = rl.qid AND c2.node_idx = rl.node_idx))",
    )
)
def bfs_token_order(s, d):
    lab = _labelled(s, d)
    e = edges(s, d, True)
    links = e.select(F.col("src_idx").alias("u"), F.col("dst_idx").alias("v"), F.col("src_idx").alias("edge_pos")).unionByName(e.select(F.col("dst_idx").alias("u"), F.col("src_idx").alias("v"), F.col("src_idx").alias("edge_pos")))
    return graph.bfs_token_order(lab.filter("role < 2").select("qid", "node_idx", F.col("role").alias("ord")), links, lab.select("qid", "node_idx"), 2)
