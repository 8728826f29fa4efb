"""Forward passes with given weights over the small graph and the embeddings, with equivalent SQL.

A node's vector is that of its index, wrapped around. Weights follow a rule, so SQL can state them too. Results are a
row a node: the sum and the norm of its vector.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopframe.functions import vectors as V
from hopframe.operators import graph, layers, propagate, seeds, tokens, views
from hopframe.plans.graph_queries import _ROLES, HQ, _labelled, hash2_sql, hop_records, rec
from hopframe.sources.testgraph import edges, nodes, undirected

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIM = 64


def query(oracle: str):
    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return keep


def given(rows: int, cols: int, k: int) -> list[list[float]]:
    return [[math.sin(i * 31 + j * 17 + k) / 8 for j in range(cols)] for i in range(rows)]


def given_sql(rows: int, cols: int, k: int) -> str:
    return f"list_transform(range(0, {rows}), lambda i: list_transform(range(0, {cols}), lambda j: sin(i * 31 + j * 17 + {k}) / 8.0::DOUBLE))"


def row_sql(n: int, k: int) -> str:
    return f"list_transform(range(0, {n}), lambda j: sin(j * 17 + {k}) / 8.0::DOUBLE)"


def row(n: int, k: int) -> list[float]:
    return given(1, n, k)[0]


def norms(n: int) -> tuple[list[float], ...]:
    """Mean, variance, weight and bias of the normalisation between layers."""
    return [0.01] * n, [0.5] * n, [1.5] * n, [0.02] * n


NORM_SQL = "greatest(0, (x - 0.01::DOUBLE) / sqrt(0.5::DOUBLE + 1e-5::DOUBLE) * 1.5::DOUBLE + 0.02::DOUBLE)"


def signal(s: SparkSession, d: str) -> DataFrame:
    """node_idx, x of the small graph."""
    v = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    n_vec = v.count()
    return nodes(s, d, True).select("node_idx", F.pmod("node_idx", F.lit(n_vec)).alias("vec_id")).join(v, "vec_id").select("node_idx", "x")


def links(s: SparkSession, d: str) -> DataFrame:
    return undirected(edges(s, d, True)).select(F.col("u").alias("src_idx"), F.col("v").alias("dst_idx"))


def summary(x: Column) -> list[Column]:
    total = F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    return [F.round(total, 6).alias("total"), F.round(V.norm(x), 6).alias("norm")]


X0 = """
xv AS MATERIALIZED (
  SELECT n.node_idx, list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)) AS x
  FROM sn n JOIN embeddings e ON e.vec_id = n.node_idx % (SELECT count(*) FROM embeddings)
)"""
PACKED = "list(x ORDER BY dim) AS x"
SUMMED = "SELECT node_idx, round(sum(x), 6) AS total, round(sqrt(sum(x * x)), 6) AS norm FROM {} GROUP BY node_idx"

# ---- steps of the normalised adjacency

PROP = (
    X0,
    "ad AS (SELECT u, v FROM su UNION SELECT node_idx, node_idx FROM sn)",
    "ag AS (SELECT u, CAST(count(*) AS DOUBLE) AS k FROM ad GROUP BY u)",
    "aw AS MATERIALIZED (SELECT ad.u, ad.v, 1 / sqrt(p.k * q.k) AS w FROM ad JOIN ag p ON p.u = ad.u JOIN ag q ON q.u = ad.v)",
    "x0 AS MATERIALIZED (SELECT node_idx, unnest(range(0, len(x))) AS dim, unnest(x) AS x FROM xv)",
    "x1 AS MATERIALIZED (SELECT aw.u AS node_idx, dim, sum(aw.w * x) AS x FROM aw JOIN x0 ON x0.node_idx = aw.v GROUP BY 1, 2)",
    "x2 AS (SELECT aw.u AS node_idx, dim, sum(aw.w * x) AS x FROM aw JOIN x1 ON x1.node_idx = aw.v GROUP BY 1, 2)",
    "ga AS (SELECT node_idx, 1 / (1 + exp(-(0.1::DOUBLE * total_deg - 0.5::DOUBLE))) AS g FROM sdeg)",
    "h1 AS MATERIALIZED (SELECT node_idx, dim, g * x0.x + (1 - g) * x1.x AS x, (1 - g) * (x1.x - x0.x) AS moved FROM x0 JOIN x1 USING (node_idx, dim) JOIN ga USING (node_idx))",
    "m2 AS (SELECT aw.u AS node_idx, dim, sum(aw.w * x) AS x FROM aw JOIN h1 ON h1.node_idx = aw.v GROUP BY 1, 2)",
)


def adjacency_and_gates(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e, n = edges(s, d, True), nodes(s, d, True)
    gates = graph.degrees(n, e).select("node_idx", (1 / (1 + F.exp(-(0.1 * F.col("total_deg") - 0.5)))).alias("g"))
    return propagate.adjacency(n, undirected(e)), gates


@query(rec(SUMMED.format("(SELECT node_idx, x1.x + x2.x AS x FROM x1 JOIN x2 USING (node_idx, dim))"), *PROP))
def propagate_l2(s, d):
    return propagate.propagated(adjacency_and_gates(s, d)[0], signal(s, d), 2, DIM).select("node_idx", *summary(F.col("x")))


@query(rec(SUMMED.format("h1"), *PROP))
def gated_mix(s, d):
    (a, gates), x = adjacency_and_gates(s, d), signal(s, d)
    return propagate.gated(x, propagate.step(a, x, DIM), gates).select("node_idx", *summary(F.col("x")))


@query(
    rec(
        """
SELECT node_idx, round((a.i + b.i) / 2, 6) AS importance
FROM (SELECT node_idx, sqrt(sum(moved * moved)) AS i FROM h1 GROUP BY 1) a
JOIN (
  SELECT node_idx, sqrt(sum(power((1 - g) * (m2.x - h1.x), 2))) AS i
  FROM m2 JOIN h1 USING (node_idx, dim) JOIN ga USING (node_idx) GROUP BY 1
) b USING (node_idx)""",
        *PROP,
    )
)
def node_importance(s, d):
    (a, gates), x = adjacency_and_gates(s, d), signal(s, d)
    return propagate.importance(a, x, gates, 2, DIM).select("node_idx", F.round("importance", 6).alias("importance"))


# ---- convolutions


def gcn_sql(at: int, x: str, out: int, dim: int, k: int) -> tuple[str, ...]:
    """CTEs of one layer: z{at} the products, c{at} a row a node and dimension."""
    return (
        f"w{at} AS (SELECT {given_sql(out, dim, k)} AS m)",
        f"z{at} AS MATERIALIZED (SELECT node_idx, unnest(range(0, {out})) AS dim, unnest(list_transform(m, lambda r: list_dot_product(r, x))) AS z FROM {x}, w{at})",
        f"""c{at} AS MATERIALIZED (
          SELECT node_idx, dim, sum(z) + sin(dim * 17 + {k}) / 8.0::DOUBLE AS x FROM (
            SELECT e.v AS node_idx, dim, z / sqrt(p.k * q.k) AS z FROM su e JOIN z{at} ON z{at}.node_idx = e.u JOIN kd p ON p.node_idx = e.u JOIN kd q ON q.node_idx = e.v WHERE e.u <> e.v
            UNION ALL SELECT node_idx, dim, z / k FROM z{at} JOIN kd USING (node_idx)) GROUP BY 1, 2)""",
    )


KD = "kd AS MATERIALIZED (SELECT n.node_idx, 1.0::DOUBLE + count(e.u) AS k FROM sn n LEFT JOIN su e ON e.v = n.node_idx AND e.u <> e.v GROUP BY 1)"


@query(rec(SUMMED.format("c2"), X0, KD, *gcn_sql(1, "xv", 16, DIM, 1), f"y1 AS (SELECT node_idx, list({NORM_SQL} ORDER BY dim) AS x FROM c1 GROUP BY 1)", *gcn_sql(2, "y1", 8, 16, 2)))
def gcn_forward(s, d):
    stack = [(layers.gcn, {"weight": given(16, DIM, 1), "bias": row(16, 1)}), (layers.gcn, {"weight": given(8, 16, 2), "bias": row(8, 2)})]
    return layers.stack(signal(s, d), links(s, d), stack, [norms(16)]).select("node_idx", *summary(F.col("x")))


def gat_sql(at: int, x: str, c: int, dim: int, k: int, heads: int = 2) -> tuple[str, ...]:
    """CTEs of one layer of attention."""
    return (
        f"w{at} AS (SELECT {given_sql(heads * c, dim, k)} AS m)",
        f"z{at} AS MATERIALIZED (SELECT node_idx, list_transform(m, lambda r: list_dot_product(r, x)) AS z FROM {x}, w{at})",
        f"""h{at} AS MATERIALIZED (
          SELECT node_idx, h, z[h * {c} + 1:(h + 1) * {c}] AS z FROM z{at}, range(0, {heads}) t(h))""",
        f"""s{at} AS MATERIALIZED (
          SELECT node_idx, h, z, list_dot_product(z, list_transform(range(0, {c}), lambda j: sin(h * 31 + j * 17 + {k + 10}) / 8.0::DOUBLE)) AS a,
                 list_dot_product(z, list_transform(range(0, {c}), lambda j: sin(h * 31 + j * 17 + {k + 20}) / 8.0::DOUBLE)) AS b FROM h{at})""",
        f"""l{at} AS MATERIALIZED (
          SELECT e.v AS node_idx, p.h, p.z, CASE WHEN p.a + q.b >= 0 THEN p.a + q.b ELSE 0.2::DOUBLE * (p.a + q.b) END AS l
          FROM (SELECT u, v FROM su WHERE u <> v UNION ALL SELECT node_idx, node_idx FROM sn) e JOIN s{at} p ON p.node_idx = e.u JOIN s{at} q ON q.node_idx = e.v AND q.h = p.h)""",
        f"t{at} AS (SELECT node_idx, h, z, exp(l - max(l) OVER (PARTITION BY node_idx, h)) AS e FROM l{at})",
        f"n{at} AS MATERIALIZED (SELECT node_idx, h, z, e / (sum(e) OVER (PARTITION BY node_idx, h) + 1e-16::DOUBLE) AS e FROM t{at})",
        f"""c{at} AS MATERIALIZED (
          SELECT node_idx, dim, sum(z * e) / {heads} + sin(dim * 17 + {k}) / 8.0::DOUBLE AS x
          FROM (SELECT node_idx, unnest(range(0, {c})) AS dim, unnest(z) AS z, e FROM n{at}) GROUP BY 1, 2)""",
    )


@query(rec(SUMMED.format("c2"), X0, *gat_sql(1, "xv", 8, DIM, 3), f"y1 AS (SELECT node_idx, list({NORM_SQL} ORDER BY dim) AS x FROM c1 GROUP BY 1)", *gat_sql(2, "y1", 4, 8, 4)))
def gat_forward(s, d):
    layer = lambda c, dim, k: (layers.gat, {"weight": given(2 * c, dim, k), "att_src": given(2, c, k + 10), "att_dst": given(2, c, k + 20), "bias": row(c, k)})
    return layers.stack(signal(s, d), links(s, d), [layer(8, DIM, 3), layer(4, 8, 4)], [norms(8)]).select("node_idx", *summary(F.col("x")))


@query(
    rec(
        SUMMED.format("c1"),
        X0,
        *(f"w{n} AS (SELECT {given_sql(8, DIM, k)} AS m, {row_sql(8, k)} AS b)" for n, k in zip("qkvs", (5, 6, 7, 8), strict=True)),
        *(f"z{n} AS MATERIALIZED (SELECT node_idx, list_transform(range(1, 9), lambda i: list_dot_product(m[i], x) + b[i]) AS z FROM xv, w{n})" for n in "qkvs"),
        """l1 AS MATERIALIZED (
          SELECT e.v AS node_idx, h, vv.z[h * 4 + 1:(h + 1) * 4] AS z, list_dot_product(qq.z[h * 4 + 1:(h + 1) * 4], kk.z[h * 4 + 1:(h + 1) * 4]) / 2 AS l
          FROM su e JOIN zk kk ON kk.node_idx = e.u JOIN zv vv ON vv.node_idx = e.u JOIN zq qq ON qq.node_idx = e.v, range(0, 2) t(h))""",
        "t1 AS (SELECT node_idx, h, z, exp(l - max(l) OVER (PARTITION BY node_idx, h)) AS e FROM l1)",
        "n1 AS (SELECT node_idx, h, z, e / (sum(e) OVER (PARTITION BY node_idx, h) + 1e-16::DOUBLE) AS e FROM t1)",
        """c1 AS MATERIALIZED (
          SELECT node_idx, dim, sum(x) AS x FROM (
            SELECT node_idx, h * 4 + unnest(range(0, 4)) AS dim, unnest(z) * e AS x FROM n1
            UNION ALL SELECT node_idx, unnest(range(0, 8)), unnest(z) FROM zs) GROUP BY 1, 2)""",
    )
)
def transformer_forward(s, d):
    both = lambda k: (given(8, DIM, k), row(8, k))
    return layers.transformer(signal(s, d), links(s, d), both(5), both(6), both(7), both(8), 2).select("node_idx", *summary(F.col("x")))


# ---- graph tokens

TOKENS = tokens.Tables(
    degree=(given(DIM, 1, 40), row(DIM, 41)), role=given(4, DIM, 42), distance_src=given(34, DIM, 43), distance_dst=given(34, DIM, 44), corridor=(given(DIM, 1, 45), row(DIM, 51)), identity=given(16, DIM, 46),
    projector=("linear", [(given(16, DIM, 47), row(16, 47))]), role_residual=given(4, 16, 48), role_alpha=0.5, role_clip=0.3,
    distance_src_residual=given(24, 16, 49), distance_dst_residual=given(24, 16, 50), by_role=True, distance_alpha=0.25, distance_clip=0.2,
)
BUDGET = 16


def question_tokens(s: SparkSession, d: str) -> DataFrame:
    """The first tokens of the corridor questions, in their order; the ends are the targets."""
    lab = _labelled(s, d)
    n, e = nodes(s, d, True), edges(s, d, True)
    deg = graph.degrees(n, e).select("node_idx", "out_deg")
    top = F.broadcast(deg.agg(F.greatest(F.max("out_deg"), F.lit(1)).alias("_m")))  # one row
    bias = deg.join(top, F.col("out_deg") <= F.col("_m")).select("node_idx", (F.col("out_deg") / F.col("_m")).alias("bias"))
    order = graph.syntax_order(lab, BUDGET).select("qid", "pos", "node_idx")
    return order.join(lab, ["qid", "node_idx"]).join(bias, "node_idx").withColumns({"active": F.lit(True), "target": F.col("role") < 2})


_S = lambda i, k: f"sin({i} * 31 + j * 17 + {k}) / 8.0::DOUBLE"
_ORDERED = (
    X0,
    """tk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY least(role, 2), CASE WHEN disconnected THEN 0 ELSE delta END, d_src + d_dst,
        CASE WHEN disconnected THEN 0 ELSE abs(d_src - d_dst) END, node_idx) - 1 AS pos FROM rl) WHERE pos < 16)""",
)
_BUCKET = "(CASE WHEN {0} < 0 THEN 5 ELSE least({0}, 4) END)"


@query(
    rec(
        "SELECT qid, CAST(pos AS INTEGER) AS pos, node_idx, round(list_sum(x), 6) AS total, round(sqrt(list_dot_product(x, x)), 6) AS norm FROM p4",
        *_ROLES,
        *_ORDERED,
        f"""p1 AS (SELECT tk.*, list_transform(range(0, {DIM}), lambda j: x[j + 1]
              + sin(j * 31 + 40) / 8.0::DOUBLE * (out_deg / m) + sin(j * 17 + 41) / 8.0::DOUBLE
              + {_S('role', 42)} + {_S('least(d_src, 33)', 43)} + {_S('least(d_dst, 33)', 44)}
              + sin(j * 31 + 45) / 8.0::DOUBLE * CASE WHEN delta >= 0 THEN exp(-0.5::DOUBLE * delta) ELSE 0 END + sin(j * 17 + 51) / 8.0::DOUBLE + {_S('pos', 46)}) AS v
            FROM tk JOIN xv USING (node_idx) JOIN sdeg USING (node_idx), (SELECT CAST(greatest(max(out_deg), 1) AS DOUBLE) AS m FROM sdeg) mx)""",
        f"p2 AS (SELECT *, list_transform(range(0, 16), lambda i: list_dot_product(list_transform(range(0, {DIM}), lambda j: {_S('i', 47)}), v) + sin(i * 17 + 47) / 8.0::DOUBLE) AS b FROM p1)",
        f"""p3 AS (SELECT *, list_transform(range(0, 16), lambda j: {_S('role', 48)} * 0.5::DOUBLE) AS rr,
              list_transform(range(0, 16), lambda j: ({_S('(role * 6 + ' + _BUCKET.format('d_src') + ')', 49)} + {_S('(role * 6 + ' + _BUCKET.format('d_dst') + ')', 50)}) * 0.25::DOUBLE) AS dr FROM p2)""",
        """p4 AS (SELECT qid, pos, node_idx, list_transform(range(1, 17), lambda i: b[i]
              + rr[i] * least(1, sqrt(list_dot_product(b, b)) * 0.3::DOUBLE / sqrt(list_dot_product(rr, rr)))
              + dr[i] * least(1, sqrt(list_dot_product(b, b)) * 0.2::DOUBLE / sqrt(list_dot_product(dr, dr)))) AS x FROM p3)""",
    )
)
def graph_tokens(s, d):
    """Node tokens of the corridor questions with all annotations, projected, with both residuals."""
    out = tokens.assembled(question_tokens(s, d), signal(s, d), TOKENS, "nodes", DIM)
    return out.select("qid", "pos", "node_idx", *summary(F.col("x")))


@query(
    rec(
        SUMMED.replace("node_idx", "qid").format("(SELECT qid, dim, sin(dim * 17 + 47) / 8.0::DOUBLE + list_dot_product(list_transform(range(0, 64), lambda j: sin(dim * 31 + j * 17 + 47) / 8.0::DOUBLE), x) AS x FROM pl, range(0, 16) t(dim))"),
        *_ROLES,
        *_ORDERED,
        """pd AS (SELECT qid, dim, sum(CASE WHEN role < 2 THEN x ELSE 0 END) / greatest(sum(CASE WHEN role < 2 THEN 1 ELSE 0 END), 1) AS x
             FROM (SELECT qid, role, unnest(range(0, 64)) AS dim, unnest(x) AS x FROM tk JOIN xv USING (node_idx)) GROUP BY 1, 2)""",
        "pl AS (SELECT qid, list(x ORDER BY dim) AS x FROM pd GROUP BY 1)",
    )
)
def graph_token_single(s, d):
    """One pooled and projected token a question."""
    return tokens.assembled(question_tokens(s, d), signal(s, d), TOKENS, "single", DIM).select("qid", *summary(F.col("x")))


# ---- views and seeds


@query(
    rec(
        "SELECT node_idx, round(list_sum(y), 6) AS total, round(sqrt(list_dot_product(y, y)), 6) AS norm, CAST(len(list_filter(y, lambda v: v = 0)) AS INTEGER) AS n_zero FROM ("
        "SELECT node_idx, list_transform(range(0, len(x)), lambda i: CASE WHEN " + hash2_sql("node_idx", "i", 33) + " >= 0.3::DOUBLE * 2147483647 THEN x[i + 1] ELSE 0.0::DOUBLE END) AS y FROM xv)",
        X0,
    )
)
def feature_mask_view(s, d):
    """The key view of a contrastive pair: three tenths of the feature entries set to zero."""
    (_, _), (x, _) = views.build_views(signal(s, d), edges(s, d, True, numbered=True), True, 0.2, "featuremask", 0.0, 0.3, 31)
    return x.select("node_idx", *summary(F.col("x")), F.size(F.filter("x", lambda v: v == 0)).alias("n_zero"))


@query(
    rec(
        "SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY t, o, node_idx) - 1 AS ord, node_idx FROM (SELECT qid, node_idx, min(t) AS t, min_by(o, t * 1000000 + o) AS o FROM k GROUP BY 1, 2) QUALIFY ord < 12",
        *HQ,
        """k AS (
          SELECT qid, dst AS node_idx, 0 AS t, 0 AS o FROM hx
          UNION ALL SELECT qid, CAST(p AS BIGINT), 1, i FROM (SELECT qid, unnest(string_split(path, ',')) AS p, unnest(range(0, len(string_split(path, ',')))) AS i FROM hx)
          UNION ALL SELECT qid, node_idx, 2, node_idx FROM hx, sn WHERE node_type = 'region_nodes'
          UNION ALL SELECT qid, node_idx, 3, r FROM hx, (SELECT node_idx, row_number() OVER (ORDER BY total_deg DESC, node_idx) AS r FROM sdeg QUALIFY r <= 12))""",
    )
)
def seed_selection(s, d):
    """Twelve seeds of every HopQA question: its end is forced, its path is asked for, regions are marked, the rest by
    degree."""
    q = hop_records(s, d).select("qid", F.array("dst").alias("end"), "path")
    n = nodes(s, d, True).withColumn("region", F.col("node_type") == "region_nodes")
    return seeds.select_seeds(q, n, edges(s, d, True), 12, seeds.listed(q, "end"), [seeds.listed(q, "path"), seeds.marked(q, n, "region")])
