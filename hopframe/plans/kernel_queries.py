"""Vector, score and control queries, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopframe.functions import vectors as V
from hopframe.operators import control, graph, retrieval, search
from hopframe.plans.graph_queries import _SAMPLE, _sampled, hop_records, rec
from hopframe.session import checkpointed
from hopframe.sources.testgraph import edges, nodes, undirected

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def _emb(s, d):
    return s.read.parquet(f"{d}/embeddings.parquet")


_V = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"
_DOT = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i] * {b}[i]))"


def dot_sql(a: str, b: str) -> str:
    return _DOT.format(a=a, b=b)


@query("WITH " + _V + ", x AS (SELECT label, unnest(e) AS y, unnest(range(0, len(e))) AS dim FROM v) SELECT label, CAST(dim AS INTEGER) AS dim, round(avg(y), 6) AS mean FROM x GROUP BY 1, 2")
def mean_pool(s, d):
    return _emb(s, d).select("label", F.posexplode("embedding").alias("dim", "y")).groupBy("label", "dim").agg(F.round(F.avg(F.col("y").cast("double")), 6).alias("mean"))


@query("WITH " + _V + ", q AS (SELECT vec_id AS qid, e AS q FROM v WHERE vec_id % 50 = 0), x AS (SELECT qid, vec_id, round(" + dot_sql("q", "e") + " / (sqrt(" + dot_sql("q", "q") + ") * sqrt(" + dot_sql("e", "e") + ")), 6) AS sim FROM q, v WHERE vec_id <> qid) SELECT qid, vec_id, sim FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, vec_id) AS rn FROM x) WHERE rn <= 5")
def cosine_topk(s, d):
    v = _emb(s, d)
    return search.nearest(v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")), v, 5)


@query("WITH " + _V + ", g AS (SELECT vec_id // 20 AS g, vec_id % 20 AS p, label, e, sqrt(" + dot_sql("e", "e") + ") AS n FROM v), x AS (SELECT a.g, " + dot_sql("a.e", "b.e") + " / (a.n * b.n) - CAST(a.label = b.label AS DOUBLE) AS diff FROM g a JOIN g b ON a.g = b.g) SELECT g, round(sum(diff * diff) / greatest(count(*), 1), 6) AS loss FROM x GROUP BY g")
def align_loss(s, d):
    g = _emb(s, d).select(F.floor(F.col("vec_id") / 20).alias("g"), "label", "embedding")
    # groups are of twenty vectors by definition
    x = g.alias("a").join(g.alias("b"), "g").select("g", (V.cosine(F.col("a.embedding"), F.col("b.embedding")) - (F.col("a.label") == F.col("b.label")).cast("double")).alias("diff"))
    return x.groupBy("g").agg(F.round(F.sum(F.col("diff") * F.col("diff")) / F.greatest(F.count("*"), F.lit(1)), 6).alias("loss"))


@query("WITH " + _V + ", k AS (SELECT e AS k FROM v WHERE vec_id < 64), q AS (SELECT vec_id, e AS q, " + dot_sql("e", "e") + " / 0.07 AS pos FROM v), x AS (SELECT vec_id, pos, " + dot_sql("q", "k") + " / 0.07 AS l FROM q, k), m AS (SELECT vec_id, pos, greatest(pos, max(l)) AS m, list(l) AS ls FROM x GROUP BY 1, 2) SELECT vec_id, round(ln(exp(pos - m) + list_sum(list_transform(ls, lambda l: exp(l - m)))) + m - pos, 6) AS nce FROM m")
def infonce(s, d):
    v = _emb(s, d)
    queue = F.broadcast(v.filter("vec_id < 64").select(F.col("embedding").alias("k")))  # a queue of fixed length
    q = v.select("vec_id", F.col("embedding").alias("q"), (V.dot(F.col("embedding"), F.col("embedding")) / 0.07).alias("pos"))
    x = q.join(queue, how="cross").select("vec_id", "pos", (V.dot(F.col("q"), F.col("k")) / 0.07).alias("l"))
    m = x.groupBy("vec_id", "pos").agg(F.greatest(F.col("pos"), F.max("l")).alias("m"), F.collect_list("l").alias("ls"))
    total = F.aggregate("ls", F.lit(0.0), lambda a, l: a + F.exp(l - F.col("m")))
    return m.select("vec_id", F.round(F.ln(F.exp(F.col("pos") - F.col("m")) + total) + F.col("m") - F.col("pos"), 6).alias("nce"))


@query("SELECT vec_id % 128 AS slot, max(vec_id) AS vec_id FROM embeddings GROUP BY 1")
def queue_latest(s, d):
    return _emb(s, d).groupBy((F.col("vec_id") % 128).alias("slot")).agg(F.max("vec_id").alias("vec_id"))


@query(
    "WITH " + _V + """
SELECT k.vec_id, round(list_sum(list_transform(range(1, len(k.e) + 1), lambda i: 0.99::DOUBLE * k.e[i] + 0.01::DOUBLE * coalesce(q.e[i], k.e[i]))), 6) AS updated_sum
FROM v k LEFT JOIN v q ON q.vec_id = k.vec_id + 1"""
)
def momentum_update(s, d):
    """Key parameters drawn to the query's of the same name: here a vector to the one of the next id; one without stays."""
    v = _emb(s, d).select("vec_id", F.col("embedding").cast("array<double>").alias("k"))
    q = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("k").alias("q"))
    x = v.join(q, "vec_id", "left").select("vec_id", F.zip_with("k", F.coalesce("q", "k"), lambda a, b: 0.99 * a + 0.01 * b).alias("x"))
    return x.select("vec_id", F.round(F.aggregate("x", F.lit(0.0), lambda a, b: a + b), 6).alias("updated_sum"))


@query("SELECT user_id, round(sum(value), 6) AS score_sum, count(*) AS n, round(avg(value), 6) AS mean_score, round(avg(value) * (1 - exp(-count(*) / 8.0::DOUBLE)), 6) AS adjusted FROM events GROUP BY user_id")
def score_accumulate(s, d):
    g = s.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(F.sum("value").alias("t"), F.count("*").alias("n"), F.avg("value").alias("m"))
    return g.select("user_id", F.round("t", 6).alias("score_sum"), "n", F.round("m", 6).alias("mean_score"), F.round(F.col("m") * (1 - F.exp(-F.col("n") / 8.0)), 6).alias("adjusted"))


#: Scores of the small graph's nodes: the sum of the events of the user with a node's number.
_SC = "sv AS (SELECT user_id AS node_idx, sum(value) AS t, count(*) AS n FROM events GROUP BY 1), cb AS (SELECT d.node_idx, d.total_deg, coalesce(t / n * (1 - exp(-n / 8.0::DOUBLE)), 0) AS sc, coalesce(n, 0) AS n FROM gdeg d LEFT JOIN sv USING (node_idx)), mx AS (SELECT max(sc) AS ms, max(total_deg) AS md FROM cb), nm AS (SELECT node_idx, round(0.7::DOUBLE * CASE WHEN ms > 0 THEN sc / ms ELSE 0 END + 0.3::DOUBLE * total_deg / md, 9) AS combined, round(total_deg / CAST(md AS DOUBLE) / (n + 1), 9) AS explore FROM cb, mx)"


@query(rec("SELECT node_idx, tier FROM (SELECT node_idx, 'exploit' AS tier FROM (SELECT node_idx FROM nm ORDER BY combined DESC, node_idx LIMIT 48) UNION ALL SELECT node_idx, 'explore' FROM (SELECT node_idx FROM nm WHERE node_idx NOT IN (SELECT node_idx FROM nm ORDER BY combined DESC, node_idx LIMIT 48) ORDER BY explore DESC, node_idx LIMIT 16))", _SC))
def refresh_seed_mix(s, d):
    n, e = nodes(s, d), edges(s, d)
    sv = s.read.parquet(f"{d}/events.parquet").groupBy(F.col("user_id").alias("node_idx")).agg(F.sum("value").alias("t"), F.count("*").alias("n"))
    x = graph.degrees(n, e).join(sv, "node_idx", "left")
    x = x.select("node_idx", "total_deg", F.coalesce(F.col("t") / F.col("n") * (1 - F.exp(-F.col("n") / 8.0)), F.lit(0.0)).alias("sc"), F.coalesce("n", F.lit(0)).alias("n"))
    m = F.broadcast(x.agg(F.max("sc").alias("ms"), F.max("total_deg").alias("md")))  # one row
    x = x.join(m, how="cross").select(
        "node_idx",
        F.round(0.7 * F.when(F.col("ms") > 0, F.col("sc") / F.col("ms")).otherwise(0.0) + 0.3 * F.col("total_deg") / F.col("md"), 9).alias("combined"),
        F.round(F.col("total_deg") / F.col("md") / (F.col("n") + 1), 9).alias("explore"),
    )
    best = x.orderBy(F.desc("combined"), "node_idx").limit(48).select("node_idx")
    rest = x.join(best, "node_idx", "left_anti").orderBy(F.desc("explore"), "node_idx").limit(16).select("node_idx")
    return best.withColumn("tier", F.lit("exploit")).unionByName(rest.withColumn("tier", F.lit("explore")))


_PRIZE = "WITH " + _V + ", q AS (SELECT e AS q FROM v WHERE vec_id = 0), sc AS (SELECT vec_id, round(" + dot_sql("q", "e") + " / (sqrt(" + dot_sql("q", "q") + ") * sqrt(" + dot_sql("e", "e") + ")), 6) AS sim FROM v, q)"


def _similar(s, d):
    v = _emb(s, d)
    q = F.broadcast(v.filter("vec_id = 0").select(F.col("embedding").alias("q")))  # one row
    return v.join(q, how="cross").select("vec_id", F.round(V.cosine(F.col("q"), F.col("embedding")), 6).alias("sim"))


@query(_PRIZE + " SELECT vec_id, CAST(11 - row_number() OVER (ORDER BY sim DESC, vec_id) AS DOUBLE) AS prize FROM sc ORDER BY sim DESC, vec_id LIMIT 10")
def pcst_prizes(s, d):
    return retrieval.node_prizes(_similar(s, d), "vec_id", "sim", 10)


@query()
def pcst_edge_prizes(s, d):
    return retrieval.edge_prizes(_similar(s, d), "vec_id", "sim", 5).filter("prize > 0")


@query()
def pcst_solve(s, d):
    """The subgraph of every HopQA question's sampled neighbourhood: prizes from the similarity of its nodes' vectors
    (the vector of a node has its index, wrapped around) to that of its source, five best; three best edge values."""
    found, links = _sampled(s, d)
    v = _emb(s, d).select("vec_id", "embedding")
    n_vec = v.count()
    own = lambda c: F.pmod(F.col(c), F.lit(n_vec))
    seeds = found.filter("hop = 0").groupBy("qid").agg(F.min("node_idx").alias("seed"))
    seeds = seeds.join(v, own("seed") == F.col("vec_id")).select("qid", F.col("embedding").alias("q"))
    near = found.select("qid", "node_idx").distinct().join(seeds, "qid").join(v, own("node_idx") == F.col("vec_id"))
    near = near.select("qid", "node_idx", F.round(V.cosine(F.col("q"), F.col("embedding")), 6).alias("sim"))
    by = Window.partitionBy("qid").orderBy(F.desc("sim"), "node_idx")
    near = near.withColumn("rn", F.row_number().over(by)).withColumn("prize", F.when(F.col("rn") <= 5, 6.0 - F.col("rn")).otherwise(0.0))
    end = lambda c: near.select("qid", F.col("node_idx").alias(c), F.col("sim").alias(f"sim_{c}"), F.col("prize").alias(f"prize_{c}"))
    e = links.select("qid", F.col("src_idx").alias("u"), F.col("dst_idx").alias("v")).distinct().join(end("u"), ["qid", "u"]).join(end("v"), ["qid", "v"])
    e = e.withColumn("sim", F.round((F.col("sim_u") + F.col("sim_v")) / 2, 6))
    return retrieval.retrieve(retrieval.ranked_edge_prizes(e, "qid", "sim", 3), 0.5)


@query(
    rec(
        """
SELECT h.qid, count(*) AS n_nodes, sum(CAST(h.hop = 0 AS BIGINT)) AS n_seeds, any_value(c.coverage) AS coverage, any_value(c.recall) AS path_recall
FROM nh h JOIN (
  SELECT qid, round(avg(CASE WHEN e THEN hit END), 6) AS coverage, round(avg(CASE WHEN NOT e THEN hit END), 6) AS recall FROM (
    SELECT p.qid, e, CASE WHEN n.node_idx IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS hit FROM (
      SELECT qid, false AS e, CAST(unnest(string_split(path, ',')) AS BIGINT) AS node_idx FROM hx UNION ALL SELECT qid, true, unnest([src, dst]) FROM hx) p
    LEFT JOIN nh n ON n.qid = p.qid AND n.node_idx = p.node_idx) GROUP BY qid) c ON c.qid = h.qid
GROUP BY h.qid""",
        *_SAMPLE,
        "nh AS (SELECT qid, node_idx, 0 AS hop FROM qs UNION ALL SELECT qid, node_idx, 1 FROM f1 UNION ALL SELECT qid, node_idx, 2 FROM f2)",
    )
)
def sampling_audit(s, d):
    """Of each question's sample: nodes, seeds, the share of its ends and of its path that the sample holds."""
    q = checkpointed(hop_records(s, d).select("qid", "src", "dst", "path"))
    found = _sampled(s, d, q)[0]
    n = found.groupBy("qid").agg(F.count("*").alias("n_nodes"), F.sum((F.col("hop") == 0).cast("long")).alias("n_seeds"))
    parts = lambda c, e: q.select("qid", F.explode(c).alias("node_idx")).withColumn("end", F.lit(e))
    asked = parts(F.col("path"), False).unionByName(parts(F.array("src", "dst"), True))
    hit = asked.join(found.select("qid", "node_idx").withColumn("_h", F.lit(1.0)), ["qid", "node_idx"], "left").fillna({"_h": 0.0})
    share = lambda e, name: F.round(F.avg(F.when(F.col("end") == e, F.col("_h"))), 6).alias(name)
    return n.join(hit.groupBy("qid").agg(share(True, "coverage"), share(False, "path_recall")), "qid")


@query(rec("SELECT su.u AS node_idx, round(sum(x.total_deg / (sqrt(p.total_deg + 1) * sqrt(x.total_deg + 1))), 6) AS message FROM su JOIN sdeg x ON x.node_idx = su.v JOIN sdeg p ON p.node_idx = su.u GROUP BY 1"))
def propagate_degree(s, d):
    """One step of normalised propagation of the degree signal: edges joined with the source side, summed by target."""
    e = edges(s, d, True)
    x = graph.degrees(nodes(s, d, True), e).select("node_idx", F.col("total_deg").cast("double").alias("g"))
    y = undirected(e).join(x.withColumnRenamed("node_idx", "v").withColumnRenamed("g", "gv"), "v").join(x.withColumnRenamed("node_idx", "u").withColumnRenamed("g", "gu"), "u")
    return y.groupBy(F.col("u").alias("node_idx")).agg(F.round(F.sum(F.col("gv") / (F.sqrt(F.col("gu") + 1) * F.sqrt(F.col("gv") + 1))), 6).alias("message"))


@query(rec("SELECT n.batch, n_nodes, n_graphs, n_edges FROM (SELECT qid // 2 AS batch, count(*) AS n_nodes, count(DISTINCT qid) AS n_graphs FROM (SELECT qid FROM qs UNION ALL SELECT qid FROM f1 UNION ALL SELECT qid FROM f2) GROUP BY 1) n JOIN (SELECT qid // 2 AS batch, count(*) AS n_edges FROM (SELECT qid FROM t1 UNION ALL SELECT qid FROM t2) GROUP BY 1) e ON e.batch = n.batch", *_SAMPLE))
def collated_batches(s, d):
    n, e = _sampled(s, d)
    batch = F.floor(F.col("qid") / 2).alias("batch")
    return n.groupBy(batch).agg(F.count("*").alias("n_nodes"), F.countDistinct("qid").alias("n_graphs")).join(e.groupBy(batch).agg(F.count("*").alias("n_edges")), "batch")


@query("WITH w AS (SELECT l_partkey AS dst, l_linenumber AS head, l_quantity AS q FROM lineitem), a AS (SELECT dst, head, q / sum(q) OVER (PARTITION BY dst, head) AS a FROM w), h AS (SELECT dst, head, sum(-a * ln(greatest(a, 1e-12::DOUBLE))) AS e, count(*) AS k FROM a GROUP BY 1, 2), m AS (SELECT dst, avg(e) AS e, sum(k) AS deg FROM h GROUP BY 1) SELECT dst, round(CASE WHEN deg > 1 THEN e / ln(deg) ELSE 0 END, 6) AS entropy, round(1 / (1 + exp(-(2.0::DOUBLE * CASE WHEN deg > 1 THEN e / ln(deg) ELSE 0 END - 0.5::DOUBLE))), 6) AS gate FROM m")
def entropy_gate(s, d):
    w = s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_partkey").alias("dst"), F.col("l_linenumber").alias("head"), F.col("l_quantity").alias("q"))
    # sum(-a ln a) with a = q / t is ln t - sum(q ln q) / t: one aggregation instead of a window and a second pass
    h = w.groupBy("dst", "head").agg(F.sum("q").alias("t"), F.sum(F.col("q") * F.ln("q")).alias("u"), F.count("*").alias("k"))
    m = h.groupBy("dst").agg(F.avg(F.ln("t") - F.col("u") / F.col("t")).alias("e"), F.sum("k").alias("deg"))
    e = F.when(F.col("deg") > 1, F.col("e") / F.ln("deg")).otherwise(0.0)
    return m.select("dst", F.round(F.abs(e), 6).alias("entropy"), F.round(1 / (1 + F.exp(-(2.0 * e - 0.5))), 6).alias("gate"))


@query(
    """
SELECT event_id AS step, round(CASE WHEN p < 2 THEN 8e-6::DOUBLE * p / 2 ELSE 5e-6::DOUBLE + 3e-6::DOUBLE * 0.5 * (1 + cos(pi() * (p - 2) / 10)) END * 1e6, 6) AS lr_micro
FROM (SELECT event_id, event_id * 12.0::DOUBLE / (SELECT count(*) FROM events) AS p FROM events)"""
)
def lr_schedule(s, d):
    """The events as the steps of twelve epochs."""
    e = s.read.parquet(f"{d}/events.parquet").select("event_id")
    n = e.count()
    return e.select(F.col("event_id").alias("step"), F.round(control.learning_rate(F.col("event_id") * 12.0 / n, 8e-6, 2, 12) * 1e6, 6).alias("lr_micro"))


@query(
    """
SELECT event_id AS step, CAST(least(7, n - event_id // 7 * 7) AS BIGINT) AS size, event_id = event_id // 7 * 7 + least(7, n - event_id // 7 * 7) - 1 AS boundary
FROM events, (SELECT count(*) AS n FROM events)"""
)
def accum_windows(s, d):
    e = s.read.parquet(f"{d}/events.parquet").select("event_id")
    size, end = control.accumulation_window(F.col("event_id"), e.count(), 7)
    return e.select(F.col("event_id").alias("step"), size.cast("long").alias("size"), end.alias("boundary"))


@query("SELECT event_id AS step, event_id // 2 AS optimizer_step, event_id // 2 < 10 AS projector_frozen, event_id // 8 < 3 AS distance_frozen FROM events")
def freeze_schedule(s, d):
    i = F.col("event_id")
    step = F.floor(i / 2)
    return s.read.parquet(f"{d}/events.parquet").select(i.alias("step"), step.alias("optimizer_step"), (step < 10).alias("projector_frozen"), (F.floor(i / 8) < 3).alias("distance_frozen"))


@query(
    """
SELECT event_id AS step, round(value + 0.25::DOUBLE * (user_id % 3) + 0.1::DOUBLE * CASE WHEN event_type = 'purchase' THEN value ELSE 0 END, 6) AS loss,
       round(sum(value + 0.25::DOUBLE * (user_id % 3) + 0.1::DOUBLE * CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) OVER (PARTITION BY event_id // 8), 4) AS accumulated
FROM events"""
)
def total_loss(s, d):
    """An event's value as its loss, the user as its alignment part, a contrastive part for purchases only; and the loss
    of each window of eight steps."""
    e = s.read.parquet(f"{d}/events.parquet")
    nce = F.when(F.col("event_type") == "purchase", F.col("value"))
    e = e.select(F.col("event_id").alias("step"), (F.col("value") + 0.25 * (F.col("user_id") % 3) + 0.1 * F.coalesce(nce, F.lit(0.0))).alias("l"))
    window = Window.partitionBy(F.floor(F.col("step") / 8))
    return e.select("step", F.round("l", 6).alias("loss"), F.round(F.sum("l").over(window), 4).alias("accumulated"))


@query("SELECT event_id AS step, round(least(4.0::DOUBLE, greatest(0.25::DOUBLE, 0.25::DOUBLE / greatest(value / 200.0::DOUBLE, 1e-6::DOUBLE))), 6) AS scale FROM events")
def align_lr_scale(s, d):
    lam = F.greatest(F.col("value") / 200.0, F.lit(1e-6))
    return s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("step"), F.round(F.least(F.lit(4.0), F.greatest(F.lit(0.25), 0.25 / lam)), 6).alias("scale"))


#: Days of the event table read as epochs.
_EP = "ep AS (SELECT CAST(day(ts) AS BIGINT) AS epoch, round(avg(value), 6) AS val_loss, round(avg(CAST(event_type = 'purchase' OR event_id % 3 = 0 AS INTEGER)), 6) AS val_em, round(avg(CAST(event_id % 11 = 0 AS INTEGER)), 6) AS digit8_rate, round(avg(CAST(event_id % 5 = 0 AS INTEGER)), 6) AS legal_rate FROM events GROUP BY 1)"


def _epochs(s, d):
    r = lambda c, n: F.round(F.avg(c), 6).alias(n)
    i = F.col("event_id")
    return s.read.parquet(f"{d}/events.parquet").groupBy(F.dayofmonth("ts").cast("long").alias("epoch")).agg(r(F.col("value"), "val_loss"), r(((F.col("event_type") == "purchase") | (i % 3 == 0)).cast("int"), "val_em"), r((i % 11 == 0).cast("int"), "digit8_rate"), r((i % 5 == 0).cast("int"), "legal_rate"))


@query("WITH " + _EP + " SELECT epoch, val_loss AS mean_loss FROM ep")
def mean_loss(s, d):
    return _epochs(s, d).select("epoch", F.col("val_loss").alias("mean_loss"))


@query("WITH " + _EP + ", b AS (SELECT *, min(val_loss) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM ep), c AS (SELECT epoch, val_loss, min(val_loss) OVER w AS best_so_far, max(CASE WHEN prev IS NULL OR val_loss < prev THEN epoch END) OVER w AS best_epoch FROM b WINDOW w AS (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT *, epoch - best_epoch >= 6 AS stop FROM c")
def early_stop(s, d):
    return control.early_stop(_epochs(s, d).select("epoch", "val_loss"), 6)


#: What makes an epoch better than the kept one, its score and its second rate, by policy.
_POLICIES = {
    "val_loss": ("r.val_loss < f.score", "r.val_loss", "NULL"),
    "val_em": ("r.val_em > f.score", "r.val_em", "NULL"),
    "val_em_legal_integer": ("r.val_em > f.score OR (abs(r.val_em - f.score) <= 1e-12::DOUBLE AND (f.second IS NULL OR r.legal_rate > f.second))", "r.val_em", "r.legal_rate"),
    "val_em_digit8": (
        "CASE WHEN r.digit8_rate <= 0.09::DOUBLE THEN r.val_em > f.score OR (abs(r.val_em - f.score) <= 1e-12::DOUBLE AND (f.second IS NULL OR r.digit8_rate < f.second)) ELSE f.kept < 0 END",
        "CASE WHEN r.digit8_rate <= 0.09::DOUBLE THEN r.val_em ELSE r.val_loss END", "r.digit8_rate",
    ),
}


def _kept_sql(name: str, better: str, score: str, second: str) -> str:
    return f"""f_{name}(k, score, second, kept) AS (
      SELECT 0::BIGINT, {"1e300" if name == "val_loss" else "-1e300"}::DOUBLE, NULL::DOUBLE, -1::BIGINT
      UNION ALL
      SELECT r.k, CASE WHEN {better} THEN {score} ELSE f.score END, CASE WHEN {better} THEN CAST({second} AS DOUBLE) ELSE f.second END, CASE WHEN {better} THEN r.epoch ELSE f.kept END
      FROM f_{name} f JOIN r ON r.k = f.k + 1)"""


@query(
    "WITH RECURSIVE " + _EP + ", r AS (SELECT *, row_number() OVER (ORDER BY epoch) AS k FROM ep), "
    + ", ".join(_kept_sql(n, *p) for n, p in _POLICIES.items())
    + " " + " UNION ALL ".join(f"SELECT '{n}' AS policy, kept AS epoch FROM f_{n} WHERE k = (SELECT max(k) FROM r)" for n in _POLICIES)
)
def best_checkpoint(s, d):
    e = _epochs(s, d)
    parts = [control.best_checkpoint(e, p, 0.09).select(F.lit(p).alias("policy"), "epoch") for p in _POLICIES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


_HAT = "round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.2::DOUBLE + 0.9::DOUBLE * val_em + 2.0::DOUBLE * digit8_rate - 0.5::DOUBLE * legal_rate)), 6)"


def _hat(e: DataFrame) -> DataFrame:
    hat = control.progress(F.col("val_em"), F.col("digit8_rate"), F.col("legal_rate"), 0.2, (0.9, 2.0, -0.5))
    return e.select("epoch", F.round(hat, 6).alias("progress"), "digit8_rate")


@query("WITH " + _EP + f" SELECT epoch, {_HAT} AS progress FROM ep")
def progress_hat(s, d):
    return _hat(_epochs(s, d)).select("epoch", "progress")


@query(
    "WITH RECURSIVE " + _EP + f", r AS (SELECT epoch, {_HAT} AS p, digit8_rate AS g, row_number() OVER (ORDER BY epoch) AS k FROM ep), "
    + """f(k, epoch, ema, w) AS (
      SELECT 0::BIGINT, NULL::BIGINT, NULL::DOUBLE, 0.25::DOUBLE
      UNION ALL
      SELECT k, epoch, ema, greatest(0.05::DOUBLE, least(0.5::DOUBLE, w + greatest(-0.02::DOUBLE, least(0.02::DOUBLE, aim + rate + band - w)))) FROM (
        SELECT *, CASE WHEN ema >= 0.55::DOUBLE THEN greatest(0.05::DOUBLE + 0.45::DOUBLE * (1 - ema), 0.28::DOUBLE) ELSE 0.05::DOUBLE + 0.45::DOUBLE * (1 - ema) END AS aim,
               0.5::DOUBLE * CASE WHEN abs(g - 0.09::DOUBLE) <= 0.002::DOUBLE THEN 0 ELSE g - 0.09::DOUBLE END AS rate,
               CASE WHEN g > 0.1::DOUBLE + 0.001::DOUBLE THEN 0.8::DOUBLE * (g - (0.1::DOUBLE + 0.001::DOUBLE))
                    WHEN g < 0.085::DOUBLE - 0.001::DOUBLE THEN 0.4::DOUBLE * (g - (0.085::DOUBLE - 0.001::DOUBLE)) ELSE 0 END AS band
        FROM (SELECT r.k, r.epoch, coalesce(0.8::DOUBLE * f.ema + 0.2::DOUBLE * r.p, r.p) AS ema, r.g, f.w FROM f JOIN r ON r.k = f.k + 1)))
    SELECT epoch, round(ema, 6) AS ema, round(w, 6) AS weight FROM f WHERE k > 0"""
)
def progress_ema(s, d):
    e = _hat(_epochs(s, d))
    return control.progress_controller(e, 0.8, 0.05, 0.5, 0.02, 0.25, hold=(0.55, 0.28), target=(0.09, 0.5, 0.002), band=(0.085, 0.1, 0.001, 0.8, 0.4))


@query(
    "WITH RECURSIVE " + _EP + f", r AS (SELECT epoch, {_HAT} AS p, row_number() OVER (ORDER BY epoch) AS k FROM ep), "
    + """f(k, epoch, reset, before, wait) AS (
      SELECT 0::BIGINT, NULL::BIGINT, false, NULL::DOUBLE, 0
      UNION ALL
      SELECT k, epoch, hit, p, CASE WHEN hit THEN 3 ELSE wait END FROM (
        SELECT r.k, r.epoch, r.p, greatest(f.wait - 1, 0) AS wait,
               coalesce(f.before >= 0.55::DOUBLE AND r.p < 0.55::DOUBLE + 0.02::DOUBLE AND r.p - f.before <= -0.01::DOUBLE, false) AND f.wait <= 1 AS hit
        FROM f JOIN r ON r.k = f.k + 1))
    SELECT epoch, reset FROM f WHERE k > 0"""
)
def momentum_reset(s, d):
    return control.momentum_resets(_hat(_epochs(s, d)).select("epoch", "progress"), 0.55, 0.02, 0.01, 3)


@query("SELECT CAST(sum(len(embedding)) AS BIGINT) AS total, CAST(sum(CASE WHEN label < 3 THEN len(embedding) ELSE 0 END) AS BIGINT) AS trainable FROM embeddings")
def trainable_counts(s, d):
    """The embeddings as parameters, those of three labels as the trainable ones."""
    p = _emb(s, d).select(F.size("embedding").cast("long").alias("n"), (F.col("label") < 3).alias("trainable"))
    return p.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("trainable"), F.col("n")).otherwise(0)).alias("trainable"))


@query("SELECT event_id AS id, CAST(event_id % 7 AS INTEGER) AS n_desc, 1 AS graph_pos, 1 + 32 AS text_start, 1 + 32 + least(event_id % 7, 5) + event_id % 13 AS label_start FROM events")
def layout_offsets(s, d):
    i = F.col("event_id")
    return s.read.parquet(f"{d}/events.parquet").select(i.alias("id"), (i % 7).cast("int").alias("n_desc"), F.lit(1).alias("graph_pos"), F.lit(33).alias("text_start"), (F.lit(33) + F.least(i % 7, F.lit(5)) + i % 13).alias("label_start"))


@query("SELECT event_id AS id, event_type AS pred, CAST(user_id AS VARCHAR) AS label FROM events")
def jsonl_roundtrip(s, d):
    from hopframe.session import scratch
    from hopframe.sources.files import read_jsonl, write_jsonl

    path = scratch(s, "jsonl")
    write_jsonl(s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), F.col("event_type").alias("pred"), F.col("user_id").cast("string").alias("label")), path)
    return read_jsonl(s, path, "id long, pred string, label string")
