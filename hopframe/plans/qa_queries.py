"""Question, prediction and metric queries over rows derived from the event stream, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopframe.functions import text as T
from hopframe.functions.hashing import h
from hopframe.operators import evaluate, splits
from hopframe.plans.graph_queries import HQ, hash_sql, hop_records, rec
from hopframe.sources.testgraph import edges, undirected

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

QUESTIONS = (
    "What is the minimum number of graph hops needed to link x to y?",
    "How many papers are there?",
    "Which research area does z work on?",
    "Is y within reach? Output yes plus one witness node or no_path.",
    "Who wrote the paper w?",
    "Which journal was it published in?",
    "Name the thing.",
)


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def predictions(s: SparkSession, d: str) -> DataFrame:
    """id, question, label, pred, gt_path: deterministic predictions, one an event."""
    e = s.read.parquet(f"{d}/events.parquet").select("event_id")
    i = F.col("event_id")
    q = F.element_at(F.array(*map(F.lit, QUESTIONS)), (i % 7 + 1).cast("int"))
    hop, word = (i % 5 + 1).cast("string"), F.concat(F.lit("node "), (i % 11).cast("string"))
    label = F.when(i % 7 < 2, hop).when(i % 7 == 2, F.lit("graph mining, databases, nlp")).when(i % 7 == 3, F.when(i % 2 == 0, F.concat(F.lit("yes\tn"), (i % 3).cast("string"))).otherwise(F.lit("no_path"))).otherwise(word)
    pred = (
        F.when(i % 6 == 0, label)
        .when(i % 6 == 1, F.concat(F.lit("{\"answer\": \""), F.replace(label, F.lit("\t"), F.lit(" ")), F.lit("\", \"path\": [\"s\", \"n"), (i % 4).cast("string"), F.lit("\", \"t\"]}")))
        .when(i % 6 == 2, F.concat(F.lit("The answer is "), hop, F.lit(" hops.")))
        .when(i % 6 == 3, F.lit("1. graph mining; data"))
        .when(i % 6 == 4, F.concat(F.lit("yes, n"), (i % 3).cast("string")))
        .otherwise(F.lit("no_path"))
    )
    path = F.array(F.lit("s"), F.concat(F.lit("n"), (i % 3).cast("string")), F.lit("t"))
    return e.select(i.alias("id"), q.alias("question"), label.alias("label"), pred.alias("pred"), path.alias("gt_path"))


def norm_sql(x: str) -> str:
    plain = f"regexp_replace(translate(lower({x}), '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', ''), '\\s+', ' ', 'g')"
    return f"array_to_string(list_filter(string_split({plain}, ' '), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')"


def tokens_sql(x: str) -> str:
    return f"list_filter(string_split({norm_sql(x)}, ' '), lambda t: t <> '')"


PR = (
    "WITH e AS (SELECT event_id AS i FROM events), l AS (SELECT i, [" + ", ".join("'" + q.replace("'", "''") + "'" for q in QUESTIONS) + "][i % 7 + 1] AS question, CAST(i % 5 + 1 AS VARCHAR) AS hop, "
    "CASE WHEN i % 7 < 2 THEN CAST(i % 5 + 1 AS VARCHAR) WHEN i % 7 = 2 THEN 'graph mining, databases, nlp' WHEN i % 7 = 3 THEN CASE WHEN i % 2 = 0 THEN 'yes' || chr(9) || 'n' || (i % 3) ELSE 'no_path' END ELSE 'node ' || (i % 11) END AS label FROM e), "
    "p AS (SELECT i AS id, question, label, CASE i % 6 WHEN 0 THEN label WHEN 1 THEN '{\"answer\": \"' || replace(label, chr(9), ' ') || '\", \"path\": [\"s\", \"n' || (i % 4) || '\", \"t\"]}' WHEN 2 THEN 'The answer is ' || hop || ' hops.' WHEN 3 THEN '1. graph mining; data' WHEN 4 THEN 'yes, n' || (i % 3) ELSE 'no_path' END AS pred, "
    "['s', 'n' || (i % 3), 't'] AS gt_path FROM l), "
    "f AS (SELECT *, [ 'hop', 'counting', 'topic', 'path_witness', 'author_lookup', 'venue_lookup', 'other'][id % 7 + 1] AS family, CASE WHEN id % 6 = 1 THEN replace(label, chr(9), ' ') ELSE pred END AS answer, CASE WHEN id % 6 = 1 THEN ['s', 'n' || (id % 4), 't'] END AS path FROM p), "
    "g AS (SELECT *, CASE WHEN family IN ('hop', 'counting', 'topic', 'path_witness') THEN family ELSE 'entity' END AS task, coalesce(nullif(regexp_extract(answer, '-?[0-9]+'), ''), trim(answer)) AS num FROM f) "
)


@query(PR + "SELECT id, CASE family WHEN 'topic' THEN 'topic' WHEN 'path_witness' THEN 'path_witness' ELSE 'hop' END AS task_type, family FROM g")
def task_type_family(s, d):
    return predictions(s, d).select("id", T.task_type(F.col("question")).alias("task_type"), T.task_family(F.col("question")).alias("family"))


@query(PR + "SELECT family, count(*) AS n FROM g GROUP BY family")
def task_filter_counts(s, d):
    return predictions(s, d).groupBy(T.task_family(F.col("question")).alias("family")).agg(F.count("*").alias("n"))


@query(PR + "SELECT id, task FROM g")
def metric_task(s, d):
    return predictions(s, d).select("id", T.metric_task(F.col("question"), F.col("label"), T.task_family(F.col("question"))).alias("task"))


_FAMILY_NAMES = ("hop", "counting", "topic", "path_witness", "author_lookup", "venue_lookup", "collab_rank", "citation_rank", "graph_lookup", "other")


@query(
    "WITH f AS (SELECT * FROM (VALUES "
    + ", ".join(
        f"({i}, '{f}', '{T.OUTPUT_MODES.get(f, 'plain_text')}', '" + T.PROMPTS["path_witness" if f == "path_witness" else T.OUTPUT_MODES.get(f, "plain_text")].replace("'", "''") + "')" for i, f in enumerate(_FAMILY_NAMES)
    )
    + f") t(i, family, output_mode, prompt)) SELECT item_id, family, output_mode, prompt || chr(10) || text AS prompt FROM benchmark JOIN f ON f.i = item_id % {len(_FAMILY_NAMES)}"
)
def prompt_protocol_lookup(s, d):
    """Every benchmark text under the prompt of a family of questions, the families in turn."""
    family = F.get(F.array(*map(F.lit, _FAMILY_NAMES)), (F.col("item_id") % len(_FAMILY_NAMES)).cast("int"))
    x = s.read.parquet(f"{d}/benchmark.parquet").select("item_id", family.alias("family"), "text")
    return x.select("item_id", "family", T.output_mode(F.col("family")).alias("output_mode"), F.concat(T.prompt(F.col("family")), F.lit("\n"), "text").alias("prompt"))


#: Predictions that tell strict from lenient parsing, by id; the rest are as they are.
_ODD_PREDICTIONS = ("{'answer': 3}", '{"answer": null, "path": ["a", "b"]}', 'x {"answer": 3} y', '{"path":["a"]}', "{bad", '{"answer": [1, 2]}')


@query(
    PR + """SELECT id,
      CASE id % 12 WHEN 0 THEN '{''answer'': 3}' WHEN 1 THEN NULL WHEN 2 THEN '3' WHEN 3 THEN '{"path":["a"]}' WHEN 4 THEN '{bad' WHEN 5 THEN '[1,2]' ELSE answer END AS answer,
      CASE id % 12 WHEN 1 THEN 'a,b' WHEN 3 THEN 'a' WHEN 0 THEN NULL WHEN 2 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE array_to_string(path, ',') END AS path
    FROM g"""
)
def parse_pred_json(s, d):
    p = predictions(s, d)
    text = F.when(F.col("id") % 12 < len(_ODD_PREDICTIONS), F.get(F.array(*map(F.lit, _ODD_PREDICTIONS)), (F.col("id") % 12).cast("int"))).otherwise(F.col("pred"))
    return p.select("id", T.parsed_answer(text).alias("answer"), F.array_join(T.parsed_path(text), ",").alias("path"))


@query(PR + "SELECT id, num AS extracted FROM g")
def extract_integer(s, d):
    return predictions(s, d).select("id", T.first_integer(T.parsed_answer(F.col("pred"))).alias("extracted"))


@query("SELECT item_id, " + norm_sql("text") + " AS norm FROM benchmark")
def normalize_answer(s, d):
    return s.read.parquet(f"{d}/benchmark.parquet").select("item_id", T.normalize(F.col("text")).alias("norm"))


@query("SELECT p_partkey, array_to_string(list_filter(regexp_extract_all(p_name || ' 12 of ' || p_retailprice, '[A-Za-z]+(?:''[A-Za-z]+)?|[0-9]+(?:\\.[0-9]+)?'), lambda t: NOT regexp_matches(t, '^[0-9]')), ' ') AS trimmed FROM part")
def trim_numeric_noise(s, d):
    p = s.read.parquet(f"{d}/part.parquet")
    return p.select("p_partkey", T.trim_numeric_noise(F.concat("p_name", F.lit(" 12 of "), F.col("p_retailprice").cast("string"))).alias("trimmed"))


@query("SELECT p_partkey, 'type=part_nodes; brand: ' || p_brand || '; name: ' || p_name || '; size: ' || p_size AS node_attr FROM part")
def flatten_features(s, d):
    m = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("name"), F.col("p_name"), F.lit("size"), F.col("p_size").cast("string"))
    return s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.concat(F.lit("type=part_nodes; "), T.flattened(m)).alias("node_attr"))


_NOISE = "array_to_string(list_slice(list_filter(regexp_extract_all({0}, '[A-Za-z]+(?:''[A-Za-z]+)?|[0-9]+(?:\\.[0-9]+)?'), lambda t: NOT regexp_matches(t, '^[0-9]')), 1, {1}), ' ')"


def _parts_sql(*parts: tuple[str, str]) -> str:
    """name: value of the values that are not empty."""
    return "array_to_string(list_filter([" + ", ".join(f"'{k}: ' || nullif({v}, '')" for k, v in parts) + "], lambda x: x IS NOT NULL), '; ')"


@query(
    "WITH p AS (SELECT p_partkey, p_partkey % 4 AS k, p_name || ' 12 ' || p_type || ' 3.5' AS t, p_size, p_brand FROM part) SELECT p_partkey, CASE k "
    + "WHEN 0 THEN " + _parts_sql(("title", _NOISE.format("t", 64)), ("genres", "'a, b c'"), ("format", "p_brand"), ("shelf", _NOISE.format("p_brand || ' 7 x'", 32)))
    + " WHEN 1 THEN " + _parts_sql(("name", _NOISE.format("t", 64)), ("note", _NOISE.format("repeat(t || ' ', 9)", 24)))
    + " WHEN 2 THEN 'isbn: 12; size: ' || p_size ELSE '' END AS features FROM p"
)
def sanitize_features(s, d):
    """The two noisy domains, another one, and a medical node of which only the name's fallback is left, which is empty."""
    p = s.read.parquet(f"{d}/part.parquet").withColumn("t", F.concat("p_name", F.lit(" 12 "), "p_type", F.lit(" 3.5")))
    m = lambda *x: F.create_map(*(v if not isinstance(v, str) else F.lit(v) for v in x))
    k = F.col("p_partkey") % 4
    book = m("title", F.col("t"), "isbn", "123", "genres", '["a", " b c ", " "]', "format", F.concat(F.lit(" "), "p_brand", F.lit(" ")), "shelf", F.concat("p_brand", F.lit(" 7 x")), "pages", "12")
    medical = m("name", F.col("t"), "mesh_id", "D1", "other_id", "x y", "note", F.repeat(F.concat("t", F.lit(" ")), F.lit(9)), "dose", "3.5")
    plain = m("isbn", "12", "size", F.col("p_size").cast("string"))
    features = F.when(k == 0, book).when(k == 1, medical).when(k == 2, plain).otherwise(m("name", "12 3", "x_id", "y"))
    domain = F.element_at(F.array(*map(F.lit, ("Goodreads", "biomedical", "dblp", "biomedical"))), (k + 1).cast("int"))
    return p.select("p_partkey", T.flattened(T.sanitized_features(features, domain)).alias("features"))


@query(PR + "SELECT id, trim(regexp_replace('<b>' || answer, '<[^>]+>', '', 'g')) || 'x' AS clean FROM g")
def clean_generation_a(s, d):
    x = F.concat(F.lit("<b>"), T.parsed_answer(F.col("pred")), F.lit("</s>x"))
    return predictions(s, d).select("id", T.clean_tags_first(x).alias("clean"))


_B_HEAD = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


def _clean_b_sql(x: str) -> str:
    for mark in (r"</s>|<\|eot_id\|>|<\|end_of_text\|>", r"\[/?INST\]", "```"):
        x = _B_HEAD.format(f"string_split_regex({x}, '{mark}')[1]")
    x = _B_HEAD.format(f"regexp_replace({x}, '<[^>]+>', '', 'g')")
    return _B_HEAD.format(f"regexp_replace({x}, '\\]\\s*\\(?/?INST\\)?', '', 'gi')")


@query(
    "WITH x AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN html WHEN 1 THEN replace(html, '<article>', 'a <b [INST] c>') WHEN 2 THEN replace(html, '</p>', ' x</s>') ELSE replace(html, '<p>', '] (/INST) ``` ') END AS t FROM pages) "
    "SELECT page_id, " + _clean_b_sql("t") + " AS clean FROM x"
)
def clean_generation_b(s, d):
    """Whole pages with marks put in, so that the order of the cuts shows."""
    k, t = F.col("page_id") % 4, F.col("html")
    put = lambda old, new: F.replace(t, F.lit(old), F.lit(new))
    x = F.when(k == 0, t).when(k == 1, put("<article>", "a <b [INST] c>")).when(k == 2, put("</p>", " x</s>")).otherwise(put("<p>", "] (/INST) ``` "))
    return s.read.parquet(f"{d}/pages.parquet").select("page_id", T.clean_tags_last(x).alias("clean"))


@query("SELECT event_id AS id, CASE WHEN v IS NULL THEN 'none' ELSE CAST(v AS VARCHAR) END AS first, CASE WHEN v IS NULL THEN 'none' WHEN v BETWEEN 1 AND 9 THEN CAST(v AS VARCHAR) ELSE '' END AS legal FROM (SELECT event_id, CASE WHEN event_id % 5 > 0 THEN event_id % 23 - 3 END AS v FROM events)")
def legal_integers(s, d):
    i = F.col("event_id")
    text = F.when(i % 5 > 0, F.concat(F.lit("about "), (i % 23 - 3).cast("string"), F.lit(" or 7"))).otherwise("none")
    return s.read.parquet(f"{d}/events.parquet").select(i.alias("id"), T.legal_integer(text).alias("first"), T.legal_integer(text, 1, 9).alias("legal"))


@query("SELECT p_partkey, replace(p_name, ' ', '|') AS keys, CAST(len(string_split(p_name, ' ')) AS INTEGER) AS n, array_to_string(list_slice(string_split(p_name, ' '), 1, 3), ', ') AS first_three FROM part")
def keyword_split(s, d):
    x = F.concat(F.lit("Keywords: ["), F.replace("p_name", F.lit(" "), F.lit("; ")), F.lit("]"))
    k = T.keywords(x)
    return s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.array_join(k, "|").alias("keys"), F.size(k).alias("n"), T.keyword_list(x).alias("first_three"))


@query(PR + "SELECT id, CASE WHEN id % 2 = 0 THEN 'Graph: g' || (id % 3) || chr(10) || chr(10) ELSE '' END || question AS prompt FROM g")
def instruction_prompt(s, d):
    desc = F.when(F.col("id") % 2 == 0, F.concat(F.lit("Graph: g"), (F.col("id") % 3).cast("string"))).otherwise("")
    return predictions(s, d).select("id", F.when(desc != "", F.concat(desc, F.lit("\n\n"), F.col("question"))).otherwise(F.col("question")).alias("prompt"))


@query(PR + "SELECT id, question || chr(10) || chr(10) || CASE family WHEN 'path_witness' THEN '" + T.PROMPTS["path_witness"].replace("'", "''") + "' WHEN 'topic' THEN '" + T.PROMPTS["keyword_list"] + "' WHEN 'hop' THEN '" + T.PROMPTS["single_integer"] + "' WHEN 'counting' THEN '" + T.PROMPTS["single_integer"] + "' ELSE '" + T.PROMPTS["plain_text"] + "' END AS text, label, array_to_string(gt_path, ',') AS path FROM g")
def sample_assembly(s, d):
    p = predictions(s, d)
    return p.select("id", F.concat_ws("\n\n", "question", T.prompt(T.task_family(F.col("question")))).alias("text"), "label", F.array_join("gt_path", ",").alias("path"))


@query(
    """
SELECT p_partkey, p_name || '|' || p_brand || '|' || p_type AS items,
       CASE p_size % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS parsed
FROM part"""
)
def config_parsing(s, d):
    """The texts of parts as lists and flags of a configuration."""
    raw = F.concat(F.lit(" "), "p_name", F.lit(", ,"), "p_brand", F.lit(" ,, "), "p_type", F.lit(","))
    flag = F.get(F.array(*map(F.lit, ("Yes", " 0", "ON ", "maybe"))), (F.col("p_size") % 4).cast("int"))
    return s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.array_join(T.csv_list(raw), "|").alias("items"), T.parse_bool(flag).alias("parsed"))


_TURNS = "t AS (SELECT u.conv_id, u.turn, u.text AS label, a.text AS pred FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant')"


def _turns(s, d):
    c = s.read.parquet(f"{d}/conversations.parquet")
    u = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("label"))
    return u.join(c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("pred")), ["conv_id", "turn"])


def f1_sql(p: str, q: str) -> str:
    common = f"len(list_filter({p}, lambda t: list_contains({q}, t)))"
    return f"CASE WHEN len({p}) > 0 AND len({q}) > 0 AND {common} > 0 THEN 2 * ({common} / len({p})::DOUBLE) * ({common} / len({q})::DOUBLE) / ({common} / len({p})::DOUBLE + {common} / len({q})::DOUBLE) ELSE 0 END"


@query("WITH " + _TURNS + ", k AS (SELECT conv_id, turn, " + tokens_sql("pred") + " AS a, " + tokens_sql("label") + " AS b FROM t) SELECT conv_id, turn, round(" + f1_sql("a", "b") + ", 6) AS f1 FROM k")
def token_f1(s, d):
    """Every assistant's turn against the user's turn before it."""
    return _turns(s, d).select("conv_id", "turn", F.round(T.token_f1(F.col("pred"), F.col("label")), 6).alias("f1"))


#: Scored rows: em, f1 and the extra measures of each task.
SCORED = (
    PR
    + ", k AS (SELECT *, CASE WHEN task IN ('hop', 'counting') THEN num ELSE trim(answer) END AS a FROM g), t AS (SELECT *, " + tokens_sql("a") + " AS ta, " + tokens_sql("label") + " AS tb, " + norm_sql("a") + " AS na, " + norm_sql("label") + " AS nb, "
    "CASE WHEN id % 6 IN (0, 1) THEN 3 WHEN id % 6 = 3 THEN 2 ELSE 0 END AS hit, regexp_extract(trim(answer), '(?i)^\\s*yes(?:[\\t, ]+(.+?))?\\s*$', 1) AS who, regexp_matches(trim(answer), '(?i)^\\s*yes(?:[\\t, ]+(.+?))?\\s*$') AS yes FROM k), "
    "w AS (SELECT *, CASE WHEN label = 'no_path' THEN CAST(trim(answer) = 'no_path' AS DOUBLE) ELSE CAST(yes AS DOUBLE) END AS ans, CASE WHEN label = 'no_path' THEN CAST(trim(answer) = 'no_path' AS DOUBLE) ELSE CAST(yes AND who = 'n' || (id % 3) AS DOUBLE) END AS wit, " + f1_sql("ta", "tb") + " AS tf FROM t), "
    "sc AS (SELECT id, task, label, CASE task WHEN 'topic' THEN CAST(hit = 3 AS DOUBLE) WHEN 'path_witness' THEN CAST(ans > 0 AND wit > 0 AS DOUBLE) ELSE CAST(na = nb AS DOUBLE) END AS em, CASE task WHEN 'path_witness' THEN CAST(ans > 0 AND wit > 0 AS DOUBLE) ELSE tf END AS f1, "
    "CASE WHEN task = 'topic' THEN hit / 3.0::DOUBLE END AS recall, CASE WHEN task = 'path_witness' THEN ans END AS ans, CASE WHEN task = 'path_witness' THEN wit END AS wit FROM w) "
)


def scored(s, d, dialect: str = "tasks"):
    return evaluate.scored(predictions(s, d), dialect)


@query(SCORED + "SELECT count(*) AS n, round(coalesce(avg(em), 0), 6) AS em, round(coalesce(avg(f1), 0), 6) AS f1 FROM sc")
def em_f1_overall(s, d):
    return scored(s, d).agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg("em"), F.lit(0.0)), 6).alias("em"), F.round(F.coalesce(F.avg("f1"), F.lit(0.0)), 6).alias("f1"))


@query(SCORED + "SELECT task, count(*) AS n, round(avg(em), 6) AS em, round(avg(f1), 6) AS f1, round(avg(recall), 6) AS keyword_recall, round(avg(ans), 6) AS answer_accuracy, round(avg(wit), 6) AS witness_validity FROM sc GROUP BY task")
def em_f1_by_task(s, d):
    mean = lambda c, n: F.round(F.avg(c), 6).alias(n)
    return scored(s, d).groupBy("task").agg(F.count("*").alias("n"), mean("em", "em"), mean("f1", "f1"), mean("recall", "keyword_recall"), mean("ans", "answer_accuracy"), mean("wit", "witness_validity"))


@query(SCORED + "SELECT task, count(*) AS n, round(avg(em), 6) AS em, round(avg(f1), 6) AS f1 FROM (SELECT CASE WHEN task = 'hop' THEN 'counting' ELSE task END AS task, em, f1 FROM sc) GROUP BY task")
def em_f1_by_task_legacy(s, d):
    return scored(s, d, "legacy").groupBy("task").agg(F.count("*").alias("n"), F.round(F.avg("em"), 6).alias("em"), F.round(F.avg("f1"), 6).alias("f1"))


@query(SCORED + "SELECT id, em, round(f1, 6) AS f1, round(recall, 6) AS recall FROM sc WHERE task = 'topic'")
def topic_metrics(s, d):
    return scored(s, d).filter("task = 'topic'").select("id", "em", F.round("f1", 6).alias("f1"), F.round("recall", 6).alias("recall"))


@query(SCORED + "SELECT id, ans, wit, em AS joint FROM sc WHERE task = 'path_witness'")
def path_witness_metrics(s, d):
    return scored(s, d).filter("task = 'path_witness'").select("id", "ans", "wit", F.col("em").alias("joint"))


@query(PR + "SELECT id, CASE WHEN path IS NOT NULL THEN (CAST(path[2] = gt_path[2] AS INTEGER) + CAST(path[3] = gt_path[3] AS INTEGER)) / 2.0::DOUBLE END AS hopwise FROM g")
def hopwise_accuracy(s, d):
    return predictions(s, d).select("id", T.hopwise_accuracy(T.parsed_path(F.col("pred")), F.col("gt_path")).alias("hopwise"))


def hallucination_rate(s, d):
    """HopQA paths as answers, every third with a jump from its end back to its start: the share of steps that are no
    edge of the graph in either direction."""
    p = hop_records(s, d).select("qid", F.when(F.col("qid") % 3 == 0, F.concat("path", F.array("src"))).otherwise(F.col("path")).alias("p"))
    steps = p.select("qid", F.explode(F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.struct(F.get("p", i - 1).alias("u"), F.get("p", i).alias("v")))).alias("x")).select("qid", "x.*")
    known = undirected(edges(s, d, True)).distinct().withColumn("hit", F.lit(1))
    x = steps.join(known, ["u", "v"], "left")
    return x.groupBy("qid").agg(F.avg(F.when(F.col("hit").isNull(), 1.0).otherwise(0.0)).alias("rate"))


QUERIES["hallucination_rate"] = hallucination_rate
ORACLES["hallucination_rate"] = rec(
    """
SELECT qid, avg(CASE WHEN e.u IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS rate
FROM (SELECT qid, p[i] AS u, p[i + 1] AS v FROM (
        SELECT qid, unnest(range(1, len(p))) AS i, p FROM (
          SELECT qid, list_transform(string_split(path, ','), lambda x: CAST(x AS BIGINT)) || CASE WHEN qid % 3 = 0 THEN [src] ELSE [] END AS p FROM hx))) t
LEFT JOIN (SELECT DISTINCT u, v FROM su) e ON e.u = t.u AND e.v = t.v GROUP BY qid""",
    *HQ,
)


_HALLUCINATED = ORACLES["hallucination_rate"]


def hallucination_by_hop(s, d):
    """Means of the hallucination rate over all questions (hop null) and by hop."""
    rows = hallucination_rate(s, d).join(hop_records(s, d).select("qid", "hop"), "qid")
    return evaluate.corpus_means(rows, ["rate"], "hop")


QUERIES["hallucination_by_hop"] = hallucination_by_hop
ORACLES["hallucination_by_hop"] = (
    _HALLUCINATED.rsplit("\nSELECT qid, avg", 1)[0]
    + ",\nhr0 AS (SELECT qid, avg"
    + _HALLUCINATED.rsplit("\nSELECT qid, avg", 1)[1]
    + ")\nSELECT hx.hop, count(*) AS n, round(avg(rate), 6) AS rate FROM hr0 JOIN hx USING (qid) GROUP BY ROLLUP (hx.hop)"
)


def _reported(s, d):
    p = predictions(s, d).withColumn("parsed", F.trim(T.parsed_answer(F.col("pred")))).withColumn("extracted", T.first_integer(F.col("parsed")))
    n, lab = T.normalize, T.normalize(F.col("label"))
    raw, par, ext, fmt = n(F.col("pred")) == lab, n(F.col("parsed")) == lab, n(F.col("extracted")) == lab, T.single_integer(F.col("parsed"))
    flag = lambda c: c.cast("double")
    return p.select("id", T.hop_key(F.col("label")).alias("hop_key"), "extracted", flag(raw).alias("raw"), flag(par).alias("par"), flag(ext).alias("ext"), flag(fmt).alias("fmt"), flag(fmt & ext).alias("single"))


REPORT = PR + ", r AS (SELECT id, CASE WHEN regexp_matches(trim(label), '^-?[0-9]+$') THEN 'hop' || trim(label) ELSE 'label:' || trim(label) END AS hop_key, num AS extracted, CAST(" + norm_sql("pred") + " = " + norm_sql("label") + " AS DOUBLE) AS raw, CAST(" + norm_sql("answer") + " = " + norm_sql("label") + " AS DOUBLE) AS par, CAST(" + norm_sql("num") + " = " + norm_sql("label") + " AS DOUBLE) AS ext, CAST(regexp_matches(trim(answer), '^-?[0-9]+$') AS DOUBLE) AS fmt FROM g) "
_MEANS = "count(*) AS n, round(avg(ext), 6) AS benchmark_em, round(avg(raw), 6) AS strict_raw, round(avg(par), 6) AS strict_parsed, round(avg(fmt * ext), 6) AS single_integer_em, round(avg(fmt), 6) AS format_rate"


def _means():
    m = lambda c, n: F.round(F.avg(c), 6).alias(n)
    return [F.count("*").alias("n"), m("ext", "benchmark_em"), m("raw", "strict_raw"), m("par", "strict_parsed"), m("single", "single_integer_em"), m("fmt", "format_rate")]


@query(REPORT + f"SELECT coalesce(hop_key, 'all') AS hop_key, {_MEANS} FROM r GROUP BY GROUPING SETS ((), (hop_key))")
def hopqa_report(s, d):
    return _reported(s, d).rollup("hop_key").agg(*_means()).withColumn("hop_key", F.coalesce("hop_key", F.lit("all")))


@query(REPORT + "SELECT hop_key, extracted AS answer, n, round(n / t::DOUBLE, 6) AS rate FROM (SELECT hop_key, extracted, count(*) AS n, sum(count(*)) OVER (PARTITION BY hop_key) AS t, row_number() OVER (PARTITION BY hop_key ORDER BY count(*) DESC, min(id)) AS k FROM r GROUP BY 1, 2) WHERE k = 1")
def majority_answer(s, d):
    n = _reported(s, d).groupBy("hop_key", "extracted").agg(F.count("*").alias("n"), F.min("id").alias("at"))
    best = n.groupBy("hop_key").agg(F.min_by(F.struct("extracted", "n"), F.struct(-F.col("n"), F.col("at"))).alias("b"), F.sum("n").alias("t"))
    return best.select("hop_key", F.col("b.extracted").alias("answer"), F.col("b.n").alias("n"), F.round(F.col("b.n") / F.col("t"), 6).alias("rate"))


@query(REPORT + "SELECT extracted AS answer, count(*) AS n, round(count(*) / (SELECT count(*) FROM r)::DOUBLE, 6) AS rate FROM r GROUP BY 1 ORDER BY count(*) DESC, min(id) LIMIT 10")
def top_answers(s, d):
    n = _reported(s, d).groupBy("extracted").agg(F.count("*").alias("n"), F.min("id").alias("at"))
    t = n.agg(F.sum("n").alias("t"))  # one row
    return n.join(F.broadcast(t), how="cross").orderBy(F.desc("n"), "at").limit(10).select(F.col("extracted").alias("answer"), "n", F.round(F.col("n") / F.col("t"), 6).alias("rate"))


@query(PR + "SELECT count(*) AS n, round(avg(CAST(regexp_matches(trim(answer), '^[0-9]$') AS INTEGER)), 6) AS single_digit, round(avg(CAST(regexp_matches(trim(answer), '^[0-9]{8,}$') AS INTEGER)), 6) AS digit8, round(avg(CASE WHEN regexp_matches(trim(answer), '^-?[0-9]+$') AND TRY_CAST(trim(answer) AS BIGINT) BETWEEN 1 AND 5 THEN 1 ELSE 0 END), 6) AS legal FROM g")
def digit_state_rates(s, d):
    a = predictions(s, d).select(F.trim(T.parsed_answer(F.col("pred"))).alias("a"))
    r = lambda c, n: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("int")), 6).alias(n)
    return a.agg(F.count("*").alias("n"), r(F.col("a").rlike("^[0-9]$"), "single_digit"), r(F.col("a").rlike("^[0-9]{8,}$"), "digit8"), r(T.single_integer(F.col("a")) & F.col("a").try_cast("long").between(1, 5), "legal"))


@query(PR + "SELECT count(*) AS n, round(avg(CAST(id % 6 = 1 AS INTEGER)), 6) AS compliance FROM g")
def format_compliance(s, d):
    return predictions(s, d).agg(F.count("*").alias("n"), F.round(F.avg(T.format_compliant(F.col("pred")).cast("int")), 6).alias("compliance"))


@query(SCORED + "SELECT count(*) AS n, round(avg(em), 6) AS exact_match, round(avg(f1), 6) AS f1, round(avg(CAST(id % 6 = 1 AS INTEGER)), 6) AS format_compliance, 'NaN' AS macro_f1 FROM sc")
def legacy_report(s, d):
    x = scored(s, d).join(predictions(s, d).select("id", T.format_compliant(F.col("pred")).cast("int").alias("ok")), "id")
    return x.agg(F.count("*").alias("n"), F.round(F.avg("em"), 6).alias("exact_match"), F.round(F.avg("f1"), 6).alias("f1"), F.round(F.avg("ok"), 6).alias("format_compliance")).withColumn("macro_f1", F.lit(float("nan")).cast("string"))


def bucket_counts(n):
    """train, val, test of an 80/10/10 split of a bucket of n: from three rows on, each part gets one at least."""
    val, left = F.greatest(F.lit(1), F.floor(n * 0.1)), n - F.floor(n * 0.8) - F.floor(n * 0.1)
    test = F.greatest(F.lit(1), left)
    return F.when(n <= 2, F.lit(1)).otherwise(n - val - test), F.when(n <= 2, F.lit(0)).otherwise(val), F.when(n <= 1, F.lit(0)).when(n == 2, F.lit(1)).otherwise(test)


@query("WITH n AS (SELECT role, conv_id, turn, row_number() OVER (PARTITION BY role ORDER BY " + hash_sql("conv_id * 100 + turn", 5) + ", conv_id, turn) AS rk, count(*) OVER (PARTITION BY role) AS n FROM conversations), c AS (SELECT *, CASE WHEN n <= 2 THEN 0 ELSE greatest(1, floor(n * 0.1::DOUBLE)) END AS val, CASE WHEN n <= 1 THEN 0 WHEN n = 2 THEN 1 ELSE greatest(1, n - floor(n * 0.8::DOUBLE) - floor(n * 0.1::DOUBLE)) END AS test FROM n) SELECT role, conv_id, turn, CASE WHEN rk <= n - val - test THEN 'train' WHEN rk <= n - test THEN 'val' ELSE 'test' END AS split FROM c")
def split_family_80_10_10(s, d):
    c = s.read.parquet(f"{d}/conversations.parquet").select("role", "conv_id", "turn")
    n = c.groupBy("role").agg(F.count("*").alias("n"))  # a row a family
    train, val, _ = bucket_counts(F.col("n"))
    w = Window.partitionBy("role").orderBy(h(F.col("conv_id") * 100 + F.col("turn"), 5), "conv_id", "turn")
    x = c.withColumn("rk", F.row_number().over(w)).join(F.broadcast(n), "role")
    return x.select("role", "conv_id", "turn", F.when(F.col("rk") <= train, "train").when(F.col("rk") <= train + val, "val").otherwise("test").alias("split"))


@query(PR + ", m AS (SELECT id AS raw_index, row_number() OVER (ORDER BY id) - 1 AS sample_index FROM g WHERE family = 'hop') SELECT CASE raw_index % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split, raw_index, sample_index FROM m")
def split_explicit_map(s, d):
    p = predictions(s, d).filter(T.task_family(F.col("question")) == "hop").select(F.col("id").alias("raw_index"))
    kept = splits.numbered(p, "raw_index", "sample_index")
    listed = s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("raw_index")).withColumn("split", F.when(F.col("raw_index") % 4 == 0, "train").when(F.col("raw_index") % 4 == 1, "val").otherwise("test"))
    return listed.join(kept, "raw_index").select("split", "raw_index", "sample_index")


@query("SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN CAST(event_id % 30 AS VARCHAR) || CASE WHEN event_id % 30 <> (event_id + 6) % 30 THEN ',' || ((event_id + 6) % 30) ELSE '' END WHEN 1 THEN CAST(event_id % 5 AS VARCHAR) ELSE CAST(5 + event_id % 25 AS VARCHAR) || ',' || (event_id % 5) END AS endpoints FROM events")
def query_node_resolution(s, d):
    """Endpoints from indices, else from ids, else from the ends of the path; the first kind that gives any wins."""
    i = F.col("event_id")
    e = s.read.parquet(f"{d}/events.parquet").select(
        i.alias("id"), F.when(i % 3 == 0, (i % 30).cast("string")).alias("src_idx"), F.when(i % 3 == 0, ((i + 6) % 30).cast("string")).alias("dst_idx"), F.when(i % 3 == 1, F.concat(F.lit("region:"), (i % 5).cast("string"))).alias("src_id"),
        F.array(F.concat(F.lit("nation:"), (i % 25).cast("string")), F.lit("x"), F.concat(F.lit("region:"), (i % 5).cast("string"))).alias("path"),
    )
    from hopframe.sources.testgraph import nodes

    ids = nodes(s, d, True).groupBy("node_id").agg(F.max("node_idx").alias("idx"))  # the last wins
    index = lambda c: F.when(c.rlike("^[0-9]+$"), c.cast("long"))
    at = lambda c, n: ids.select(F.col("node_id").alias(c), F.col("idx").alias(n))
    e = e.withColumns({"first": F.get("path", F.lit(0)), "last": F.get("path", F.size("path") - 1)})
    e = e.join(at("src_id", "a"), "src_id", "left").join(at("first", "b"), "first", "left").join(at("last", "c"), "last", "left")
    tier = lambda *c: F.array_distinct(F.array_compact(F.array(*c)))
    tiers = [tier(index(F.col("src_idx")), index(F.col("dst_idx"))), tier(F.col("a")), tier(F.col("b"), F.col("c"))]
    best = F.coalesce(*(F.when(F.size(t) > 0, t) for t in tiers))
    return e.select("id", F.array_join(best.cast("array<string>"), ",").alias("endpoints"))


@query("WITH v(word, x, y) AS (VALUES ('the', 1.0::DOUBLE, 0.0::DOUBLE), ('of', 0.0::DOUBLE, 1.0::DOUBLE), ('and', 1.0::DOUBLE, 1.0::DOUBLE), ('de', -1.0::DOUBLE, 0.5::DOUBLE), ('la', 0.25::DOUBLE, -0.5::DOUBLE)), w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents), m AS (SELECT doc_id, avg(x) AS x, avg(y) AS y FROM w JOIN v USING (word) GROUP BY 1) SELECT doc_id, round(coalesce(x, 0), 6) AS x, round(coalesce(y, 0), 6) AS y FROM documents LEFT JOIN m USING (doc_id)")
def word_mean_embedding(s, d):
    v = s.createDataFrame([("the", 1.0, 0.0), ("of", 0.0, 1.0), ("and", 1.0, 1.0), ("de", -1.0, 0.5), ("la", 0.25, -0.5)], "word string, x double, y double")
    docs = s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    w = docs.select("doc_id", F.explode(F.split("text", " ")).alias("word")).join(v, "word")
    m = w.groupBy("doc_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return docs.select("doc_id").join(m, "doc_id", "left").select("doc_id", *(F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in ("x", "y")))


@query("SELECT event_id AS id, CASE WHEN event_id < floor(0.4::DOUBLE * n) THEN 'train' WHEN event_id < floor(0.4::DOUBLE * n) + floor(0.1::DOUBLE * n) THEN 'val' ELSE 'test' END AS split FROM events, (SELECT count(*) AS n FROM events)")
def split_contiguous(s, d):
    e = s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"))
    n = e.count()
    a, b = int(0.4 * n), int(0.1 * n)
    return e.withColumn("split", F.when(F.col("id") < a, "train").when(F.col("id") < a + b, "val").otherwise("test"))


@query("SELECT doc_id, CASE WHEN rk <= floor(0.6::DOUBLE * n) THEN 'train' WHEN rk <= floor(0.8::DOUBLE * n) THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY " + hash_sql("doc_id", 42) + ", doc_id) AS rk, count(*) OVER () AS n FROM documents)")
def split_random_60_20_20(s, d):
    x = splits.numbered(s.read.parquet(f"{d}/documents.parquet").select(F.struct(h("doc_id", 42).alias("hash"), "doc_id").alias("k")), "k", "rank")
    n = x.count()
    return x.select("k.doc_id", F.when(F.col("rank") < int(0.6 * n), "train").when(F.col("rank") < int(0.8 * n), "val").otherwise("test").alias("split"))


_APPORTION = "c AS (SELECT quality * 2 + toxic AS k, count(*) AS cap FROM labels GROUP BY 1), a AS (SELECT k, cap, cap * 50 / CAST(sum(cap) OVER () AS DOUBLE) AS raw FROM c), b AS (SELECT *, floor(raw) AS base, 50 - sum(floor(raw)) OVER () AS need FROM a) SELECT k, cap, CAST(base + CASE WHEN row_number() OVER (ORDER BY raw - base DESC, cap - base DESC, k DESC) <= need THEN 1 ELSE 0 END AS BIGINT) AS take FROM b"


@query("WITH " + _APPORTION)
def split_apportion(s, d):
    c = s.read.parquet(f"{d}/labels.parquet").groupBy((F.col("quality") * 2 + F.col("toxic")).alias("k")).agg(F.count("*").alias("cap"))
    all_ = Window.partitionBy()  # a row a stratum
    c = c.withColumn("raw", F.col("cap") * 50 / F.sum("cap").over(all_)).withColumn("base", F.floor("raw"))
    rank = F.row_number().over(Window.orderBy(F.desc(F.col("raw") - F.col("base")), F.desc(F.col("cap") - F.col("base")), F.desc("k")))
    return c.withColumn("need", F.lit(50) - F.sum("base").over(all_)).select("k", "cap", (F.col("base") + (rank <= F.col("need")).cast("long")).alias("take"))


#: Bytes of the benchmark that travel to every task at once, about.
MOST_ASKED_BYTES = 8 << 20


@query("SELECT count(*) AS pairs, sum(CAST(contains(d.text, b.text) AS BIGINT)) AS hits FROM benchmark b, documents d")
def contains_match(s, d):
    """The benchmark is asked against all documents in blocks of checked size, one pass over the documents a block."""
    items = s.read.parquet(f"{d}/benchmark.parquet").select("text")
    n_bytes = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, -(-n_bytes // MOST_ASKED_BYTES))
    docs, found = s.read.parquet(f"{d}/documents.parquet").select("text"), None
    for k in range(n):
        b = items.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == k).agg(F.collect_list("text").alias("items"))
        x = docs.join(F.broadcast(b), F.lit(True)).select(F.size("items").alias("n"), F.size(F.filter("items", lambda t: F.contains(F.col("text"), t))).alias("k"))
        found = x if found is None else found.unionByName(x)
    return found.agg(F.sum("n").cast("long").alias("pairs"), F.sum("k").cast("long").alias("hits"))


@query()
def rouge_l(s, d):
    from hopframe.functions.udfs import rouge_l_f1

    t = _turns(s, d)
    return t.select("conv_id", "turn", F.round(rouge_l_f1("pred", "label"), 6).alias("rouge_l"))


@query()
def hash_embedding(s, d):
    from hopframe.functions.udfs import light_embedding

    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", light_embedding("text").alias("x"))
