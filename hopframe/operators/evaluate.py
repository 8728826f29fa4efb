"""Scores of predictions, and the report over a prediction file."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopframe.functions import text as T
from hopframe.sources.checkpoint import replace_text

PREDICTIONS = "id string, pred string, label string, question string, task_type string, gt_path array<string>, domain string, meta struct<witness:string>"


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """A prediction file, one JSON object a line; blank lines don't count, ids may be numbers."""
    return spark.read.schema(PREDICTIONS).json(path)


def indexed_outputs(batches: DataFrame, lists: list[str]) -> DataFrame:
    """A row an example from rows a batch: list-valued columns give their own value, the others repeat."""
    at = F.posexplode(F.arrays_zip(*lists)).alias("_pos", "_row")
    others = [c for c in batches.columns if c not in lists]
    return batches.select(*others, at).select(*others, *(F.col("_row")[c].alias(c) for c in lists))


def scored(predictions: DataFrame, dialect: str = "tasks") -> DataFrame:
    """id, task, label, em, f1, recall, ans, wit of predictions (id, pred, label, question, gt_path and maybe meta) under
    the current rules or, as "legacy", the older ones."""
    q, lab = F.col("question"), F.col("label")
    task = T.legacy_metric_task(q, lab) if dialect == "legacy" else T.metric_task(q, lab, T.task_family(q))
    p = predictions.withColumn("answer", F.trim(T.parsed_answer(F.col("pred")))).withColumn("task", task)
    witness = F.col("meta.witness") if "meta" in predictions.columns else F.lit(None).cast("string")
    number = F.col("task").isin("hop", "counting")
    a = F.when(number, T.first_integer(F.col("answer"))).otherwise(F.col("answer"))
    exact, tf1, recall = T.topic_scores(F.col("answer"), F.col("label"))
    ok, wit = T.witness_scores(F.col("answer"), F.col("label"), F.col("gt_path"), witness)
    topic, path = F.col("task") == "topic", F.col("task") == "path_witness"
    joint = ((ok > 0) & (wit > 0)).cast("double")
    em = F.when(topic, exact).when(path, joint).otherwise((T.normalize(a) == T.normalize(F.col("label"))).cast("double"))
    f1 = F.when(topic, tf1).when(path, joint).otherwise(T.token_f1(a, F.col("label")))
    return p.select("id", "task", "label", em.alias("em"), f1.alias("f1"), F.when(topic, recall).alias("recall"), F.when(path, ok).alias("ans"), F.when(path, wit).alias("wit"))


def report(predictions: DataFrame, dialect: str = "tasks") -> dict:
    """overall and by task: rows and mean scores; a row a task is all that is collected."""
    mean = lambda c, n: F.round(F.avg(c), 6).alias(n)
    means = [F.count("*").alias("n"), mean("em", "em"), mean("f1", "f1"), mean("recall", "keyword_recall"), mean("ans", "answer_accuracy"), mean("wit", "witness_validity")]
    rows = scored(predictions, dialect).rollup("task").agg(F.grouping("task").alias("all"), *means).collect()
    part = lambda r: {k: v for k, v in r.asDict().items() if k not in ("task", "all") and v is not None}
    overall = next((part(r) for r in rows if r["all"]), {"n": 0})
    return {"overall": overall, "tasks": {r["task"]: part(r) for r in sorted(rows, key=lambda r: r["task"] or "") if not r["all"]}}


def formatted(result: dict) -> str:
    """A report as lines of fixed width."""
    lines = [f"{'task':<16}{'n':>8}{'em':>10}{'f1':>10}"]
    for name, r in [("all", result["overall"]), *result["tasks"].items()]:
        lines.append(f"{name:<16}{r['n']:>8}{r.get('em', 0.0):>10.4f}{r.get('f1', 0.0):>10.4f}")
    return "\n".join(lines)


def corpus_means(rows: DataFrame, scores: list[str], by: str | None = None) -> DataFrame:
    """n and the mean of each score over all rows, or by a column (such as the hop) with a row for all (null)."""
    means = [F.count("*").alias("n"), *(F.round(F.avg(c), 6).alias(c) for c in scores)]
    return rows.agg(*means) if by is None else rows.rollup(by).agg(*means)


def dump(spark: SparkSession, result: dict, path: str) -> None:
    """A report as path.json and path.txt, each replaced at once."""
    replace_text(spark, f"{path}.json", json.dumps(result, indent=2, ensure_ascii=False))
    replace_text(spark, f"{path}.txt", formatted(result) + "\n")
