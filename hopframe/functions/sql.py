"""The library's text functions as SQL functions of a session; their bodies are built-in expressions, not user code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from hopframe.functions import text as T

_TOKENS = "filter(split(hf_normalize({0}), ' '), t -> t <> '')"
_P, _Q = _TOKENS.format("pred"), _TOKENS.format("label")
_HITS = f"size(filter({_P}, t -> array_contains({_Q}, t)))"
_PRECISION, _RECALL = f"({_HITS} / greatest(size({_P}), 1))", f"({_HITS} / greatest(size({_Q}), 1))"
#: Functions with lambdas, whose text Spark does not give back.
WRITTEN = {
    "hf_token_f1": f"CASE WHEN size({_P}) > 0 AND size({_Q}) > 0 AND {_HITS} > 0 THEN 2 * {_PRECISION} * {_RECALL} / ({_PRECISION} + {_RECALL}) ELSE 0.0D END",
    "hf_csv_list": "filter(transform(split(coalesce(x, ''), ','), t -> trim(t)), t -> t <> '')",
}
#: name: function of columns, names and types of its arguments, type of its result.
FUNCTIONS: dict[str, tuple[Callable[..., Column], str, str]] = {
    "hf_normalize": (T.normalize, "x STRING", "STRING"),
    "hf_task_family": (T.task_family, "question STRING", "STRING"),
    "hf_output_mode": (T.output_mode, "family STRING", "STRING"),
    "hf_prompt": (T.prompt, "family STRING", "STRING"),
    "hf_first_integer": (T.first_integer, "x STRING", "STRING"),
    "hf_metric_task": (T.metric_task, "question STRING, label STRING, declared STRING", "STRING"),
    "hf_token_f1": (T.token_f1, "pred STRING, label STRING", "DOUBLE"),
    "hf_csv_list": (T.csv_list, "x STRING", "ARRAY<STRING>"),
    "hf_parse_bool": (T.parse_bool, "x STRING", "BOOLEAN"),
}


def body(spark: SparkSession, function: Callable[..., Column], arguments: str) -> str:
    """The SQL text of a function of columns."""
    schema = arguments.replace(" STRING", " string")
    names = [a.split()[0] for a in arguments.split(", ")]
    plan = spark.createDataFrame([], schema).select(function(*map(F.col, names)).alias("_"))._jdf.queryExecution().analyzed()
    return plan.expressions().head().child().sql()


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session's SQL, and returns their names."""
    for name, (function, arguments, result) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {WRITTEN.get(name) or body(spark, function, arguments)}")
    return sorted(FUNCTIONS)
