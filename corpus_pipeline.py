"""The corpus pipeline: STAGES applied to documents, each stage's rows written as Parquet and read as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hopframe.llm import mixing, ngram_join, packing, quality_rules, suffix_dedup
from hopframe.llm.common import table
from hopframe.session import scratch

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("ngram_jaccard_join", ngram_join.stage),
    ("suffix_dedup", suffix_dedup.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each result but the last is written under the shared checkpoint folder, until the
    application ends.

    Null and repeated ids, null and empty texts, repeated rows, ties and an empty table go through as each stage's
    docstring says; columns of documents are kept, whatever their names, up to the last stage.
    """
    docs, base = table(spark, sf_dir, "documents"), scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(out := f"{base}/{k}-{name}")
            docs = spark.read.parquet(out)
    return docs
