"""Readers and writers of the file formats: raw graph JSON, CSV tables, JSONL, split files and configuration."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hopframe.session import file_system
from hopframe.sources.ranges import read_ranges

def read_table(spark: SparkSession, path: str, schema: str, required: list[str], optional: list[str] = [], sep: str = ",") -> DataFrame:  # noqa: B006
    """A CSV table's required columns and those optional ones it has, by name; an error names the missing.

    The header is read first, so columns may come in any order. Values that their type can't hold are null.
    """
    df = spark.read.csv(path, header=True, sep=sep)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    types = {f.name: f.dataType for f in StructType.fromDDL(schema).fields}
    return df.select(*(F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in [*required, *(c for c in optional if c in df.columns)]))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def indexed_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """raw_index and the fields of a JSONL file's lines, blank ones not counted, in the file's order.

    The order within a file is kept by the reader's splits; a table of several files is in the order of their names.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("k"), "value").filter(F.trim("value") != "")
    blocks = lines.groupBy("f", "b").agg(F.count("*").alias("n"))  # a row a split of a file
    before = F.coalesce(F.sum("n").over(Window.orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("f", "b").orderBy("k")) - 1
    x = lines.withColumn("_rn", rank).join(F.broadcast(blocks.select("f", "b", before.alias("_before"))), ["f", "b"])
    return x.select((F.col("_rn") + F.col("_before")).cast("long").alias("raw_index"), F.from_json("value", schema).alias("r")).select("raw_index", "r.*")


def jsonl_offsets(spark: SparkSession, path: str) -> DataFrame:
    """raw_index, file, at, length of every line that is not blank, files in the order of their names.

    One scan that keeps a line's length only; bytes before a line are summed within its split and over the splits
    before. The table is written once and asked many times.
    """
    meta = lambda c: F.col(f"_metadata.{c}")
    lines = spark.read.option("lineSep", "\n").text(path).select(
        meta("file_path").alias("file"), meta("file_block_start").alias("b"), F.monotonically_increasing_id().alias("k"), F.octet_length("value").cast("long").alias("length"), F.trim(F.replace("value", F.lit("\r"), F.lit(""))).alias("v")
    )
    lines = lines.select("file", "b", "k", "length", (F.col("v") != "").cast("long").alias("some"))
    blocks = lines.groupBy("file", "b").agg(F.sum(F.col("length") + 1).alias("bytes"), F.sum("some").alias("n"))  # a row a split
    before = Window.orderBy("file", "b").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("file").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "b", F.coalesce(F.sum("bytes").over(own), F.lit(0)).alias("_at"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n"))
    inside = Window.partitionBy("file", "b").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    rows = lines.withColumns({"_in": F.coalesce(F.sum(F.col("length") + 1).over(inside), F.lit(0)), "_rn": F.coalesce(F.sum("some").over(inside), F.lit(0))}).filter("some = 1")
    return rows.join(F.broadcast(blocks), ["file", "b"]).select((F.col("_n") + F.col("_rn")).alias("raw_index"), "file", (F.col("_at") + F.col("_in")).alias("at"), "length")


def jsonl_records(wanted: DataFrame, offsets: DataFrame, schema: str) -> DataFrame:
    """The records of wanted (raw_index), each by a read of its own bytes; touching ones share a read. An index that the
    table lacks gives no row."""
    got = read_ranges(offsets.join(wanted.select("raw_index").distinct(), "raw_index"))
    return got.select("raw_index", "read", F.from_json(F.col("data").cast("string"), schema).alias("r")).select("raw_index", "read", "r.*")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """idx of a file of whole numbers, blank lines skipped."""
    return spark.read.text(path).select(F.trim("value").alias("v")).filter("v <> ''").select(F.col("v").cast("long").alias("idx"))


def write_splits(splits: DataFrame, path: str) -> None:
    """split, idx as text files under path/split=name."""
    splits.select("split", F.col("idx").cast("string").alias("value")).write.mode("overwrite").partitionBy("split").text(path)


def strict_config(defaults: dict, given: dict) -> dict:
    """Defaults overlaid with given values; unknown keys are an error."""
    unknown = sorted(set(given) - set(defaults))
    if unknown:
        raise ValueError(f"unknown keys: {', '.join(unknown)}")
    return defaults | given


#: The names under which a dataset folder's metadata is looked for, in order.
METADATA = ("samples.jsonl", "dataset.jsonl", "questions.jsonl", "questions.csv", "samples.csv")


def find_metadata(spark: SparkSession, root: str) -> str | None:
    """The first metadata file a dataset folder has."""
    for name in METADATA:
        fs, at = file_system(spark, f"{root}/{name}")
        if fs.exists(at):
            return f"{root}/{name}"
    return None


def load_metadata(spark: SparkSession, root: str) -> DataFrame:
    """The records of a dataset folder's metadata: of JSON lines with their types, of CSV as texts."""
    path = find_metadata(spark, root)
    if path is None:
        raise FileNotFoundError(f"no metadata file under {root}; looked for {', '.join(METADATA)}")
    return spark.read.json(path) if path.endswith(".jsonl") else spark.read.csv(path, header=True, multiLine=True, escape='"')


def read_sidecar(path: str) -> dict:
    """A JSON sidecar; an unreadable one is empty."""
    try:
        with open(path) as f:
            return json.load(f)
    except (OSError, ValueError):
        return {}
