"""Named sets of tables that are replaced as one.

Tables are written to a folder of their own; a manifest that names the folder is then renamed over the old one, which
the store does at once or not at all. A write that fails leaves the old set as it was, and what it had written goes.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopframe.session import file_system


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file; null if there is none."""
    fs, at = file_system(spark, path)
    return "\n".join(r[0] for r in spark.read.text(path).collect()) if fs.exists(at) else None


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file next to its place and renames it over what is there."""
    jvm, (fs, at) = spark._jvm, file_system(spark, path)
    fs.mkdirs(at.getParent())
    part = jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(part, at, options)


def save(spark: SparkSession, root: str, name: str, tables: dict[str, DataFrame], meta: dict | None = None) -> dict:
    """Replaces the set `name` under root by the given tables, and returns its manifest."""
    old = manifest(spark, root, name)
    folder = f"{root}/{name}-{uuid.uuid4().hex}"
    fs, at = file_system(spark, folder)
    try:
        for table, df in tables.items():
            df.write.parquet(f"{folder}/{table}")
        counts = {table: spark.read.parquet(f"{folder}/{table}").count() for table in tables}
        new = {"folder": folder, "rows": counts, "meta": meta or {}}
        replace_text(spark, f"{root}/{name}.json", json.dumps(new, sort_keys=True))
    except BaseException:
        fs.delete(at, True)
        raise
    if old:
        fs, at = file_system(spark, old["folder"])
        fs.delete(at, True)
    return new


def manifest(spark: SparkSession, root: str, name: str) -> dict | None:
    text = read_text(spark, f"{root}/{name}.json")
    return json.loads(text) if text is not None else None


def load(spark: SparkSession, root: str, name: str = "best") -> tuple[dict[str, DataFrame], dict]:
    """The tables of a set and its meta data. A set that is missing or lacks rows is an error."""
    found = manifest(spark, root, name)
    if found is None:
        raise FileNotFoundError(f"no set {name} under {root}")
    tables = {t: spark.read.parquet(f"{found['folder']}/{t}") for t in found["rows"]}
    for t, n in found["rows"].items():
        if tables[t].count() != n:
            raise ValueError(f"table {t} of {name} does not have its {n} rows")
    return tables, found["meta"]


def kept_parameters(parameters: DataFrame, trainable_only: bool = True) -> DataFrame:
    """Parameters (name, value, trainable) to keep: the trainable ones, or all where none is."""
    if not trainable_only or parameters.filter("trainable").isEmpty():
        return parameters
    return parameters.filter(F.col("trainable"))


def save_state(spark: SparkSession, root: str, parameters: DataFrame, epoch: int, best: bool, optimizer: DataFrame | None = None, state: dict | None = None, trainable_only: bool = True) -> dict:
    """A training state as `best` or under its epoch."""
    tables = {"parameters": kept_parameters(parameters, trainable_only)} | ({} if optimizer is None else {"optimizer": optimizer})
    return save(spark, root, "best" if best else str(epoch), tables, {"epoch": epoch, "trainable_only": trainable_only, "state": state or {}})


def restored(spark: SparkSession, root: str, parameters: DataFrame, name: str = "best") -> DataFrame:
    """parameters with the values of a saved state where it has them; names it alone has are not taken."""
    saved = load(spark, root, name)[0]["parameters"].select("name", F.col("value").alias("_v"))
    return parameters.join(saved, "name", "left").withColumn("value", F.coalesce("_v", "value")).drop("_v")
