"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space that ends a word: the ASCII white-space characters only.
WS = r"[\x20\x09-\x0D]+"
#: The same characters spelled out, for translate().
WS_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; in local mode a temporary one where that is unset."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back; lineage ends here, and lost executors cost no recomputation.

    Spark deletes the files with the DataFrame if its cleaner is set to do so.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def tidied(run):
    """run, a mapInArrow function; at the end of a task its worker gives back the memory that freed arrays still hold.

    Workers outlive their tasks, and the C library and Arrow keep what was freed for the next allocation.
    """

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim is not None:
                trim(0)

    return whole


def partitions_for(spark: SparkSession, rows: int, rows_each: int) -> int:
    """Partitions of about rows_each rows, and no fewer than the cores in use."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // rows_each), 1)


def words(text: Column | str) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text in their order; none for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(text, F.lit("")), WS), lambda w: w != "")


def ranked(df: DataFrame, order: list[Column], sums: dict[str, str], rows_each: int = 200_000) -> DataFrame:
    """df with `rank` (0, 1, ... in the given total order) and, for each name: column in sums, the sum of that
    column over all rows before this one.

    The rows are range-partitioned by the whole order, so one hot leading key spreads over many tasks. Each range
    gets its totals, the totals of the ranges before it are added, and only the totals, one row a range, meet in
    one window. df should hold narrow rows: it is shuffled twice and written once.
    """
    spark = df.sparkSession
    n = partitions_for(spark, df.count(), rows_each)
    placed = df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id())
    placed = checkpointed(placed)
    totals = placed.groupBy("_range").agg(F.count("*").alias("_rows"), *(F.sum(c).alias(f"_sum_{k}") for k, c in sums.items()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "_range",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows"),
        *(F.coalesce(F.sum(f"_sum_{k}").over(before), F.lit(0)).alias(f"_sum_{k}") for k in sums),
    )
    within = Window.partitionBy("_range").orderBy(*order)
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumns(
        {"rank": (F.row_number().over(within) - 1).cast("long")} | {k: F.coalesce(F.sum(c).over(earlier), F.lit(0)) for k, c in sums.items()}
    )
    # one row a range: at most a few thousand
    out = local.join(F.broadcast(totals), "_range")
    return out.withColumns({"rank": F.col("rank") + F.col("_rows")} | {k: F.col(k) + F.col(f"_sum_{k}") for k in sums}).drop("_range", "_rows", *(f"_sum_{k}" for k in sums))
