"""Token files: ORC with run-length encoded ids, row indexes and Bloom filters on document ids.

Documents are range-partitioned by id, each range is encoded and written as one ORC file in ascending id order, so
files and stripes hold narrow id ranges: readers skip files by their statistics, stripes by row indexes and Bloom
filters, and read stripes in parallel. The ids are a list<int> column, which ORC stores with integer run-length
encoding.

Null and empty texts give the end id alone. Null document ids come first. Rows that share an id keep one file
position each, ordered by a hash of their text; equal rows are interchangeable. An empty table gives an empty
dataset. Other columns of the input are not written.
"""

from __future__ import annotations

import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopframe.llm.common import partitions_for, shared_folder, table, tidied

SCHEMA = "chunk int, row int, doc_id long, n_tokens int, ids array<int>"
#: Documents a file holds, about.
ROWS_PER_FILE = 10_000
OPTIONS = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20), "compression": "zstd"}


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write_token_files(docs: DataFrame, path: str, vocabulary_path: str, end_id: int, word_spaces: bool, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Encodes docs (doc_id, text), appends end_id to each, and writes the ORC dataset at path."""

    def encoded(batches):
        import numpy as np

        from hopframe.llm.token_cache import tokenizer

        chunk, row, tok = TaskContext.get().partitionId(), 0, tokenizer(vocabulary_path, word_spaces)
        for batch in batches:
            for first, raw, offsets in tok.encode(batch.column(1), end_id):
                n, sizes = len(offsets) - 1, np.diff(offsets).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(raw.view("<i4")))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk, np.int32)), pa.array(np.arange(row, row + n, dtype=np.int32)), batch.column(0).slice(first, n), pa.array(sizes), ids], ["chunk", "row", "doc_id", "n_tokens", "ids"])
                row += n

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    n = partitions_for(spark, docs.count(), rows_per_file)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed.mapInArrow(tidied(encoded), SCHEMA).write.options(**OPTIONS).orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, all from the files."""

    def summed(batches):
        import numpy as np

        for b in batches:
            ids = b.column(3)
            ends, values = ids.offsets.to_numpy(), np.ascontiguousarray(ids.values.to_numpy(), "<i4").view(np.uint8)
            crc = [zlib.crc32(values[4 * s : 4 * e]) for s, e in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], ["chunk", "row", "doc_id", "n_tokens", "ids_crc32"])

    files = spark.read.schema(SCHEMA).orc(path)
    before = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    # one row a file
    totals = files.groupBy("chunk").agg(F.sum("n_tokens").alias("_n")).select("chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = files.select("chunk", "row", "doc_id", "ids").mapInArrow(tidied(summed), "chunk int, row int, doc_id long, n_tokens long, ids_crc32 long")
    inside = Window.partitionBy("chunk").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return rows.join(F.broadcast(totals), "chunk").select("doc_id", (F.col("_inside") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The documents with these ids; files, stripes and row groups that cannot hold them are skipped."""
    return spark.read.schema(SCHEMA).orc(path).filter(F.col("doc_id").isin(doc_ids))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"), 1, True)
    return read_token_files(spark, path)
