"""A store of vectors with a fixed stride, and a gather that reads only the strides of sampled ids.

Vectors of the ids 0 to n - 1 lie in segment files, one after another, as little-endian floats of 16 or 32 bits. A
manifest names the segments; it comes last, and only if every id has come exactly once with a vector of the right
length. Files are written under names of their own, so a task that is run again does not disturb another's.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.errors import PythonException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopframe.session import file_system
from hopframe.sources.checkpoint import read_text, replace_text
from hopframe.sources.ranges import opened, read_ranges

#: Vectors of a segment file.
SEGMENT = 1 << 20
TYPES = {"float16": "<f2", "float32": "<f4"}


def write(vectors: DataFrame, path: str, dim: int, dtype: str = "float16", segment: int = SEGMENT, source: dict | None = None) -> dict:
    """Writes vectors (node_idx, x) to a store at path and returns its manifest; source says what they were made of.

    Ids that are missing, repeated or out of order, and vectors of another length, are errors; the store then has no
    manifest.
    """
    kind, spark = TYPES[dtype], vectors.sparkSession

    def stored(batches):
        import uuid

        import numpy as np

        done, now, out, first, name, n = [], None, None, 0, "", 0

        def close():
            out.close()
            done.append((now, name, first, n))

        for b in batches:
            for seg in np.unique(b.column(0).to_numpy()):  # in order
                mine = b.filter(pa.compute.equal(b.column(0), int(seg)))
                if seg != now:
                    if out:
                        close()
                    now, first, n, name = int(seg), int(seg) * segment, 0, f"{int(seg):08d}-{uuid.uuid4().hex}.vec"
                    store, at = opened(path)
                    store.create_dir(at, recursive=True)
                    out = store.open_output_stream(f"{at}/{name}")
                ids, x = mine.column(1).to_numpy(), mine.column(2)
                if (ids != np.arange(first + n, first + n + len(ids))).any():
                    raise ValueError(f"ids from {first + n} on are not complete and distinct")
                if x.null_count or (np.diff(x.offsets.to_numpy()) != dim).any():
                    raise ValueError(f"a vector after {first + n} has not {dim} numbers")
                out.write(x.flatten().to_numpy(zero_copy_only=False).astype(kind).tobytes())
                n += len(ids)
        if out:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["segment", "file", "first", "n"])

    total, least, most = vectors.agg(F.count("*"), F.min("node_idx"), F.max("node_idx")).first()
    if not total or least or most != total - 1:
        raise ValueError(f"{total} vectors with ids from {least} to {most}")
    rows = vectors.select(F.floor(F.col("node_idx") / segment).alias("_s"), F.col("node_idx").cast("long"), F.col("x").cast("array<float>"))
    rows = rows.repartition(-(-total // segment), "_s").sortWithinPartitions("_s", "node_idx")
    try:
        # a row a segment
        parts = sorted(tuple(r) for r in rows.mapInArrow(stored, "segment long, file string, first long, n long").collect())
    except PythonException as e:
        raise ValueError(str(e)) from e
    if sum(p[3] for p in parts) != total or [p[0] for p in parts] != list(range(-(-total // segment))):
        raise ValueError("segments are missing")
    made = {"n": total, "dim": dim, "dtype": dtype, "segment": segment, "files": [p[1] for p in parts], "source": source or {}}
    replace_text(spark, f"{path}/manifest.json", json.dumps(made))
    return made


def manifest(spark: SparkSession, path: str) -> dict | None:
    text = read_text(spark, f"{path}/manifest.json")
    return json.loads(text) if text is not None else None


def complete(spark: SparkSession, path: str, n: int, dim: int, dtype: str = "float16", source: dict | None = None) -> bool:
    """Whether a store holds just these vectors: the manifest says so and the files have the bytes."""
    m = manifest(spark, path)
    if not m or (m["n"], m["dim"], m["dtype"], m["source"]) != (n, dim, dtype, source or {}):
        return False
    fs, at = file_system(spark, path)
    sizes = {s.getPath().getName(): s.getLen() for s in fs.listStatus(at)}
    stride = dim * int(TYPES[dtype][2])
    return all(sizes.get(f) == stride * min(m["segment"], n - k * m["segment"]) for k, f in enumerate(m["files"]))


def materialized(vectors: DataFrame, path: str, dim: int, dtype: str = "float16", source: dict | None = None) -> dict:
    """The store at path, written only if what is there does not fit."""
    spark = vectors.sparkSession
    if complete(spark, path, vectors.count(), dim, dtype, source):
        return manifest(spark, path)
    return write(vectors, path, dim, dtype, source=source)


def gather(sampled: DataFrame | None, path: str, spark: SparkSession) -> DataFrame:
    """sampled (node_idx and others) with x, the stored vectors as floats, and read, the bytes of each read.

    A graph that was not sampled is refused: its vectors would be the whole store.
    """
    if sampled is None or "node_idx" not in sampled.columns:
        raise ValueError("vectors in a store can be had for sampled graphs only, whose rows have node_idx")
    m = manifest(spark, path)
    if m is None:
        raise FileNotFoundError(f"no complete store at {path}")
    kind, dim = TYPES[m["dtype"]], m["dim"]
    stride = dim * int(kind[2])
    files = F.array(*(F.lit(f"{path}/{f}") for f in m["files"])) if len(m["files"]) < 100 else None
    rows = sampled.withColumn("_s", F.floor(F.col("node_idx") / m["segment"]))
    if files is not None:
        rows = rows.withColumn("file", F.get(files, F.col("_s").cast("int")))
    else:  # a row a segment
        names = spark.createDataFrame([(k, f"{path}/{f}") for k, f in enumerate(m["files"])], "_s long, file string")
        rows = rows.join(F.broadcast(names), "_s", "left")
    rows = rows.withColumn("file", F.when((F.col("node_idx") >= 0) & (F.col("node_idx") < m["n"]), F.col("file")).otherwise(F.raise_error(F.concat(F.lit("no vector of node "), F.col("node_idx").cast("string")))))
    rows = rows.withColumns({"at": F.col("node_idx") % m["segment"] * stride, "length": F.lit(stride).cast("long")}).drop("_s")
    got = read_ranges(rows)

    def decoded(data: pa.Array) -> pa.Array:
        import numpy as np

        values = np.frombuffer(b"".join(data.to_pylist()), kind).astype(np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, dim, dtype=np.int32)), pa.array(values))

    from pyspark.sql.pandas.functions import ArrowUDFType
    from pyspark.sql.types import ArrayType, FloatType

    x = F.arrow_udf(decoded, ArrayType(FloatType()), ArrowUDFType.SCALAR)("data")
    return got.withColumn("x", x).drop("file", "at", "length", "data")
