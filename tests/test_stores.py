"""Stores that are read by ranges, and sets of tables that are replaced as one."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from hopframe.sources import checkpoint, files, vectors


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(5000, 16)).astype(np.float32)
    return x, spark.createDataFrame([(i, x[i].tolist()) for i in range(len(x))], "node_idx long, x array<float>").repartition(5)


@pytest.mark.parametrize("dtype", ["float16", "float32"])
def test_gather_reads_only_the_sampled_strides(spark, tmp_path, table, dtype):
    x, df = table
    path = str(tmp_path / "store")
    made = vectors.write(df, path, 16, dtype, segment=700)
    assert made["n"] == 5000 and len(made["files"]) == 8 and vectors.complete(spark, path, 5000, 16, dtype)
    size = sum(f.stat().st_size for f in (tmp_path / "store").glob("*.vec"))
    assert size == 5000 * 16 * (2 if dtype == "float16" else 4)
    ids = [i for i in range(5000) if i % 100 == 7]
    got = vectors.gather(spark.createDataFrame([(f"q{i % 3}", i) for i in ids], "qid string, node_idx long"), path, spark).collect()
    assert sorted((r.qid, r.node_idx) for r in got) == sorted((f"q{i % 3}", i) for i in ids)
    assert all(np.array_equal(np.array(r.x, np.float32), x[r.node_idx].astype(dtype).astype(np.float32)) for r in got)
    assert sum(r.read for r in got) == size // 100 and sum(r.read > 0 for r in got) == len(ids)
    near = vectors.gather(spark.createDataFrame([(i,) for i in range(690, 720)], "node_idx long").coalesce(1), path, spark).collect()
    assert sum(r.read > 0 for r in near) == 2 and len(near) == 30  # two files, a read each


def test_stores_are_checked(spark, tmp_path, table):
    _, df = table
    path = str(tmp_path / "store")
    for bad in (df.filter("node_idx <> 44"), df.unionByName(df.limit(1)), df.filter("node_idx <> 44").unionByName(df.filter("node_idx = 45")), df.withColumn("x", F.when(F.col("node_idx") != 9, F.col("x")).otherwise(F.slice("x", 1, 3))), df.withColumn("x", F.when(F.col("node_idx") != 9, F.col("x"))), df.limit(0)):
        with pytest.raises(ValueError):
            vectors.write(bad, path, 16)
        assert vectors.manifest(spark, path) is None and not vectors.complete(spark, path, 5000, 16)
    with pytest.raises(FileNotFoundError):
        vectors.gather(df, path, spark)
    for unsampled in (None, spark.range(3)):
        with pytest.raises(ValueError, match="sampled graphs only"):
            vectors.gather(unsampled, path, spark)
    first = vectors.materialized(df, path, 16, source={"model": "a"})
    assert vectors.materialized(df, path, 16, source={"model": "a"}) == first
    assert vectors.materialized(df, path, 16, source={"model": "b"})["files"] != first["files"]
    with pytest.raises(Exception, match="no vector of node 5000"):
        vectors.gather(spark.createDataFrame([(5000,)], "node_idx long"), path, spark).collect()
    (tmp_path / "store" / vectors.manifest(spark, path)["files"][0]).write_bytes(b"short")
    assert not vectors.complete(spark, path, 5000, 16, source={"model": "b"})


def test_jsonl_by_offset(spark, tmp_path):
    rows = [{"i": i, "t": "é" * (i % 40)} for i in range(3000)]
    for part in range(3):
        text = "".join(json.dumps(r, ensure_ascii=False) + ("\r\n" if r["i"] % 5 == 0 else "\n") + ("\n \n" if r["i"] % 11 == 0 else "") for r in rows[part * 1000 : part * 1000 + 1000])
        (tmp_path / f"{part}.jsonl").write_text(text.rstrip("\n") if part == 1 else text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        offsets = files.jsonl_offsets(spark, str(tmp_path)).cache()
        assert offsets.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    wanted = [0, 5, 999, 1000, 1999, 2000, 2500, 2999, 7777]
    got = files.jsonl_records(spark.createDataFrame([(i,) for i in [*wanted, 5]], "raw_index long"), offsets, "i long, t string").collect()
    assert sorted((r.raw_index, r.i, r.t) for r in got) == [(i, i, "é" * (i % 40)) for i in wanted[:-1]]
    assert sum(r.read > 0 for r in got) == 8 and sum(r.read for r in got) < 1000


def test_a_failing_write_leaves_the_last_set(spark, tmp_path):
    root = str(tmp_path / "c")
    p = spark.createDataFrame([("a", 1.0, True), ("b", 2.0, False)], "name string, value double, trainable boolean")
    with pytest.raises(FileNotFoundError):
        checkpoint.load(spark, root)
    checkpoint.save_state(spark, root, p, 3, True, state={"seen": 7})
    broken = p.withColumn("value", F.when(F.col("name") == "a", F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="lost"):
        checkpoint.save_state(spark, root, p, 4, True, optimizer=broken)
    tables, meta = checkpoint.load(spark, root)
    assert [tuple(r) for r in tables["parameters"].collect()] == [("a", 1.0, True)] and meta == {"epoch": 3, "trainable_only": True, "state": {"seen": 7}}
    assert len([f for f in (tmp_path / "c").iterdir() if f.is_dir()]) == 1
    new = spark.createDataFrame([("a", 0.0, True), ("b", 9.0, False), ("z", 5.0, True)], "name string, value double, trainable boolean")
    assert sorted((r.name, r.value) for r in checkpoint.restored(spark, root, new).collect()) == [("a", 1.0), ("b", 9.0), ("z", 5.0)]
    checkpoint.save_state(spark, root, new, 5, True)
    checkpoint.save_state(spark, root, p.withColumn("trainable", F.lit(False)), 6, False)
    assert checkpoint.load(spark, root)[1]["epoch"] == 5 and checkpoint.load(spark, root, "6")[0]["parameters"].count() == 2
    assert len([f for f in (tmp_path / "c").iterdir() if f.is_dir()]) == 2
