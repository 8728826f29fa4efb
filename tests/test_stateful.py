"""The queue and the controllers as streams equal the batch operators however the input is cut into batches."""

import random

import pytest
from pyspark.sql import functions as F

from hopframe.operators import control
from hopframe.streaming import stateful

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture(autouse=True)
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    yield
    spark.conf.set(key, old)


def streamed(spark, rows, schema, cuts, make, tmp_path, name):
    """make over rows that come in as many batches as there are cuts, in their order."""
    folder = tmp_path / name
    folder.mkdir()
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.parquet(str(folder / f"in/{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in/*"))
    return stateful.run_once(make(stream), name, str(folder / "state"), "update")


@pytest.mark.parametrize("cuts", [[], [1, 2, 50], [30, 60]])
def test_queue(spark, tmp_path, cuts):
    rng = random.Random(3)
    rows = [(i, float(i // 3), rng.randrange(4)) for i in range(90)]
    schema = "event_id long, ts double, user_id long"
    got = streamed(spark, rows, schema, cuts, lambda d: stateful.fifo_queue(d, 7), tmp_path, f"queue{len(cuts)}")
    last = got.groupBy("queue", "slot").agg(F.max("n").alias("n"), F.max_by("event_id", "n").alias("event_id"))
    want = stateful.queue_contents(spark.createDataFrame(rows, schema), 7)
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect())) and want.count() == 28


@pytest.mark.parametrize("cuts", [[], [1, 17], [5, 6, 7]])
def test_controllers(spark, tmp_path, cuts):
    rng = random.Random(9)
    rows = [(run, e, None if rng.random() < 0.1 else rng.choice([-1.0, round(rng.random(), 3), 0.62, 0.55]), round(rng.random(), 3)) for e in range(20) for run in (1, 2)]
    schema = "run long, epoch long, progress double, digit8_rate double"
    df = spark.createDataFrame(rows, schema)
    reset, drive = (0.6, 0.02, 0.01, 3), {"hold": (0.4, 0.5), "target": (0.3, 0.2, 0.05), "band": (0.2, 0.7, 0.02, 0.3, 0.4)}
    resets = streamed(spark, rows, schema, cuts, lambda d: stateful.reset_stream(d, *reset), tmp_path, f"resets{len(cuts)}").collect()
    weights = streamed(spark, rows, schema, cuts, lambda d: stateful.progress_stream(d, 0.8, 0.1, 0.9, 0.07, 0.5, **drive), tmp_path, f"weights{len(cuts)}").collect()
    for run in (1, 2):
        own = df.filter(F.col("run") == run)
        want = control.momentum_resets(own.select("epoch", "progress"), *reset).collect()
        assert sorted((r.epoch, r.reset) for r in resets if r.run == run) == sorted(map(tuple, want))
        want = control.progress_controller(own.select("epoch", "progress", "digit8_rate"), 0.8, 0.1, 0.9, 0.07, 0.5, **drive).collect()
        assert sorted((r.epoch, round(r.ema, 6), round(r.weight, 6)) for r in weights if r.run == run) == sorted(map(tuple, want))
    assert any(r.reset for r in resets)
