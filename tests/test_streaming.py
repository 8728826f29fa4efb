from pyspark.sql import functions as F

from hopframe.streaming import stateful


def folder(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    e.repartitionByRange(3, "event_id").write.parquet(str(tmp_path / "events"))
    return str(tmp_path / "events"), e


def rows(df, *cols):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())


def test_scores_equal_batch(spark, sf, tmp_path):
    path, e = folder(spark, sf, tmp_path)
    got = stateful.run_once(stateful.scores(stateful.read_events(spark, path)), "scores", str(tmp_path / "c1"))
    assert rows(got, "user_id", "score_sum", "n") == rows(stateful.scores(e), "user_id", "score_sum", "n")


def test_slots_and_windows(spark, sf, tmp_path):
    path, e = folder(spark, sf, tmp_path)
    got = stateful.run_once(stateful.latest_in_slots(stateful.read_events(spark, path), 16), "slots", str(tmp_path / "c2"))
    assert rows(got, "slot", "event_id") == rows(stateful.latest_in_slots(e, 16), "slot", "event_id")
    win = stateful.run_once(stateful.windowed_rates(stateful.read_events(spark, path, 3)), "windows", str(tmp_path / "c3"), "append")
    whole = {r[:2]: r[2:] for r in rows(stateful.windowed_rates(e.withColumn("ts", F.col("ts").cast("timestamp"))), "start", "event_type", "n", "mean")}
    got = rows(win, "start", "event_type", "n", "mean")
    assert got and all(whole[r[:2]] == r[2:] for r in got)


def test_exponential_means(spark, sf, tmp_path):
    path, e = folder(spark, sf, tmp_path)
    got = stateful.run_once(stateful.exponential_means(stateful.read_events(spark, path, 3), 0.8), "ema", str(tmp_path / "c4"), "update")
    want = {}
    for r in e.orderBy("ts", "event_id").collect():
        m, n = want.get(r["user_id"], (None, 0))
        want[r["user_id"]] = (r["value"] if m is None else 0.8 * m + 0.2 * r["value"], n + 1)
    assert {r["user_id"]: (round(r["ema"], 6), r["n"]) for r in got.collect()} == {k: (round(m, 6), n) for k, (m, n) in want.items()}


def test_best_so_far(spark, sf, tmp_path):
    path, e = folder(spark, sf, tmp_path)
    got = stateful.run_once(stateful.best_so_far(stateful.read_events(spark, path, 3), 4), "best", str(tmp_path / "c5"), "update")
    want = {}
    for r in e.orderBy("ts", "event_id").collect():
        best, wait, stop = want.get(r["user_id"], (float("inf"), 0, False))
        best, wait = (r["value"], 0) if r["value"] < best else (best, wait + 1)
        want[r["user_id"]] = (best, wait, stop or wait >= 4)
    assert {r["user_id"]: (r["best"], r["wait"], r["stop"]) for r in got.collect()} == want


def test_reservoir_does_not_depend_on_batches(spark, sf, tmp_path):
    from hopframe.functions.hashing import h

    path, e = folder(spark, sf, tmp_path)
    got = stateful.run_once(stateful.bottom_k(stateful.read_events(spark, path), 32, 5, h), "kept", str(tmp_path / "c6"))
    assert rows(got, "slot", "event_id") == rows(stateful.bottom_k(e, 32, 5, h), "slot", "event_id") and got.count() <= 32
