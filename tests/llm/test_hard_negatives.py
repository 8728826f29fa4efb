"""Hard negatives against brute force."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from hopframe.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, v array<double>, anchor boolean, distance double, list string"


def brute(rows, positives=5, negatives=10):
    rows = [(i, d, lab, [int(x) for x in v], a) for i, (d, lab, v, a, *_) in enumerate(rows)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    order = lambda t: (-t[0], hn.LAST if t[1] is None else t[1], t[2])
    out = []
    for i, d, lab, v, a in rows:
        if not a:
            continue
        scored = [(dot(v, w), e, j, m) for j, e, m, w, _ in rows]
        pos = sorted((t for t in scored if t[3] == lab and t[2] != i), key=order)[:positives]
        for ps, pid, *_ in pos:
            neg = sorted((t for t in scored if t[3] != lab and 30 * ps <= 100 * t[0] <= 90 * ps), key=order)[:negatives]
            out += [(d, pid, r, t[1], ps, t[0]) for r, t in enumerate(neg, 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    centers = [[rng.gauss(0, 60) for _ in range(8)] for _ in range(12)]
    out = []
    for i in range(600):
        c = centers[0] if rng.random() < 0.35 else rng.choice(centers)  # one hot list
        out.append((i, rng.randrange(4), [float(round(x + rng.gauss(0, 15))) for x in c], i % 30 == 0, 1.5, "clash"))
    out += [(600 + i, i % 4, list(out[40][2]), False, None, None) for i in range(60)]  # many ties
    return out


def test_equals_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(hn, "PART_ROWS", 50)
    monkeypatch.setattr(hn, "QUERY_ROWS", 7)
    monkeypatch.setattr(hn, "WIDTH", 2)
    monkeypatch.setattr(hn, "GROWTH", 3)
    assert sorted(map(tuple, hn.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()), key=repr) == brute(rows)


def test_lists_are_skipped(spark, rows):
    index = hn.Index(spark.createDataFrame(rows, SCHEMA).select("vec_id", "label", "v", "anchor"), len(rows), 8)
    asked = index.rows.filter("anchor").withColumns({"none": F.lit(None).cast("long"), "some": F.lit(20_000).cast("long")})
    chosen = hn.visits(index, 30, 90, 100)
    n = asked.select(*(F.size(chosen("v", w, k, F.lit(0), F.lit(99))) for w, k in (("none", "none"), ("some", "none"), ("none", "some")))).collect()
    free, windowed, stopped = (sum(r[i] for r in n) for i in range(3))
    assert windowed < free and stopped < free / 2


def test_odd_rows(spark, rows):
    big = [(1000 + i, i % 2, [2.0**28 * (i + 1), 3.0 + i, *[float(i)] * 6], i < 2, None, None) for i in range(8)]  # beyond 53 bits
    odd = [*rows[:60], *big, (None, 1, [50.0, 1.0], True, 1.0, "x"), (None, 2, [400.0] * 8, None, 1.0, "x"), rows[0], rows[0], (5, 1, [], True, 0.0, "")]
    assert sorted(map(tuple, hn.hard_negatives(spark.createDataFrame(odd, SCHEMA).coalesce(1)).collect()), key=repr) == brute(odd)


def test_unusable_and_empty(spark, rows):
    bad = [(1, None, [1.0], True), (2, 1, None, True), (3, 1, [1.0, None], True), (4, 1, [float("nan")], True), (5, 1, [float("-inf")], True), (6, 1, [0.5], True)]
    df = spark.createDataFrame(bad, "vec_id long, label int, v array<double>, anchor boolean")
    assert [r.vec_id for r in df.filter(hn.usable("v", "label")).collect()] == [6]
    assert hn.hard_negatives(df.limit(0)).count() == 0
    assert hn.hard_negatives(spark.createDataFrame([(*r[:3], False) for r in rows[:50]], df.schema)).count() == 0


def test_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    rel = con.sql(hn.ORACLE_SQL)
    df = hn.op12(spark, sf)
    assert df.columns == rel.columns
    assert sorted(map(tuple, df.collect())) == sorted(rel.fetchall())
