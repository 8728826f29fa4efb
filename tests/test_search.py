"""Nearest neighbours: blocks against a plain join, on ties, copies and rows without a cosine."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from hopframe.functions import vectors as V
from hopframe.operators import search

NAN, INF = math.nan, math.inf


def plain(q, v, k):
    x = v.join(q, v["vec_id"] != q["qid"]).select("qid", "vec_id", F.round(V.cosine(F.col("q"), F.col("embedding")), 6).alias("sim"))
    return x.withColumn("rn", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("sim"), "vec_id"))).filter(F.col("rn") <= k).drop("rn")


def rows(df):
    return sorted((r.qid, r.vec_id, repr(r.sim)) for r in df.collect())


def some_vectors():
    r = random.Random(5)
    base = [[r.gauss(0, 1) for _ in range(4)] for _ in range(40)]
    near = [[x + r.gauss(0, 1e-4) for x in base[0]] for _ in range(60)]
    return base + [base[1]] * 30 + [[2 * x for x in base[2]] for _ in range(20)] + near


@pytest.mark.parametrize(
    "vectors",
    [
        some_vectors(),
        [*some_vectors()[:30], None, [0.0] * 4, [NAN, 1.0, 1.0, 1.0], [INF, 0.0, 1.0, 1.0], [1.0, 2.0], [], [None, 1.0, 1.0, 1.0], [0.0] * 4, [3.0, 4.0]] * 2,
        [[1.0, 0.0], [1.0, 0.0], None, [0.0, 0.0], [1.0]],
    ],
    ids=["copies", "odd", "few"],
)
def test_nearest_is_the_plain_join(spark, monkeypatch, vectors):
    monkeypatch.setattr(search, "VECTORS", 32)
    monkeypatch.setattr(search, "QUERIES", 8)
    monkeypatch.setattr(search, "AT_ONCE", 3)
    monkeypatch.setattr(search, "PAIRS", 7)
    v = spark.createDataFrame([*enumerate(vectors), (None, [1.0, 2.0])], "vec_id long, embedding array<float>")
    q = v.filter("vec_id % 3 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    assert rows(search.nearest(q, v, 5)) == rows(plain(q, v, 5))


def test_no_join_of_all_pairs(spark, sf):
    """The query met all pairs one row each, and in one task."""
    from hopframe.plans.kernel_queries import cosine_topk

    plan = cosine_topk(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "FlatMapCoGroupsInArrow" in plan
