"""Normalized adjacency against its definition, and text scores that split each text once."""

from collections import Counter
from math import sqrt

import pytest

from hopframe.operators import graph
from hopframe.plans import catalog

LINKS = [(1, 2), (2, 1), (1, 2), (3, 3), (4, 1), (5, None), (5, None), (None, None), (None, 2), (9, 8), (6, 6)]


@pytest.mark.parametrize("binary", [False, True])
def test_normalized(spark, binary):
    rows = [(u, v, 2 if u == v else 1) for u, v in LINKS] + [(n, n, 1) for n in range(1, 7)]
    way = Counter([x for u, v in LINKS for x in ((u, v), (v, u))] + [(n, n) for n in range(1, 7)])
    way = dict.fromkeys(way, 1) if binary else way
    deg = Counter()
    for (u, _), w in way.items():
        deg[u] += w
    want = {(u, v): round(w / sqrt(deg[u] * deg[v]), 6) for (u, v), w in way.items() if u is not None and v is not None}
    got = graph.normalized(spark.createDataFrame(rows, "u long, v long, c int"), binary).collect()
    assert len(got) == len(want) and {(r.u, r.v): r.w for r in got} == pytest.approx(want)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_weighted_query_reads_its_edges_once_for_sums_and_weights(spark, sf):
    df = catalog.QUERIES["normalized_adjacency_weighted"](spark, sf)
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in text


def test_token_f1_normalizes_each_text_once(spark, sf):
    assert plan(catalog.QUERIES["token_f1"](spark, sf)).count("translate(") == 2


def test_missing_metadata_samples_nothing(spark, sf):
    assert "edge_id" not in plan(catalog.QUERIES["missing_metadata"](spark, sf))
