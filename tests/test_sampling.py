"""Sampling asks for the edges around what it has reached, with the ids that they have in the full graph."""

import pytest

from hopframe.operators import graph
from hopframe.sources import testgraph

COLUMNS = ("src_idx", "dst_idx", "src_id", "dst_id", "edge_attr", "edge_id")


@pytest.mark.parametrize("limit", [500_000, 0], ids=["few", "many"])
def test_edges_around_nodes_keep_their_ids(spark, sf, monkeypatch, limit):
    monkeypatch.setattr(testgraph, "few", lambda df, few=testgraph.few: few(df, limit))
    off = testgraph.offsets(spark, sf)
    asked = [0, off["nation"] + 3, off["supplier"] + 1, off["customer"] + 7, off["part"] + 2, off["part"] + 5, off["orders"] + 11, 10**9]
    around = spark.createDataFrame([(i,) for i in asked + asked[:2]], "node_idx long")
    rows = lambda df: sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())
    want = [r for r in rows(testgraph.edges(spark, sf, numbered=True)) if r[0] in asked or r[1] in asked]
    got = rows(testgraph.edges(spark, sf, numbered=True, around=around))
    assert got == want and {"region", "nation", "customer", "part", "supplier"} == {r[4] for r in got}


def test_a_sample_ranks_only_edges_into_what_it_reached(spark):
    links = [(i, i % 7, i) for i in range(7, 60)] + [(i, i + 7, 100 + i) for i in range(7)] + [(1, 1, 300), (200, 201, 301)]
    e = spark.createDataFrame(links, "src_idx long, dst_idx long, edge_id long")
    seeds = spark.createDataFrame([(1, 1), (1, 9), (2, 3), (2, 3)], "qid long, node_idx long")
    asked = []

    def into(front):
        asked.append({r.node_idx for r in front.collect()})
        return e

    rows = lambda x: [sorted(map(tuple, df.collect())) for df in x]
    nodes, edges = rows(graph.sample_neighbourhood(seeds, into, [4, 2], 23))
    assert [nodes, edges] == rows(graph.sample_neighbourhood(seeds, e, [4, 2], 23))
    assert asked == [{1, 3, 9}, {n for _, n, hop in nodes if hop == 1}]
    for qid, node, hop in nodes:
        took = sorted((s, t, i) for q, s, t, i, k in edges if q == qid and t == node)
        near = spark.createDataFrame([x for x in links if x[1] == node] or [(0, 0, 0)], e.schema).orderBy(graph.h("edge_id", 23), "edge_id").limit((4, 2, 0)[hop])
        assert took == sorted(tuple(r) for r in near.collect() if r.dst_idx == node)
