"""Seeds against a plain reading of the tiers."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hopframe.operators import seeds


def brute(n, edges, budget, forced, primary, secondary):
    out = []

    def add(ids):
        out.extend(x for x in dict.fromkeys(ids) if x is not None and 0 <= x < n and x not in out)

    for ids in (forced or [], *primary, *secondary):
        add(ids or [])
    deg = Counter(x for e in edges for x in e)
    add(range(n) if n <= budget else sorted(range(n), key=lambda i: (-deg[i], i))[:budget])
    return out[:budget]


@pytest.mark.parametrize("budget", [1, 4, 9, 40])
def test_tiers(spark, budget):
    rng = random.Random(6)
    n, edges = 20, [(rng.randrange(20), rng.randrange(8)) for _ in range(50)]
    rows = [(q, rng.choice([None, [], [3, 3, 99, -1, 5]]), [rng.randrange(22) for _ in range(3)], rng.choice([None, [7, 1]]), [rng.randrange(20) for _ in range(2)]) for q in range(6)]
    df = spark.createDataFrame(rows, "qid long, forced array<int>, query_nodes array<int>, root_nodes array<int>, seed_nodes array<int>")
    nodes = spark.createDataFrame([(i, i in (2, 11), None if i % 2 else i == 4, False) for i in range(n)], "node_idx long, query_mask boolean, target_mask boolean, none boolean")
    links = spark.createDataFrame(edges, "src_idx long, dst_idx long")
    got = seeds.select_seeds(
        df, nodes, links, budget, seeds.listed(df, "forced"), [seeds.listed(df, "query_nodes"), seeds.listed(df, "root_nodes"), seeds.marked(df, nodes, "query_mask")],
        [seeds.listed(df, "seed_nodes"), seeds.marked(df, nodes, "target_mask"), seeds.marked(df, nodes, "none")],
    )
    for q, forced, asked, roots, kept in rows:
        own = [r.node_idx for r in sorted(got.filter(F.col("qid") == q).collect(), key=lambda r: r.ord)]
        assert own == brute(n, edges, budget, forced, [asked, roots, [2, 11]], [kept, [4], []])
