"""Frontier loops that run to their end, caps, and balanced pairs that fail when short."""

from collections import Counter, deque

import pytest

from hopframe.operators import graph, hopqa


def und(spark, links):
    return spark.createDataFrame([(a, b) for u, v in links for a, b in ((u, v), (v, u))], "u long, v long")


def bfs(links, src, inside):
    near = {}
    for u, v in links:
        if u in inside and v in inside:
            near.setdefault(u, []).append(v)
            near.setdefault(v, []).append(u)
    d, q = {src: 0}, deque([src])
    while q:
        x = q.popleft()
        for y in near.get(x, []):
            if y not in d:
                d[y] = d[x] + 1
                q.append(y)
    return d


def test_chains_and_cut_subgraphs_get_true_distances(spark):
    links = [(i, i + 1) for i in range(13)] + [(0, 13), (20, 21)]  # a ring of fourteen and a pair apart
    subs = {1: list(range(14)), 2: list(range(13)), 3: [0, 1, 5, 6, 20], 4: [3, 4]}  # whole, opened to a chain, in pieces, without the ends
    ends = {1: (0, 7), 2: (0, 12), 3: (0, 6), 4: (0, 1)}
    pairs = spark.createDataFrame([(q, *e) for q, e in ends.items()], "qid long, src long, dst long")
    sub = spark.createDataFrame([(q, n) for q, ns in subs.items() for n in ns], "qid long, node_idx long")
    got = {(r.qid, r.node_idx): r for r in graph.roles(pairs, und(spark, links), sub).collect()}
    assert len(got) == sum(map(len, subs.values()))
    for q, ns in subs.items():
        src, dst = ends[q]
        a, b, far = (bfs(links, src, ns) if src in ns else {}), (bfs(links, dst, ns) if dst in ns else {}), len(ns) + 1
        for n in ns:
            r = got[q, n]
            assert (r.d_src, r.d_dst, r.disconnected) == (a.get(n, far), b.get(n, far), dst not in a)
            delta = -1 if dst not in a or far in (r.d_src, r.d_dst) else max(0, r.d_src + r.d_dst - a[dst])
            assert r.delta == delta and r.role == (0 if n == src else 1 if n == dst else 2 if delta == 0 else 3)


def test_a_source_that_sees_too_much_gives_nothing_further_out(spark):
    links = [(0, i) for i in range(1, 6)] + [(1, i) for i in range(10, 20)] + [(30, 31), (31, 32), (32, 33)]
    src = spark.createDataFrame([(0,), (30,)], "node_idx long")
    got = Counter((r.src, len(r.path) - 1) for r in graph.bfs_paths(src, und(spark, links), 3, 7).collect())
    assert got == {(0, 0): 1, (0, 1): 5, (30, 0): 1, (30, 1): 1, (30, 2): 1, (30, 3): 1}
    assert Counter((r.src, len(r.path) - 1) for r in graph.bfs_paths(src, und(spark, links), 3, 6).collect())[0, 1] == 0


def test_balanced_pairs(spark):
    links = [(i, (i + k) % 60) for i in range(60) for k in (1, 7)]
    nodes = spark.createDataFrame([(i,) for i in range(70)], "node_idx long")  # ten without neighbours
    edges = spark.createDataFrame(links, "src_idx long, dst_idx long")
    pairs, account = hopqa.balanced(nodes, edges, und(spark, links), 47, 1, 3, 5, batch=3)
    rows = pairs.collect()
    assert account["per_hop"] == {1: 16, 2: 16, 3: 15} == dict(Counter(r.hop for r in rows)) and account["attempts"] > 9
    assert len({(r.src, r.dst) for r in rows}) == 47
    for r in rows:
        assert bfs(links, r.src, range(60))[r.dst] == r.hop == len(r.path) - 1 and (r.path[0], r.path[-1]) == (r.src, r.dst)
        assert all((a, b) in set(links) | {(y, x) for x, y in links} for a, b in zip(r.path, r.path[1:], strict=False))
    again = hopqa.balanced(nodes, edges, und(spark, links), 47, 1, 3, 5, batch=3)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))
    for args in ({"max_attempts": 3}, {"max_visited": 4}):
        with pytest.raises(RuntimeError, match="only [0-9]+ of 47 pairs after [0-9]+ attempts"):
            hopqa.balanced(nodes, edges, und(spark, links), 47, 1, 3, 5, batch=3, **args)
    for bad in ((0, 1, 3), (5, 0, 3), (5, 3, 2)):
        with pytest.raises(ValueError):
            hopqa.balanced(nodes, edges, und(spark, links), *bad, 5)
    with pytest.raises(ValueError, match="no node has a neighbour"):
        hopqa.balanced(nodes, edges.limit(0), und(spark, links).limit(0), 5, 1, 2, 5)
