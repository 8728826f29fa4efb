"""Layouts against the tokenizer itself, batches and descriptions against plain Python."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hopframe.operators import describe, layout

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("with_labels", [True, False])
def test_text_layout(spark, with_labels):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(0, 1, "who is it?", "a graph of words and more words", "an answer of several tokens", 3), (0, 2, "é?", None, "x", 0), (0, 3, "", "", "", None), (1, 4, "only one " * 9, "d", "yes", -2)]
    df = spark.createDataFrame(rows, "batch long, id long, question string, desc string, label string, graph_tokens int")
    got = {r.id: r for r in layout.text_layout(df, path, 9, 4, 2, with_labels).collect()}
    tok = layout.loaded(path)
    ids = lambda t: tok.encode(t or "", add_special_tokens=False).ids
    want = {}
    for b, i, q, d, lab, g in rows:
        label = ids(lab)[:2] + ids(layout.EOS) if with_labels else []
        want[i] = (b, ids(d)[:4] + ids(q) + ids(layout.EOS_USER), label, max(0, 1 if g is None else g))
    bos = ids(layout.BOS)
    longest = {b: max(len(bos) + g + len(t) + len(lab) for c, t, lab, g in want.values() if c == b) for b in (0, 1)}
    for i, (b, text, label, g) in want.items():
        n = len(bos) + g + len(text) + len(label)
        pad = longest[b] - n
        r = got[i]
        assert r.token_ids == [9] * pad + bos + [9] * g + text + label and r.attention == [0] * pad + [1] * n and r.graph_start == pad + len(bos)
        assert r.labels == ([layout.IGNORED] * (longest[b] - len(label)) + label if with_labels else None)


def graphs():
    rng = random.Random(4)
    return {q: (sorted(rng.sample(range(40), 6)), [(rng.randrange(40), rng.randrange(40)) for _ in range(150)], rng.sample(range(40), 3)) for q in range(1, 6)}


def test_batches_are_renumbered(spark):
    g = graphs()
    nodes = spark.createDataFrame([(q, n) for q, (ns, _, _) in g.items() for n in ns], "qid long, node_idx long")
    edges = spark.createDataFrame([(q, *e) for q, (_, es, _) in g.items() for e in es], "qid long, src_idx long, dst_idx long")
    n, e = layout.batched(nodes, edges, F.floor(F.col("qid") / 3))
    local, at = {}, {}
    for q in sorted(g):
        b = q // 3
        for x in g[q][0]:
            local[q, x] = at.get(b, 0)
            at[b] = local[q, x] + 1
    assert {(r.qid, r.node_idx): r.local for r in n.collect()} == local
    assert {(r.qid, r.batch, r.graph) for r in n.collect()} == {(1, 0, 0), (2, 0, 1), (3, 1, 0), (4, 1, 1), (5, 1, 2)}
    want = sorted((q, q // 3, local[q, a], local[q, b]) for q, (ns, es, _) in g.items() for a, b in es if a in ns and b in ns)
    assert want and sorted((r.qid, r.batch, r.src_local, r.dst_local) for r in e.collect()) == want


def adjacency(ns, es, qs, most):
    order = [q for i, q in enumerate(qs) if q in ns and q not in qs[:i]]
    asked = len(order)
    for x in ns:
        if x not in order[:asked]:
            order.append(x)
            if len(order) >= most:
                break
    lines = [f"{a} -> {b}" for a, b in es if a in order and b in order][: max(4, 4 * most)]
    if not lines:
        return ""
    roles = [f"{'src' if i == 0 else 'dst' if i == 1 else f'query_{i}'}: node_idx={x}" for i, x in enumerate(order[:asked])]
    return "\n".join(["Serialized query-centered sampled subgraph.", "Query nodes:", "\n".join(roles) or "unknown", "Node table:", *(f"node_idx={x}" for x in order), "Adjacency list:", *lines])


@pytest.mark.parametrize("most", [1, 4, 16])
def test_descriptions(spark, most):
    g = graphs() | {9: ([1, 2], [(1, 3)], [1]), 10: ([1, 2], [(1, 2)] * 90, [7]), 11: ([4, 5, 6], [(4, 5), (5, 6)], [6, 6, 5])}
    sub = spark.createDataFrame([(q, n, i) for q, (ns, _, _) in g.items() for i, n in enumerate(ns)], "qid long, node_idx long, local_idx int")
    edges = spark.createDataFrame([(q, *e, i) for q, (_, es, _) in g.items() for i, e in enumerate(es)], "qid long, src_idx long, dst_idx long, pos int")
    asked = spark.createDataFrame([(q, qs) for q, (_, _, qs) in g.items()], "qid long, query_nodes array<long>")
    found = describe.query_adjacency(sub, edges, asked, most)
    want = {q: adjacency(*x, most) for q, x in g.items()}
    assert {r.qid: r.description for r in found.collect()} == want
    nodes = spark.createDataFrame([(i, f"n{i}", "t_nodes", 'a "quoted", text' if i % 2 else "plain") for i in range(5)], "node_idx long, node_id string, node_type string, node_attr string")
    links = spark.createDataFrame([(0, 1), (1, 2)], "src_idx long, dst_idx long")
    all_ = {m: {r.qid: r.description for r in describe.described(m, asked, "dblp", nodes, links, found, 2).collect()} for m in ("none", "summary", "sampled_nodes", "query_adjacency")}
    summary = "Graph Domain: dblp. Nodes: 5. Edges: 2."
    assert set(all_["none"].values()) == {""} and set(all_["summary"].values()) == {summary}
    assert set(all_["sampled_nodes"].values()) == {'node_idx,node_id,node_type,node_attr\n0,n0,t_nodes,plain\n1,n1,t_nodes,"a ""quoted"", text"\n'}
    assert all_["query_adjacency"] == {q: t or summary for q, t in want.items()}
    with pytest.raises(ValueError):
        describe.described("other", asked, "dblp", nodes, links)


def test_few_encodings_are_held_at_once(monkeypatch):
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["ab" * (i % 90) for i in range(700)] + [None, "x" * 5000, "", "y"]
    monkeypatch.setattr(layout, "AT_ONCE", 1 << 10)
    real, sizes = layout.loaded(vocabulary), []

    class Tokenizer:
        def encode_batch(self, some, **kw):
            sizes.append((len(some), sum(map(len, some))))
            return real.encode_batch(some, **kw)

    monkeypatch.setattr(layout, "loaded", lambda _: Tokenizer())
    got = layout.encoder(vocabulary).func(pa.array(texts)).to_pylist()
    assert got == [real.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert all(n == 1 or size <= 1 << 10 for n, size in sizes)
    assert layout.encoder(vocabulary).func(pa.array([], pa.string())).to_pylist() == []
