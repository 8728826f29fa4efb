"""Convolutions and projectors against numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hopframe.functions import vectors as V
from hopframe.operators import layers

N, DIM = 9, 6
rng = np.random.default_rng(3)
X = rng.normal(size=(N, DIM))
random.seed(1)
EDGES = [(random.randrange(N - 1), random.randrange(N - 1)) for _ in range(25)] + [(2, 2), (2, 2), (0, 1), (0, 1)]  # node 8 has none
E = rng.normal(size=(len(EDGES), DIM))


@pytest.fixture(scope="module")
def graph(spark):
    x = spark.createDataFrame([(i, X[i].tolist()) for i in range(N)], "node_idx long, x array<double>")
    return x, spark.createDataFrame([(*e, v.tolist()) for e, v in zip(EDGES, E, strict=True)], "src_idx long, dst_idx long, e array<double>")


def rows(df):
    return np.array([r.x for r in sorted(df.collect(), key=lambda r: r.node_idx)])


def softmax(v):
    e = np.exp(v - max(v))
    return e / e.sum()


def test_gcn(graph):
    w, b = rng.normal(size=(4, DIM)), rng.normal(size=4)
    a = np.eye(N)
    for s, d in EDGES:
        if s != d:
            a[d, s] += 1
    k = a.sum(1)
    assert np.allclose(rows(layers.gcn(*graph, w, b)), (a / np.sqrt(np.outer(k, k))) @ X @ w.T + b)


@pytest.mark.parametrize("with_edges", [False, True])
def test_gat(graph, with_edges):
    heads, c = 3, 2
    w, s_, d_, ae, we, b = rng.normal(size=(heads * c, DIM)), *(rng.normal(size=(heads, c)) for _ in range(3)), rng.normal(size=(heads * c, DIM)), rng.normal(size=c)
    z, want = (X @ w.T).reshape(N, heads, c), np.zeros((N, c))
    extra = [((v @ we.T).reshape(heads, c) * ae).sum(1) if with_edges else np.zeros(heads) for v in E]
    for i in range(N):
        into = [(s, x) for (s, d), x in zip(EDGES, extra, strict=True) if d == i and s != i]
        into.append((i, np.mean([x for _, x in into], 0) if into else np.zeros(heads)))
        for h in range(heads):
            l = np.array([(z[s, h] * s_[h]).sum() + (z[i, h] * d_[h]).sum() + x[h] for s, x in into])
            p = softmax(np.where(l >= 0, l, 0.2 * l))
            want[i] += sum(q * z[s, h] for q, (s, _) in zip(p, into, strict=True)) / heads
    got = layers.gat(*graph, w, s_, d_, b, we if with_edges else None, ae if with_edges else None)
    assert np.allclose(rows(got), want + b)


def test_transformer(graph):
    heads, dim = 2, 4
    (q, k, v, s), b, we = [rng.normal(size=(dim, DIM)) for _ in range(4)], [rng.normal(size=dim) for _ in range(4)], rng.normal(size=(dim, DIM))
    qx, kx, vx, sx = (X @ w.T + c for w, c in zip((q, k, v, s), b, strict=True))
    want = sx.copy()
    for i in range(N):
        into = [(a, e @ we.T) for (a, d), e in zip(EDGES, E, strict=True) if d == i]
        for h in range(heads):
            at = slice(2 * h, 2 * h + 2)
            if into:
                p = softmax(np.array([(qx[i, at] * (kx[a] + e)[at]).sum() / math.sqrt(2) for a, e in into]))
                want[i, at] += sum(x * (vx[a] + e)[at] for x, (a, e) in zip(p, into, strict=True))
    got = layers.transformer(*graph, (q, b[0]), (k, b[1]), (v, b[2]), (s, b[3]), heads, we)
    assert np.allclose(rows(got), want)


def test_normalised_stack(graph):
    n = [rng.normal(size=4).tolist() for _ in range(4)]
    n[1] = [abs(v) for v in n[1]]
    got = rows(layers.normalized(layers.gcn(*graph, w := rng.normal(size=(4, DIM))), *n))
    want = (rows(layers.gcn(*graph, w)) - n[0]) / np.sqrt(np.array(n[1]) + 1e-5) * n[2] + n[3]
    assert np.allclose(got, np.maximum(want, 0))
    with pytest.raises(ValueError):
        layers.stack(*graph, [], [])


@pytest.mark.parametrize("kind", ["linear", "sigmoid-mlp", "3-layer-mlp"])
def test_projectors(spark, graph, kind):
    n, _ = layers.projector(kind)
    ws = [(rng.normal(size=(5, DIM if i == 0 else 5)), rng.normal(size=5)) for i in range(n)]
    act = {"sigmoid-mlp": lambda v: 1 / (1 + np.exp(-v))}.get(kind, np.vectorize(lambda v: 0.5 * v * (1 + math.erf(v / math.sqrt(2)))))
    want = X
    for i, (w, b) in enumerate(ws):
        want = (act(want) if i else want) @ w.T + b
    got = rows(graph[0].select("node_idx", layers.project(F.col("x"), kind, ws).alias("x")))
    assert np.allclose(got, want, atol=1e-5)
    with pytest.raises(ValueError):
        layers.project(F.col("x"), kind, [])
    with pytest.raises(ValueError):
        layers.projector("4-mlp")


def test_dense_and_clip(spark):
    df = spark.createDataFrame([([1.0, 2.0],), (None,), ([3.0, 4.0],)], "x array<double>")
    assert [r.y for r in df.select(V.dense(F.col("x"), [[1.0, 1.0], [0.0, 2.0]], [0.5, 0.0]).alias("y")).collect()] == [[3.5, 4.0], None, [7.5, 8.0]]
    pair = spark.createDataFrame([([3.0, 4.0], [0.0, 10.0]), ([3.0, 4.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 0.0])], "b array<double>, r array<double>")
    got = [r.f for r in pair.select(V.clip_residual(F.col("b"), F.col("r"), 0.5).alias("f")).collect()]
    assert got == pytest.approx([0.25, 1.0, 5e-7])
