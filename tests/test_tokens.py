"""Token assembly against numpy, and what interventions and padding leave alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hopframe.operators import tokens

rng = np.random.default_rng(2)
DIM, OUT = 5, 3
X = rng.normal(size=(8, DIM))
#: qid, pos, node, role, d_src, d_dst, delta, active, bias, target
ROWS = [(0, 0, 3, 0, 0, 2, 0, True, 1.0, False), (0, 1, 5, 1, 2, 0, 0, True, 0.5, False), (0, 2, 6, 2, 1, 1, 0, True, 0.2, True), (0, 3, 1, 3, 9, 1, -1, True, 0.0, False), (1, 0, 2, 3, -1, -1, -1, False, 0.4, False), (1, 1, 3, 3, 4, 7, 9, False, 0.4, False)]
r = lambda *n: rng.normal(size=n).tolist()
T = tokens.Tables(
    degree=(r(DIM, 1), r(DIM)), role=r(4, DIM), distance_src=r(6, DIM), distance_dst=r(6, DIM), corridor=(r(DIM, 1), r(DIM)), corridor_alpha=0.7, identity=r(4, DIM), projector=("linear", [(r(OUT, DIM), r(OUT))]),
    role_residual=r(4, OUT), role_alpha=0.6, role_clip=0.2, distance_src_residual=r(24, OUT), distance_dst_residual=r(24, OUT), by_role=True, distance_alpha=0.9, distance_clip=0.1,
)


@pytest.fixture(scope="module")
def given(spark):
    rows = spark.createDataFrame(ROWS, "qid long, pos int, node_idx long, role int, d_src int, d_dst int, delta int, active boolean, bias double, target boolean")
    return rows, spark.createDataFrame([(i, X[i].tolist()) for i in range(8)], "node_idx long, x array<double>")


def project(v):
    (w, b), = T.projector[1]
    return np.array(w) @ v + b


def want(qid, pos, node, role, ds, dd, delta, active, bias, _):
    a = lambda t: np.array(t)
    v = X[node] + a(T.degree[0])[:, 0] * bias + T.degree[1] + a(T.identity[pos])
    if active:
        v = v + T.role[role] + T.distance_src[5 if ds < 0 else min(ds, 5)] + T.distance_dst[5 if dd < 0 else min(dd, 5)] + a(T.corridor[0])[:, 0] * (np.exp(-0.7 * delta) if delta >= 0 else 0) + T.corridor[1]
    base = project(v)
    if not active:
        return base
    bucket = lambda d: 5 if d < 0 else min(d, 4)
    out = base
    for res, ratio in ((a(T.role_residual[role]) * 0.6, 0.2), ((a(T.distance_src_residual[role * 6 + bucket(ds)]) + T.distance_dst_residual[role * 6 + bucket(dd)]) * 0.9, 0.1)):
        out = out + res * min(1, max(np.linalg.norm(base), 1e-6) * ratio / max(np.linalg.norm(res), 1e-6))
    return out


def test_nodes(given):
    got = {(x.qid, x.pos): x for x in tokens.assembled(*given, T, "nodes", DIM, pad=True).collect()}
    assert len(got) == 8
    for row in ROWS:
        x = got[row[0], row[1]]
        assert x.mask and x.node_idx == row[2] and np.allclose(x.x, want(*row))
    for pos in (2, 3):
        assert not got[1, pos].mask and got[1, pos].node_idx is None and np.allclose(got[1, pos].x, project(np.zeros(DIM)))


def test_single_and_disabled(given):
    rows, x = given
    got = {r.qid: np.array(r.x) for r in tokens.assembled(rows, x, T, "single", DIM).collect()}
    assert np.allclose(got[0], project(X[6])) and np.allclose(got[1], project(np.zeros(DIM)))  # targets anywhere count for all
    got = {r.qid: np.array(r.x) for r in tokens.assembled(rows.withColumn("target", F.lit(False)), x, T, "single", DIM).collect()}
    assert np.allclose(got[0], project(X[[3, 5, 6, 1]].mean(0))) and np.allclose(got[1], project(X[[2, 3]].mean(0)))
    assert tokens.assembled(rows, x, T, "disabled", DIM).count() == 0
    with pytest.raises(ValueError):
        tokens.assembled(rows, x, T, "other", DIM)


def test_nothing_learned_leaves_the_vectors(given):
    got = {(x.qid, x.pos): x.x for x in tokens.assembled(*given, tokens.Tables(), "nodes", DIM).collect()}
    assert all(np.allclose(got[row[0], row[1]], X[row[2]]) for row in ROWS)


def test_interventions_leave_padding_alone(given):
    base = tokens.assembled(*given, T, "nodes", DIM, pad=True)
    before = {(x.qid, x.pos): x for x in base.collect()}
    for f in (lambda d: tokens.shuffled(d, 5), lambda d: tokens.corrupted(d, OUT, 5)):
        after = {(x.qid, x.pos): x for x in f(base).collect()}
        assert set(after) == set(before) and all(after[k] == v for k, v in before.items() if not v.mask)
    moved = {(x.qid, x.pos): x.node_idx for x in tokens.shuffled(base, 5).collect()}
    assert any(moved[k] != v.node_idx for k, v in before.items()) and sorted(v for k, v in moved.items() if k[0] == 0) == [1, 3, 5, 6]
    for k, x in ((k, x) for k, x in after.items() if x.mask):
        assert np.isclose(np.linalg.norm(x.x), np.linalg.norm(before[k].x)) and not np.allclose(x.x, before[k].x)
