"""Queries that take in every row of their inputs, against brute force."""

import glob
import math
import os

import pytest

from hopframe.plans import catalog
from hopframe.sources.testgraph import edges


def sql_rows(sf, sql, cols):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in glob.glob(sf + "/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return sorted(c.sql(f"SELECT {cols} FROM ({sql})").fetchall())


def order_hash(k, seed):
    x = (k * 1327217885 + seed * 69621 + 12345) % 2147483647
    return x * (x % 65521 + 1) % 2147483647


def test_contains_match_reads_long_and_null_texts(spark, tmp_path):
    spark.createDataFrame([("x" * 5000 + "needle",), ("needle",), ("hay",), (None,)], "text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("needle",), ("thread",)], "text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = catalog.QUERIES["contains_match"](spark, str(tmp_path)).first()
    assert (got["pairs"], got["hits"]) == (8, 2)


def test_contains_match_equals_brute_force(spark, sf):
    docs = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = catalog.QUERIES["contains_match"](spark, sf).first()
    assert (got["pairs"], got["hits"]) == (len(docs) * len(items), sum(t in x for x in docs for t in items))


def test_infonce_gives_every_vector_its_loss(spark, sf):
    e = {r["vec_id"]: [float(x) for x in r["embedding"]] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / 0.07
    got = {r["vec_id"]: r["nce"] for r in catalog.QUERIES["infonce"](spark, sf).collect()}
    assert got.keys() == e.keys()
    for i, q in e.items():
        pos, ls = dot(q, q), [dot(q, k) for j, k in e.items() if j < 64]
        m = max(pos, *ls)
        want = math.log(math.exp(pos - m) + sum(math.exp(x - m) for x in ls)) + m - pos
        assert abs(got[i] - want) < 2e-6


@pytest.fixture(scope="module")
def numbered(spark, sf):
    return edges(spark, sf, numbered=True).collect()


def test_edge_ids_are_unique(spark, sf, numbered):
    assert len({r["edge_id"] for r in numbered}) == len(numbered) == edges(spark, sf).count()


def test_edge_dropout_draws_for_each_edge_of_the_full_graph(spark, sf, numbered):
    want = sorted((r["src_idx"], r["dst_idx"], r["edge_attr"]) for r in numbered if order_hash(r["edge_id"], 31) >= 0.2 * 2147483647)
    got = sorted(tuple(r) for r in catalog.QUERIES["edge_dropout"](spark, sf).select("src_idx", "dst_idx", "edge_attr").collect())
    assert got == want and abs(len(got) / len(numbered) - 0.8) < 0.02
    kept = {}
    for r in numbered:
        kept.setdefault(r["src_idx"], set()).add(order_hash(r["edge_id"], 31) >= 0.2 * 2147483647)
    assert any(len(v) == 2 for v in kept.values())


def test_samples_start_at_questions_in_the_full_graph(spark, sf, numbered):
    into = {}
    for r in numbered:
        for s, t, i in ((r["dst_idx"], r["src_idx"], 2 * r["edge_id"]), (r["src_idx"], r["dst_idx"], 2 * r["edge_id"] + 1)):
            into.setdefault(t, []).append((order_hash(i, 23), i, s))
    want_nodes, want_edges = set(), set()
    for q in catalog.QUERIES["hopqa_records"](spark, sf).collect():
        front = seen = {q["src"], q["dst"]}
        want_nodes |= {(q["qid"], n, 0) for n in front}
        for hop, k in ((1, 16), (2, 11)):
            took = {(s, t, i) for t in front for _, i, s in sorted(into.get(t, []))[:k]}
            want_edges |= {(q["qid"], *x, hop) for x in took}
            front = {s for s, _, _ in took} - seen
            seen = seen | front
            want_nodes |= {(q["qid"], n, hop) for n in front}
    got_nodes = [tuple(r) for r in catalog.QUERIES["hsgs_sample_nodes"](spark, sf).select("qid", "node_idx", "hop").collect()]
    got_edges = [tuple(r) for r in catalog.QUERIES["hsgs_sample_edges"](spark, sf).select("qid", "src_idx", "dst_idx", "edge_id", "hop").collect()]
    assert sorted(got_nodes) == sorted(want_nodes) and sorted(got_edges) == sorted(want_edges)
    audit = {r["qid"]: (r["n_nodes"], r["n_seeds"]) for r in catalog.QUERIES["sampling_audit"](spark, sf).collect()}
    assert audit == {q: (sum(n[0] == q for n in want_nodes), sum(n[0] == q and n[2] == 0 for n in want_nodes)) for q in {n[0] for n in want_nodes}}
    batches = {r["batch"]: (r["n_nodes"], r["n_graphs"], r["n_edges"]) for r in catalog.QUERIES["collated_batches"](spark, sf).collect()}
    assert batches == {b: (sum(n[0] // 2 == b for n in want_nodes), len({n[0] for n in want_nodes if n[0] // 2 == b}), sum(x[0] // 2 == b for x in want_edges)) for b in {n[0] // 2 for n in want_nodes}}


def test_refresh_seed_mix_ranks_the_full_graph(spark, sf):
    want = sql_rows(sf, catalog.ORACLES["refresh_seed_mix"], "node_idx, tier")
    assert sorted(tuple(r) for r in catalog.QUERIES["refresh_seed_mix"](spark, sf).select("node_idx", "tier").collect()) == want


def test_weighted_adjacency_is_of_the_full_graph(spark, sf):
    sql = catalog.ORACLES["normalized_adjacency_weighted"]
    want = {(u, v): w for u, v, w in sql_rows(sf, sql, "u, v, w")}
    got = {(r["u"], r["v"]): r["w"] for r in catalog.QUERIES["normalized_adjacency_weighted"](spark, sf).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_cosine_topk_asks_for_every_fiftieth_vector(spark, sf):
    want = sql_rows(sf, catalog.ORACLES["cosine_topk"], "qid, vec_id, sim")
    got = sorted(tuple(r) for r in catalog.QUERIES["cosine_topk"](spark, sf).select("qid", "vec_id", "sim").collect())
    assert [r[:2] for r in got] == [r[:2] for r in want] and all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, want, strict=True))
    assert {r[0] for r in got} == set(range(0, 500, 50))
