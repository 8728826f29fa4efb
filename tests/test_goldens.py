"""Golden values of the functions and operators."""

from pyspark.sql import functions as F

from hopframe import preprocess
from hopframe.functions import text as T
from hopframe.functions.hashing import h
from hopframe.functions.udfs import embed, rouge_l_score, stable_index
from hopframe.operators import control, graph, retrieval
from hopframe.sources import files


def one(spark, col, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return df.select(col.alias("x")).first()["x"]


def test_normalize(spark):
    assert one(spark, T.normalize(F.lit("The Cat-3.0, a dog"))) == "cat30 dog"
    assert one(spark, T.normalize(F.lit("-3"))) == "3"


def test_token_f1_is_not_clipped(spark):
    assert one(spark, T.token_f1(F.lit("1 1 1"), F.lit("1"))) == 1.5
    assert one(spark, T.token_f1(F.lit("1 1 1"), F.lit("1"), clipped=True)) == 0.5
    assert one(spark, T.token_f1(F.lit(""), F.lit("1"))) == 0.0


def test_cleanup_orders(spark):
    assert one(spark, T.clean_tags_first(F.lit("3</s>4"))) == "34"
    assert one(spark, T.clean_tags_last(F.lit("3</s>4"))) == "3"


def test_keywords(spark):
    exact, _, recall = T.topic_scores(F.lit("1. graph mining; data"), F.lit("graph mining, databases, nlp"))
    assert one(spark, exact) == 0.0 and abs(one(spark, recall) - 2 / 3) < 1e-9


def test_witness(spark):
    path = F.array(F.lit("s"), F.lit("w"), F.lit("t"))
    for pred, label, want in (("Yes\tw", "yes\tw", (1, 1)), ("yes", "yes\tw", (1, 0)), ("no_path", "no_path", (1, 1)), ("maybe", "yes\tw", (0, 0))):
        ok, wit = T.witness_scores(F.lit(pred), F.lit(label), path, F.lit(None).cast("string"))
        assert (one(spark, ok), one(spark, wit)) == want


def test_hopwise(spark):
    a = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, T.hopwise_accuracy(a("x", "b", "d"), a("a", "b", "c"))) == 0.5
    assert one(spark, T.hopwise_accuracy(a("x"), a("a"))) is None


def test_parse_json(spark):
    assert one(spark, T.parsed_answer(F.lit('x {"answer": 3} y'))) == "3"
    assert one(spark, T.parsed_answer(F.lit("{bad"))) == "{bad"
    assert one(spark, T.parsed_path(F.lit('{"path":["a"]}'))) == ["a"]


def test_numeric_noise(spark):
    assert one(spark, T.trim_numeric_noise(F.lit("Vol 12 of 3.5 Alice's book"))) == "Vol of Alice's book"


def test_family(spark):
    q = "What is the minimum number of graph hops needed to connect a to b?"
    assert one(spark, T.task_family(F.lit(q))) == "hop"


def test_hash(spark):
    assert [r[0] for r in spark.range(4).select(h("id", 7)).collect()] == [1183005009, 45241031, 1090197922, 289293519]


def test_rouge_and_embedding():
    assert rouge_l_score("The cat sat.", "the cat is sat") == 0.75
    assert [stable_index(t, 16) for t in ("paper", "one", "graph")] == [(11, -1.0), (8, 1.0), (2, -1.0)]
    assert embed(None) == [0.0] * 16 and abs(sum(x * x for x in embed("a b c")) - 1) < 1e-9


def test_fanouts():
    assert graph.fanouts(4, 25, 0.7) == [25, 17, 12, 8] and graph.fanouts(2, 16, 0.7) == [16, 11]


def test_proximity(spark):
    n = spark.range(4).withColumnRenamed("id", "node_idx")
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "u long, v long")
    und = e.union(e.select("v", "u"))
    a = n.filter("node_idx = 0")
    got = graph.proximity(graph.bfs(a, und, 2), n, a, 2).orderBy("node_idx").collect()
    assert [r["proximity"] for r in got] == [3, 2, 1, 0]


def test_syntax_order(spark):
    """A connected pair with a node out of reach: it comes before the corridor's rest."""
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (1, 4)], "u long, v long")
    und = e.union(e.select("v", "u"))
    pairs = spark.createDataFrame([(1, 0, 3)], "qid long, src long, dst long")
    sub = spark.createDataFrame([(1, i) for i in range(6)], "qid long, node_idx long")
    lab = graph.roles(pairs, und, sub, 6)
    got = {r["node_idx"]: (r["role"], r["delta"], r["d_src"], r["d_dst"]) for r in lab.collect()}
    assert {k: v[0] for k, v in got.items()} == {0: 0, 3: 1, 1: 2, 2: 2, 4: 3, 5: 3} and got[5] == (3, -1, 7, 7)
    assert [r["node_idx"] for r in graph.syntax_order(lab, 10).orderBy("pos").collect()] == [0, 3, 5, 1, 2, 4]


def test_edge_prizes(spark):
    s = spark.createDataFrame([(0, 0.9), (1, 0.9), (2, 0.5), (3, 0.1)], "k long, s double")
    got = {r["k"]: round(r["prize"], 6) for r in retrieval.edge_prizes(s, "k", "s", 2).collect()}
    assert got == {0: 1.0, 1: 1.0, 2: 0.99, 3: 0.0}


def test_tree_pays_for_itself():
    kept, links = retrieval.prize_tree({0: 3.0, 1: 0.0, 2: 2.0, 3: 0.4}, [(0, 1, 0.5), (1, 2, 0.5), (2, 3, 1.0)])
    assert kept == {0, 1, 2} and links == [0, 1]
    assert retrieval.prize_tree({}, []) == (set(), [])
    # three linked nodes of 3 are worth more than a lone one of 5
    assert retrieval.prize_tree({0: 5.0, 1: 3.0, 2: 3.0, 3: 3.0}, [(1, 2, 0.5), (2, 3, 0.5)])[0] == {1, 2, 3}
    # an edge prize above the cost is a node of its own, and its ends come with it
    assert retrieval.retrieve_subgraph({0: 0.0, 1: 0.0, 2: 0.0}, [(0, 1, 3.0), (1, 2, 0.0)], 0.5) == ({0, 1}, [0])


def test_tree_keeps_the_guarantee():
    """A connected tree whose cost and twice its missed prizes are at most twice the least possible."""
    import itertools
    import random

    rng = random.Random(3)
    for _ in range(120):
        k = rng.randint(2, 7)
        prizes = {i: rng.choice([0, 0, 1, 2, 3, 0.5]) for i in range(k)}
        edges = [(i, j, rng.choice([0.25, 0.5, 1, 1.5, 2])) for i in range(k) for j in range(i) if rng.random() < 0.45]

        def joined(own, some):
            root, cost = {x: x for x in own}, 0.0
            for u, v, c in some:
                a, b = u, v
                while root[a] != a:
                    a = root[a]
                while root[b] != b:
                    b = root[b]
                if a != b:
                    root[a], cost = b, cost + c
            return cost if sum(root[x] == x for x in own) == 1 else None

        total, least = sum(prizes.values()), None
        for size in range(1, k + 1):
            for own in itertools.combinations(range(k), size):
                cost = joined(own, sorted((e for e in edges if e[0] in own and e[1] in own), key=lambda e: e[2]))
                if cost is not None:
                    value = cost + total - sum(prizes[x] for x in own)
                    least = value if least is None else min(least, value)
        nodes, kept = retrieval.prize_tree(prizes, edges)
        cost = joined(nodes, [edges[e] for e in kept])
        assert cost is not None and len(kept) == len(nodes) - 1
        assert cost + 2 * (total - sum(prizes[x] for x in nodes)) <= 2 * least + 1e-9


def test_clean_tags_come_last(spark):
    assert one(spark, T.clean_tags_last(F.lit("x <a [INST] b> y"))) == "x <a"
    assert one(spark, T.clean_tags_last(F.lit(" <b>3</b>\n```x"))) == "3"
    for text, want in (("a 12", "12"), ("none", "none"), ("-3", "-3")):
        assert one(spark, T.legal_integer(F.lit(text))) == want
    for text, want in (("a 12", ""), ("none", "none"), ("007", "7"), ("99999999999999999999999999999999999999999", "")):
        assert one(spark, T.legal_integer(F.lit(text), 1, 9)) == want


def test_json_is_strict(spark):
    for text, want in (("{'answer': 3}", "{'answer': 3}"), ('{"answer": null}', None), ('{"answer": "a"} {', "a"), ('{"answer": 1} }', '{"answer": 1} }'), ('x {"path": []}', 'x {"path": []}'), ('{"answer": 1}, {"answer": 2}', '{"answer": 1}, {"answer": 2}')):
        assert one(spark, T.parsed_answer(F.lit(text))) == want


def test_features_without_noise(spark):
    book = {"title": "Vol 12 of Books", "isbn": "1", "genres": '["a", "", " b "]', "format": " Paper 2 ", "shelf": "top 10"}
    m = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv))
    assert one(spark, T.sanitized_features(m(book), F.lit("Goodreads"))) == {"title": "Vol of Books", "genres": "a, b", "format": "Paper 2", "shelf": "top"}
    assert one(spark, T.sanitized_features(m({"mesh_id": "1", "name": "Gene 7 x", "taxon_id": "9"}), F.lit("biomedical"))) == {"name": "Gene x"}
    assert one(spark, T.sanitized_features(m(book), F.lit("dblp"))) == book


def test_resets_fire_on_a_fall(spark):
    e = spark.createDataFrame([(0, 0.5), (1, 0.6), (2, 0.58), (3, 0.54), (4, 0.6), (5, 0.4), (6, 0.6), (7, 0.4)], "epoch long, progress double")
    got = [r["reset"] for r in control.momentum_resets(e, 0.55, 0.02, 0.01, 2).orderBy("epoch").collect()]
    assert got == [False, False, False, True, False, True, False, True]
    assert [r["reset"] for r in control.momentum_resets(e, 0.55, 0.04, 0.01, 5).orderBy("epoch").collect()] == [False, False, True, False, False, False, False, True]


def test_checkpoint_policies(spark):
    e = spark.createDataFrame([(0, 9.0, 0.5, 0.3, 0.2), (1, 8.0, 0.5, 0.05, 0.3), (2, 8.5, 0.7, 0.4, 0.1), (3, 7.0, 0.5, 0.01, 0.3)], "epoch long, val_loss double, val_em double, digit8_rate double, legal_rate double")
    pick = lambda p, **k: [r["epoch"] for r in control.best_checkpoint(e, p, 0.1, **k).collect()]
    assert (pick("val_loss"), pick("val_em"), pick("val_em_legal_integer")) == ([3], [2], [2])
    # the first epoch is kept for its loss, which no later score beats; without the fallback ties go by the rate
    assert pick("val_em_digit8") == [0] and pick("val_em_digit8", fallback=False) == [3]


def test_tables_bind_by_name(spark, tmp_path):
    import pytest

    (tmp_path / "t.csv").write_text("b,a\nx,1\ny,z\n")
    got = files.read_table(spark, str(tmp_path / "t.csv"), "a int, b string, c string", ["a"], ["b", "c"])
    assert got.columns == ["a", "b"] and [tuple(r) for r in got.collect()] == [(1, "x"), (None, "y")]
    with pytest.raises(ValueError, match="missing columns: zz"):
        files.read_table(spark, str(tmp_path / "t.csv"), "a int, zz int", ["a", "zz"])


def test_learning_rate(spark):
    want = {0: 0.0, 1: 4e-6, 2: 8e-6, 7: 6.5e-6, 12: 5e-6}
    for p, v in want.items():
        assert abs(one(spark, control.learning_rate(F.lit(float(p)), 8e-6, 2, 12)) - v) < 1e-12


def test_accumulation(spark):
    size, end = control.accumulation_window(F.col("id"), 5, 2)
    assert [tuple(r) for r in spark.range(5).select(size, end).collect()] == [(2, False), (2, True), (2, False), (2, True), (1, True)]


def test_raw_graph(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"paper_nodes": {"p1": {"features": {"title": "Paper One"}, "neighbors": {"author": ["a1"], "reference": ["p2"]}}, "p2": {"features": {"title": "Paper Two"}, "neighbors": {}}}, "author_nodes": {"a1": {"features": {"name": "Alice"}, "neighbors": {}}}}')
    nodes, edges = preprocess.graph_tables(spark, str(tmp_path / "g.json"), "dblp")
    assert [(r["node_idx"], r["node_id"], r["node_attr"]) for r in nodes.orderBy("node_idx").collect()] == [
        (0, "p1", "type=paper_nodes; title: Paper One"), (1, "p2", "type=paper_nodes; title: Paper Two"), (2, "a1", "type=author_nodes; name: Alice")]
    assert sorted((r["src_idx"], r["dst_idx"], r["edge_attr"]) for r in edges.collect()) == [(0, 1, "reference"), (0, 2, "author")]


def test_files(spark, tmp_path):
    import pytest

    df = spark.createDataFrame([("train", 1), ("test", 2)], "split string, idx long")
    files.write_splits(df, str(tmp_path / "s"))
    assert [r["idx"] for r in files.read_split(spark, str(tmp_path / "s" / "split=test")).collect()] == [2]
    with pytest.raises(ValueError, match="unknown"):
        files.strict_config({"a": 1}, {"b": 2})
    assert files.strict_config({"a": 1}, {"a": 2}) == {"a": 2} and files.read_sidecar(str(tmp_path / "none")) == {}
