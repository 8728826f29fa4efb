"""Errors and edge cases of filters, splits and the preprocess path."""

import json

import pytest
from pyspark.sql import functions as F

from hopframe.operators import splits


def test_filters_name_what_there_is(spark):
    q = spark.createDataFrame([("How many papers are there?",), ("Name the thing.",)], "question string")
    assert splits.resolved_filter("hop", "x_path_witness") == "path_witness" and splits.resolved_filter("topic", "path_witness") == "topic"
    assert splits.task_filtered(q, "counting").count() == 1 and splits.task_filtered(q, None).count() == 2
    with pytest.raises(ValueError, match="counting=1, other=1"):
        splits.task_filtered(q, "topic")
    with pytest.raises(ValueError, match="no such"):
        splits.task_filtered(q, "none")


def test_explicit_splits(spark):
    kept = spark.createDataFrame([(2, 0), (5, 1), (7, 2)], "raw_index long, sample_index long")
    load = lambda rows: sorted(tuple(r) for r in splits.explicit_split(spark.createDataFrame(rows, "split string, raw_index long"), kept, 3).collect())
    assert load([("train", 2), ("train", 2), ("val", 5), ("test", 7)]) == [("test", 2), ("train", 0), ("val", 1)]
    # numbers that aren't all raw indices, but all sample indices
    assert load([("train", 0), ("train", 2), ("test", 1)]) == [("test", 1), ("train", 0), ("train", 2)]
    for rows, why in (([("train", 9), ("test", 2)], "outside"), ([("train", 2), ("test", 2)], "overlap"), ([("val", 2), ("test", 5)], "train split is empty"), ([("train", 2)], "test split is empty")):
        with pytest.raises(ValueError, match=why):
            load(rows)


def test_stratified_counts_are_exact(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 7 > 4] if i % 11 else " ") for i in range(100)], "id long, answer string")
    got = splits.stratified_split(rows, "id", "answer", (61, 17, 22), 3)
    assert {r["split"]: r["n"] for r in got.groupBy("split").agg(F.count("*").alias("n")).collect()} == {"train": 61, "val": 17, "test": 22}
    assert got.select("id").distinct().count() == 100
    with pytest.raises(ValueError, match="add up"):
        splits.stratified_split(rows, "id", "answer", (1, 1, 1), 3)


GRAPH = {
    "paper_nodes": {"p1": {"features": {"title": "Paper One"}, "neighbors": {"author": ["a1"], "reference": {"p2": {}}}}, "p2": {"features": {"title": "Paper Two"}, "neighbors": {}}},
    "author_nodes": {"a1": {"features": {"name": "Alice"}, "neighbors": {}}},
}


def test_preprocess_end_to_end(spark, tmp_path):
    from hopframe import preprocess

    root = tmp_path / "raw"
    root.mkdir()
    (root / "graph.json").write_text(json.dumps(GRAPH))
    (root / "data.json").write_text('{"qid": 0, "question": "q", "answer": "a"}\n\n')
    out = str(tmp_path / "out")
    assert not preprocess.complete(spark, out)
    meta = preprocess.build(spark, str(root / "graph.json"), str(root / "data.json"), out, "dblp", 16)
    assert (meta["node_count"], meta["edge_count"], meta["samples"]) == (3, 2, 1)
    x = {r["node_id"]: [round(v, 6) for v in r["x"]] for r in spark.read.parquet(f"{out}/features").join(spark.read.parquet(f"{out}/nodes"), "node_idx").collect()}
    assert all(len(v) == 16 for v in x.values())
    assert x["p1"][:7] == [0, 1, 0, 1.098612, 1.098612, 0, 1] and x["p2"][:7] == [0, 1, 0.693147, 0, 0.693147, 1, 0] and x["a1"][:7] == [1, 0, 0.693147, 0, 0.693147, 1, 0]
    assert [r["node_idx"] for r in spark.read.parquet(f"{out}/seeds").orderBy("ord").collect()] == [0, 1, 2]
    edges = spark.read.parquet(f"{out}/edges")
    assert sorted((r["src_idx"], r["dst_idx"], r["edge_attr"], r["edge_type"]) for r in edges.collect()) == [(0, 1, "reference", 1), (0, 2, "author", 0)]
    assert preprocess.complete(spark, out) and preprocess.read_meta(spark, out)["domain"] == "dblp"
    # a second run with the same settings keeps what is there, another domain's rules don't
    assert preprocess.build(spark, str(root / "graph.json"), str(root / "data.json"), out, "dblp", 16) == meta
    assert preprocess.build(spark, str(root / "graph.json"), str(root / "data.json"), out, "biomedical", 16)["domain"] == "biomedical"
    assert preprocess.read_meta(spark, str(tmp_path / "nothing")) == {}


def test_preprocess_many_files_and_errors(spark, tmp_path):
    from hopframe import preprocess

    (tmp_path / "g").mkdir()
    for k, v in GRAPH.items():
        (tmp_path / "g" / f"{k}.json").write_text(json.dumps({k: v}))
    nodes, edges = preprocess.graph_tables(spark, str(tmp_path / "g"), "dblp")
    assert nodes.count() == 3 and edges.count() == 2
    for name, text in (("bad.json", '{"paper_nodes": {"p1": {"features"'), ("list.json", '["x"]'), ("flat.json", '{"paper_nodes": 3}')):
        (tmp_path / name).write_text(text)
        with pytest.raises(Exception, match="(?i)malformed|MALFORMED"):
            preprocess.graph_tables(spark, str(tmp_path / name), "dblp")[0].collect()
    with pytest.raises(ValueError, match="no such builder"):
        preprocess.builder("nothing")
    with pytest.raises(ValueError, match="at least 8"):
        preprocess.build(spark, str(tmp_path / "g"), None, str(tmp_path / "o"), "dblp", 4)


def test_command_line(spark, tmp_path, capsys):
    from hopframe.__main__ import main

    (tmp_path / "g.json").write_text(json.dumps(GRAPH))
    main(["preprocess", "--graph", str(tmp_path / "g.json"), "--out", str(tmp_path / "o"), "--domain", "dblp", "--dim", "16"])
    assert json.loads(capsys.readouterr().out)["node_count"] == 3
    main(["validate", "--out", str(tmp_path / "o")])
    assert json.loads(capsys.readouterr().out) == {"complete": True}
    (tmp_path / "p.jsonl").write_text('{"id": "1", "pred": "3", "label": "3", "question": "What is the minimum number of graph hops needed to link x to y?"}\n')
    main(["evaluate", "--predictions", str(tmp_path / "p.jsonl")])
    assert json.loads(capsys.readouterr().out)["overall"]["n"] == 1
    with pytest.raises(SystemExit):
        main(["nothing"])
