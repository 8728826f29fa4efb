"""SQL functions, metadata, reports, per-example outputs, features of sampled nodes, and the command line of pairs."""

import json

import pytest
from pyspark.sql import functions as F

from hopframe import preprocess
from hopframe.functions import sql
from hopframe.functions import text as T
from hopframe.operators import describe, evaluate
from hopframe.sources import files


def test_sql_functions_equal_the_columns(spark):
    assert sql.register(spark) == sorted(sql.FUNCTIONS)
    rows = [("The Big  cat, a 'dog'!", "big cat dog", "topic"), ("What is the minimum number of graph hops needed to link x to y?", "3", None), ("", None, "entity"), (None, "no_path", "hop"), ("yes, 12 or -7", "a, b", "counting")]
    df = spark.createDataFrame(rows, "question string, label string, declared string")
    for name, (function, arguments, _) in sql.FUNCTIONS.items():
        cols = ["question", "label", "declared"][: arguments.count(",") + 1]
        got = [r.v for r in df.select(F.expr(f"{name}({', '.join(cols)})").alias("v")).collect()]
        assert got == [r.v for r in df.select(function(*map(F.col, cols)).alias("v")).collect()], name
    assert spark.sql("SELECT hf_normalize('The  End.') AS x").first().x == "end"


def test_metadata(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.load_metadata(spark, str(tmp_path))
    (tmp_path / "samples.csv").write_text('id,text\n1,"a ""b"", c\nd"\n')
    assert [tuple(r) for r in files.load_metadata(spark, str(tmp_path)).collect()] == [("1", 'a "b", c\nd')]
    (tmp_path / "questions.jsonl").write_text('{"id": 1, "q": ["a"]}\n\n{"id": 2, "q": null}\n')
    assert sorted(tuple(r) for r in files.load_metadata(spark, str(tmp_path)).select("id", "q").collect()) == [(1, ["a"]), (2, None)]


def test_reports(spark, tmp_path):
    rows = [("1", "3", "3", "What is the minimum number of graph hops needed to link x to y?"), ("2", "x", "y", "who wrote it?")]
    result = evaluate.report(spark.createDataFrame([(*r, None) for r in rows], "id string, pred string, label string, question string, gt_path array<string>"))
    evaluate.dump(spark, result, str(tmp_path / "r"))
    assert json.loads((tmp_path / "r.json").read_text()) == result
    lines = (tmp_path / "r.txt").read_text().splitlines()
    assert lines[1].split()[:2] == ["all", "2"] and len(lines) == 2 + len(result["tasks"]) and lines == evaluate.formatted(result).splitlines()
    means = evaluate.corpus_means(spark.createDataFrame([(1, 1.0, 0.5), (1, 0.0, 0.5), (2, 1.0, None)], "hop int, em double, rouge double"), ["em", "rouge"], "hop")
    assert sorted(map(tuple, means.collect()), key=repr) == sorted([(None, 3, 0.666667, 0.5), (1, 2, 0.5, 0.5), (2, 1, 1.0, None)], key=repr)


def test_outputs_and_features(spark):
    batches = spark.createDataFrame([("b1", [1, 2], ["x", "y"]), ("b2", [3], ["z"]), ("b3", [], [])], "batch string, ids array<int>, preds array<string>")
    assert sorted(map(tuple, evaluate.indexed_outputs(batches, ["ids", "preds"]).collect())) == [("b1", 1, "x"), ("b1", 2, "y"), ("b2", 3, "z")]
    feats = spark.createDataFrame([(i, [float(i), 0.5]) for i in range(5)], "node_idx long, x array<double>")
    sub = spark.createDataFrame([("q", 1), ("q", 4), ("r", 4)], "qid string, node_idx long")
    assert sorted((r.qid, r.node_idx, r.x) for r in describe.node_features(sub, feats).collect()) == [("q", 1, [1.0, 0.5]), ("q", 4, [4.0, 0.5]), ("r", 4, [4.0, 0.5])]


def test_hopqa_command(spark, tmp_path, capsys):
    from hopframe.__main__ import main

    doc = {"a_nodes": {f"n{i}": {"features": {"name": f"N{i}"}, "neighbors": {"a": [f"n{(i + 1) % 12}"]}} for i in range(12)}}
    (tmp_path / "g.json").write_text(json.dumps(doc))
    main(["preprocess", "--graph", str(tmp_path / "g.json"), "--out", str(tmp_path / "o"), "--domain", "dblp"])
    main(["hopqa", "--out", str(tmp_path / "o"), "--samples", "7", "--hops", "1", "3"])
    said = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert said["per_hop"] == {"1": 3, "2": 2, "3": 2}
    assert spark.read.parquet(said["folder"] + "/pairs").count() == 7
    with pytest.raises(RuntimeError):
        main(["hopqa", "--out", str(tmp_path / "o"), "--samples", "7", "--hops", "9", "9"])
    tables, meta = preprocess.load(spark, str(tmp_path / "o"), domain="dblp")
    assert set(tables) == set(preprocess.TABLES) and tables["nodes"].count() == meta["node_count"] == 12
    for bad in ((str(tmp_path / "o"), {"domain": "other"}), (str(tmp_path / "nothing"), {})):
        with pytest.raises(ValueError, match="no complete tables"):
            preprocess.load(spark, bad[0], **bad[1])
    assert T.normalize is sql.FUNCTIONS["hf_normalize"][0]
