"""One graph document over many tasks equals the whole document; malformed ones name their place."""

import json
import random

import pytest
from pyspark.sql import functions as F

from hopframe.sources import raw_graph


@pytest.fixture()
def small_splits(spark):
    conf = {"spark.sql.files.maxPartitionBytes": "200", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def document(n, seed=1):
    rng = random.Random(seed)
    odd = ['a}b{"c', "\\}", '}"', "{", "é}ü", "x", '\\"}', "", "]}[", "tab\t}"]
    value = lambda i: {"features": {rng.choice(odd): rng.choice([*odd, 1, None, {"y": ["}", 2]}])}, "neighbors": {"r": [rng.choice(odd), f"{i}"]}}
    sizes = {"paper_nodes": n, "author_nodes": n // 2, "empty_nodes": 0, "venue_nodes": n // 4}
    return {t: {f"{t} {i} {rng.choice(odd)}": value(i) for i in range(k)} for t, k in sizes.items()}


def read(spark, path):
    rows = raw_graph.entries(spark, path).orderBy("file", "at").collect()
    return [(json.loads(r.node_type), r.type_pos, json.loads("{" + r.entry + "}")) for r in rows]


@pytest.mark.parametrize("text", [None, "indent", "padded"])
def test_many_ranges_equal_one_document(spark, tmp_path, small_splits, text):
    doc = document(60)
    said = json.dumps(doc, ensure_ascii=text == "indent", indent=2 if text == "indent" else None)
    (tmp_path / "g.json").write_text(f"  {said}\n\n" if text == "padded" else said)
    assert raw_graph.records(spark, str(tmp_path)).select(F.spark_partition_id()).distinct().count() > 20
    want = [(t, k, {i: v}) for k, (t, nodes) in enumerate(doc.items()) for i, v in nodes.items()]
    assert read(spark, str(tmp_path)) == want


def test_several_files_and_odd_values(spark, tmp_path, small_splits):
    for i in range(3):
        (tmp_path / f"{i}.json").write_text(json.dumps(document(9, i)))
    (tmp_path / "3.json").write_text('{"a_nodes": {"x": {}, "y": {"k": [1, {"z": "}"}]}}, "b_nodes": {}}')
    (tmp_path / "4.json").write_text("{}")
    want = [(t, k, {i: v}) for f in range(3) for k, (t, nodes) in enumerate(document(9, f).items()) for i, v in nodes.items()]
    want += [("a_nodes", 0, {i: v}) for i, v in {"x": {}, "y": {"k": [1, {"z": "}"}]}}.items()]
    assert read(spark, str(tmp_path)) == want


@pytest.mark.parametrize(
    "text",
    ["", "[1]", '{"a": 1}', '{"a": {"x" {}}}', '{"a": {"x": {}}', '{"a": {"x": {}}  ', '{"a": {"x": {}}}}', '{"a": {"x": {}} "b": {}}', '{"a": {"x": {"y": "z', '{"a": {"x": {}},, "b": {}}', '{"a": {"x": }}', '{"a": {"x": 1}}', '{"a": {"x": "}"}}', '{"a}": {}}'],
)
def test_malformed_documents_are_errors(spark, tmp_path, small_splits, text):
    (tmp_path / "g.json").write_text(text)
    if not text:
        assert read(spark, str(tmp_path)) == []  # a file without a byte holds no document
        return
    with pytest.raises(Exception, match="malformed graph: .* at byte [0-9]+ of "):
        read(spark, str(tmp_path))
