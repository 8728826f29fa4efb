"""Shard files keep every row, whatever its id."""

from collections import Counter

from hopframe.llm import sharding

SCHEMA = "doc_id long, text string, lang string, source string, slot string"


def test_null_and_repeated_ids_keep_their_rows(spark, tmp_path):
    rows = [(i, f"text {i % 7} " * (i % 5), "en", f"s{i % 3}", "clash") for i in range(60)]
    rows += [(None, "a", None, None, None), (None, "b", None, None, None), (None, "a", "fr", None, None), (None, None, None, None, None), (3, "other text", "en", "s", None), rows[5], rows[5], rows[0]]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    sharding.write_shards(df, str(tmp_path / "s"), 4)
    got = spark.read.parquet(str(tmp_path / "s"))
    assert Counter((r.doc_id, r.text, r.lang, r.source) for r in got.collect()) == Counter(r[:4] for r in rows)
    places = Counter((r.shard, r.slot) for r in got.select("shard", "slot").collect())
    want = Counter((r.shard, r.slot) for r in sharding.shard_plan(df, 4).select("shard", "slot").collect())
    assert places == want and max(places.values()) == 1
    sharding.write_shards(df.limit(0), str(tmp_path / "none"), 4)
