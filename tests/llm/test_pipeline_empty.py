"""Every stage of the pipeline, and all of them, on an empty table."""

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_empty_tables_go_through(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, none, "")
        assert out.columns == none.columns and out.count() == 0, name
    none.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_small_corpus_with_odd_rows_goes_through(spark, tmp_path):
    good = "the quick brown fox of the hill and the dog in a field that is by the river with all of it " * 4
    words = [f"{good} number{i} and the last{i} of it" for i in range(6)]
    rows = [*((i, w, "en", "s", 1) for i, w in enumerate(words)), (None, words[0], None, None, None), (9, None, None, None, None), (9, "", None, None, None), (0, words[0], "en", "s", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 0
