"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Every measure is a built-in expression over the whole text; a document is kept when it passes the base rule and
every row of the threshold table. Nulls and empty texts count as texts without words: all measures are 0 and the
base rule fails. Repeated rows are judged one by one and alike. Other columns pass through; measure names that clash
with a column of the input replace it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopframe.llm.common import WS_CHARS, table, words

SYMBOLS = "#*$%&|<>"
#: Frequent short words of the four languages in the corpus.
STOP_WORDS = (
    "the of and to in a is that for it as with was on be at by this are from or an not",
    "le la les de des du un une et en que qui dans pour pas sur est au avec par",
    "der die das und in zu den von mit ist des ein eine nicht auf dem als für im es",
    "el la los las de que y en un una por con no para es al del se lo como",
)
#: measure, least, most. A bound of None is open; a document fails where a measure lies outside.
THRESHOLDS: list[tuple[str, float | None, float | None]] = [
    ("mean_word_chars", 1.5, 25.0),
    ("symbol_ratio", None, 0.1),
    ("stop_word_ratio", 0.01, None),
    ("dup_line_ratio", None, 0.3),
]
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_stop_words",
    "mean_word_chars", "symbol_ratio", "stop_word_ratio", "dup_line_ratio",
)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the ratios of the threshold table."""
    value = F.coalesce(F.col(text), F.lit(""))
    stop = F.array(*(F.lit(w) for w in sorted({w for line in STOP_WORDS for w in line.split()})))
    kept = [c for c in docs.columns if c not in MEASURES]
    # the input's columns wait in a struct, so that no name can clash
    df = docs.select(F.struct(*docs.columns).alias("_doc"), text).withColumns({"_words": words(text), "_lines": F.filter(F.split(value, "\n", -1), lambda x: F.translate(x, WS_CHARS, "") != "")})
    # each window of three words with its place, equal windows side by side
    df = df.withColumn("n_words", F.size("_words").cast("long"))
    df = df.withColumn(
        "_windows",
        F.expr("sort_array(transform(slice(_words, 1, greatest(size(_words) - 2, 0)), (w, i) -> struct(concat_ws(' ', w, get(_words, i + 1), get(_words, i + 2)) AS w, i AS i)))"),
    )
    df = df.withColumn("_again", F.expr("sort_array(transform(filter(_windows, (x, k) -> x.w <=> get(_windows, k - 1).w OR x.w <=> get(_windows, k + 1).w), x -> x.i))"))
    df = df.withColumns(
        {
            "word_chars": F.char_length(F.translate(value, WS_CHARS, "")).cast("long"),
            "n_symbols": (F.char_length(value) - F.char_length(F.translate(value, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            # a window covers three words, less those that the repeated window before it covers
            "n_repeat_words": F.expr("aggregate(_again, named_struct('n', 0L, 'last', -3), (a, i) -> named_struct('n', a.n + least(3, i - a.last), 'last', i), a -> a.n)"),
            "n_stop_words": F.size(F.filter("_words", lambda w: F.array_contains(stop, F.lower(w)))).cast("long"),
        }
    )
    return df.withColumns(
        {
            "mean_word_chars": _ratio(F.col("word_chars"), F.col("n_words")),
            "symbol_ratio": _ratio(F.col("n_symbols"), F.col("n_words")),
            "stop_word_ratio": _ratio(F.col("n_stop_words"), F.col("n_words")),
            "dup_line_ratio": _ratio(F.col("n_dup_lines"), F.col("n_lines")),
        }
    ).select(*(F.col("_doc")[c].alias(c) for c in kept), *MEASURES)


def compiled(thresholds=THRESHOLDS) -> Column:
    """The table as one boolean expression; each failed rule's name is in failed_rules()."""
    ok = F.lit(True)
    for name, least, most in thresholds:
        ok = ok & (F.lit(True) if least is None else F.col(name) >= least) & (F.lit(True) if most is None else F.col(name) <= most)
    return ok


def failed_rules(thresholds=THRESHOLDS) -> Column:
    bad = [F.when((F.lit(False) if lo is None else F.col(n) < lo) | (F.lit(False) if hi is None else F.col(n) > hi), F.lit(n)) for n, lo, hi in thresholds]
    return F.array_compact(F.array(F.when(F.col("base_failed"), F.lit("base")), *bad))


def judge(docs: DataFrame, text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """docs with all measures, base_failed, failed_rules and kept."""
    df = measures(docs, text).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    return df.withColumns({"failed_rules": failed_rules(thresholds), "kept": ~F.col("base_failed") & compiled(thresholds)})


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go."""
    judged = judge(docs.select(F.struct(*docs.columns).alias("_doc"), F.col("text")))
    # not a filter: that would be pushed down and work every measure out again for each rule
    return judged.select(F.explode(F.when(F.col("kept"), F.array("_doc"))).alias("_doc")).select("_doc.*")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), g AS (
  SELECT *, list_transform(range(1, greatest(len(ws) - 1, 1)), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) AS tri FROM w
), e AS (
  SELECT doc_id, unnest(tri) AS t, unnest(range(1, len(tri) + 1)) AS i FROM g WHERE len(tri) > 0
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS c FROM e) WHERE c > 1
), c AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id
), m AS (
  SELECT g.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         len(list_filter(ws, lambda x: list_contains([__STOP__], lower(x)))) AS n_stop
  FROM g LEFT JOIN c ON g.doc_id = c.doc_id
), b AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND word_chars / CAST(n_words AS DOUBLE) BETWEEN 1.5 AND 25.0 AND n_symbols / CAST(n_words AS DOUBLE) <= 0.1
        AND n_stop / CAST(n_words AS DOUBLE) >= 0.01 AND n_dup_lines / CAST(greatest(n_lines, 1) AS DOUBLE) <= 0.3) AS kept
FROM b
""".replace("__STOP__", ", ".join(f"'{w}'" for w in sorted({w for line in STOP_WORDS for w in line.split()})))
