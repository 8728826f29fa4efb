"""Mixing sources to target weights with Efraimidis-Spirakis sampling, in DataFrame operations only.

A source's target is its weighted share of the budget, at most `most` times its size; what is cut off goes to the
other sources by weight. A source is taken in complete epochs first. The rest of its target is a sample without
replacement: each document gets the key -ln(u) / quality with u from a hash of its id, the documents of a source are
sorted by key, and a prefix sum of sizes finds the key where the budget ends, to the nearest document. Only that one
key a source travels back to the documents, so texts are never shuffled.

Null and empty texts have size 0 and are never taken. A null source is a source of its own, last in order. Documents
that share id and text share a key and are taken alike. With no words at all every target is 0. An empty table gives
no rows. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopframe.llm.common import checkpointed, ranked, table, words

WEIGHTS = (3, 1, 2)
BUDGET, MOST, SEED = 1.5, 2, "mix-1"
#: Sources up to which their table of one row each is broadcast.
BROADCAST_SOURCES = 50_000


def quality(text: Column, size: Column) -> Column:
    """A document's weight, in (0, 1]: fewer symbols a word, more weight."""
    value = F.coalesce(text, F.lit(""))
    symbols = F.char_length(value) - F.char_length(F.translate(value, "#*$%&|<>", ""))
    return F.lit(1.0) / (F.lit(1.0) + F.lit(10.0) * symbols / F.greatest(size, F.lit(1)))


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5 hash."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """source, source_size, target for a table source, source_size with a row a source.

    With sources by rising cap / weight, those capped come first; the first source whose cap reaches the level that
    the remaining budget gives to the remaining weights sets the level for all.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    by = Window.orderBy(F.col("source_size") / F.col("_w"), F.col("source").asc_nulls_last())
    all_ = Window.partitionBy()
    s = s.withColumns(
        {
            "_capped": F.coalesce(F.sum(most * F.col("source_size")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "_left": F.sum("_w").over(by.rowsBetween(0, Window.unboundedFollowing)),
            "_budget": budget * F.sum("source_size").over(all_),
        }
    )
    s = s.withColumn("_level", (F.col("_budget") - F.col("_capped")) / F.col("_left"))
    s = s.withColumn("_level", F.min(F.when(F.col("_level") * F.col("_w") <= most * F.col("source_size"), F.struct(F.col("source_size") / F.col("_w"), F.col("_level").alias("v")))).over(all_)["v"])
    return s.select("source", "source_size", F.least((most * F.col("source_size")).cast("double"), F.coalesce(F.col("_level"), F.lit(0.0)) * F.col("_w")).alias("target"))


def _keyed(docs: DataFrame, carried: list[Column], seed: str) -> DataFrame:
    """carried, and what the mix needs of each document: _s (its source), _size and _place (its key and what breaks ties)."""
    df = docs.select(*carried, F.col("source").alias("_s"), "doc_id", "text", F.size(words("text")).cast("long").alias("_size"))
    key = -F.ln(uniform(F.col("doc_id"), seed)) / quality(F.col("text"), F.col("_size"))
    place = F.struct(key.alias("k"), F.coalesce(F.col("doc_id"), F.lit(-1)).cast("long").alias("d"), F.xxhash64("text").alias("t"))
    return df.withColumn("_place", place).drop("doc_id", "text")


def goals(narrow: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """A row a source: source, source_size, target, _epochs and _end, the last place that the sample takes."""
    out = targets(narrow.groupBy(F.col("_s").alias("source")).agg(F.sum("_size").alias("source_size")), weights, budget, most)
    out = out.withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    out = out.withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size"))
    # where each source starts in the order of all rows: the sizes of the sources before it
    out = checkpointed(out.withColumn("_start", F.coalesce(F.sum("source_size").over(Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    rows = ranked(narrow.select("_s", "_size", "_place"), [F.col("_s").asc_nulls_last(), F.col("_place.k"), F.col("_place.d"), F.col("_place.t")], {"_before": "_size"})
    rows = rows.join(_few(out), F.col("_s").eqNullSafe(F.col("source")))
    inside = F.col("_before") - F.col("_start")
    # the document in which the budget ends is in when most of it is
    ends = rows.filter((F.col("_size") > 0) & (2 * inside + F.col("_size") <= 2 * F.col("_rest"))).groupBy("_s").agg(F.max("_place").alias("_end"))
    return out.join(ends, F.col("_s").eqNullSafe(F.col("source")), "left").select("source", "source_size", "target", "_epochs", "_end")


def _few(sources: DataFrame) -> DataFrame:
    return F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources


def _taken(keyed: DataFrame, plan: DataFrame) -> DataFrame:
    """keyed with size, source_size, target and taken in place of what _keyed() added."""
    rows = keyed.join(_few(plan), F.col("_s").eqNullSafe(F.col("source")))
    taken = F.col("_size") * (F.col("_epochs") + F.when(F.col("_place") <= F.col("_end"), F.lit(1)).otherwise(F.lit(0)))
    own = [c for c in keyed.columns if c not in ("_s", "_size", "_place")]
    return rows.select(*own, F.col("_size").alias("size"), "source_size", "target", taken.cast("long").alias("taken"))


def mix(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: int = MOST, seed: str = SEED) -> DataFrame:
    """doc (a struct of the columns of docs, whatever their names), size, source_size, target (its source's) and taken.

    Texts are read twice, once for the plan and once for the result, and never shuffled.
    """
    plan = checkpointed(goals(checkpointed(_keyed(docs, [], seed)), weights, budget, most))
    return _taken(_keyed(docs, [F.struct(*docs.columns).alias("doc")], seed), plan)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and sizes are all that is asked for, so texts are read once."""
    rows = checkpointed(_keyed(table(spark, sf_dir, "documents"), [F.col("doc_id").alias("_id")], SEED))
    return _taken(rows, goals(rows)).withColumnRenamed("_id", "doc_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mix itself, each document as often as it is taken."""
    times = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(F.lit(0))
    return mix(docs).select("doc", F.explode(F.array_repeat(F.lit(1), times)).alias("_copy")).select("doc.*")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
         length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS sym
  FROM documents
), k AS (
  SELECT *, -ln((CAST('0x' || substr(md5('mix-1:' || doc_id), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
            / (1.0::DOUBLE / (1.0::DOUBLE + 10.0::DOUBLE * sym / greatest(size, 1))) AS key
  FROM d
), s AS (
  SELECT source, sum(size) AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, CAST(source_size AS BIGINT) AS ss, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM s
), l AS (
  SELECT *, coalesce(sum(2 * ss) OVER (ORDER BY ss / CAST(w AS DOUBLE), source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(w) OVER (ORDER BY ss / CAST(w AS DOUBLE), source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w, sum(ss) OVER () * 1.5::DOUBLE AS budget
  FROM w
), v AS (
  SELECT *, (budget - CAST(capped AS DOUBLE)) / CAST(rest_w AS DOUBLE) AS lv FROM l
), t AS (
  SELECT source, ss, least(CAST(2 * ss AS DOUBLE), w * (SELECT arg_min(lv, ss / CAST(w AS DOUBLE)) FROM v WHERE lv * w <= 2 * ss)) AS target FROM v
), e AS (
  SELECT *, CASE WHEN ss > 0 THEN floor(target / ss) ELSE 0 END AS ep FROM t
), r AS (
  SELECT k.doc_id, k.size, e.ss, e.target, e.ep, e.target - e.ep * e.ss AS rest,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, ss AS source_size, target, CAST(size * (ep + CASE WHEN 2 * before + size <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""
