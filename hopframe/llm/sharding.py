"""Sharding by Hilbert-curve order, in DataFrame operations only.

Source, language, size and id are quantised to four bits each, in their own order and to even counts. The Hilbert
index of the four sorts the documents, so a run of the order is compact in every dimension and its minima and maxima
let readers skip it. The order is cut into runs of nearly equal bytes. Documents with equal texts are kept side by
side, at the place of the first of them; a cut that would part a small group moves to the nearer end of the group,
while a group too large for that is parted.

Null texts have size 1 and the checksum of the empty text. Null ids, sources and languages come first in their
dimension. Repeated rows get slots of their own. An empty table gives no rows. Other columns are not carried by the
plan; write_shards() joins it back to whole rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopframe.llm.common import ranked, table

SHARDS, BITS = 8, 4
#: A group of equal texts up to this part of a shard isn't parted.
WHOLE_GROUP = 0.05


def hilbert(df: DataFrame, dims: list[str], bits: int, name: str) -> DataFrame:
    """df with the Hilbert index of integer columns of `bits` bits each, by Skilling's transform."""
    n, x = len(dims), [f"_h{i}" for i in range(len(dims))]
    df = df.withColumns({x[i]: F.col(d).cast("int") for i, d in enumerate(dims)})
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(n):
            on, t = F.col(x[i]).bitwiseAND(F.lit(q)) != 0, F.col(x[0]).bitwiseXOR(F.col(x[i])).bitwiseAND(F.lit(q - 1))
            first = F.when(on, F.col(x[0]).bitwiseXOR(F.lit(q - 1))).otherwise(F.col(x[0]).bitwiseXOR(t))
            df = df.withColumns({x[0]: first} | ({x[i]: F.when(on, F.col(x[i])).otherwise(F.col(x[i]).bitwiseXOR(t))} if i else {}))
    for i in range(1, n):
        df = df.withColumn(x[i], F.col(x[i]).bitwiseXOR(F.col(x[i - 1])))
    t = F.lit(0)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        t = t.bitwiseXOR(F.when(F.col(x[-1]).bitwiseAND(F.lit(q)) != 0, F.lit(q - 1)).otherwise(F.lit(0)))
    df = df.withColumn("_ht", t)
    df = df.withColumns({c: F.col(c).bitwiseXOR(F.col("_ht")) for c in x})
    index = F.lit(0)
    for b in range(bits - 1, -1, -1):
        for c in x:
            index = index * 2 + F.shiftright(F.col(c), b).bitwiseAND(F.lit(1))
    return df.withColumn(name, index).drop("_ht", *x)


def _numeric_level(df: DataFrame, cols: list[str], bits: int) -> dict[str, Column]:
    """Each column's level by its own quantiles; the cut points are a constant number of values."""
    parts = [k / (1 << bits) for k in range(1, 1 << bits)]
    cuts = df.agg(*(F.percentile_approx(c, parts, 1000).alias(c) for c in cols)).first()
    return {c: sum((F.when(F.col(c) > v, 1).otherwise(0) for v in (cuts[c] or [])), F.lit(0)) for c in cols}


def _text_level(df: DataFrame, col: str, bits: int) -> DataFrame:
    """A row a value: the level that gives levels nearly equal counts in the order of the values."""
    counts = df.groupBy(col).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(col).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(Window.partitionBy())
    return counts.select(F.col(col).alias(f"_v_{col}"), F.floor(((before + F.col("_n") / 2) * (1 << bits)) / total).cast("int").alias(f"_l_{col}"))


def shard_plan(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and curve_index of each document."""
    raw = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "source", "lang", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"), F.xxhash64(raw).alias("_hash"))
    levels = _numeric_level(docs.select("doc_id", F.octet_length(raw).cast("long").alias("size")), ["doc_id", "size"], BITS)
    rows = rows.withColumns({f"_l_{c}": v for c, v in levels.items()})
    for c in ("source", "lang"):
        rows = rows.join(_text_level(docs.select(c), c, BITS), F.col(c).eqNullSafe(F.col(f"_v_{c}")), "left")
    rows = hilbert(rows, ["_l_source", "_l_lang", "_l_size", "_l_doc_id"], BITS, "curve_index")
    rows = rows.select("doc_id", "size", "text_crc32", "_hash", "curve_index")
    # equal texts stand at the place of their first; only texts that occur again are joined
    again = rows.groupBy("_hash", "text_crc32", "size").agg(F.min("curve_index").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    rows = rows.join(again, ["_hash", "text_crc32", "size"], "left").withColumn("curve_index", F.coalesce("_first", "curve_index")).withColumn("_n", F.coalesce("_n", F.lit(1))).drop("_first")
    order = [F.col("curve_index"), F.col("_hash"), F.col("text_crc32"), F.col("size"), F.col("doc_id")]
    rows = ranked(rows, order, {"_before": "size"})
    total = rows.agg(F.sum("size")).first()[0] or 0
    ideal = [k * total / shards for k in range(1, shards)]
    # the rows in which the ideal cuts lie; a large row may hold several
    at = F.array_compact(F.array(*(F.when((F.col("_before") <= c) & (c < F.col("_before") + F.col("size")), F.lit(k)) for k, c in enumerate(ideal))))
    cut = rows.select(F.explode(at).alias("_cut"), "_hash", "text_crc32", "size", "_n", F.col("_before").alias("_at"))  # shards - 1 rows at most
    keys = ["_hash", "text_crc32", "size"]
    ends = rows.drop("_n").join(F.broadcast(cut), keys).groupBy("_cut", "_n", "size", "_at").agg(F.min("_before").alias("lo"), F.max("_before").alias("hi")).collect()
    cuts = {}
    for r in ends:  # a row a cut
        whole = r["_n"] * r["size"] <= WHOLE_GROUP * total / shards
        lo, hi = (r["lo"], r["hi"] + r["size"]) if whole else (r["_at"], r["_at"] + r["size"])
        c = ideal[r["_cut"]]
        cuts[r["_cut"]] = lo if c - lo <= hi - c else hi
    shard = sum((F.when(F.col("_before") >= c, 1).otherwise(0) for c in cuts.values()), F.lit(0)).cast("int")
    rows = rows.withColumn("shard", shard)
    starts = rows.groupBy("shard").agg(F.min("rank").alias("_start"))  # a row a shard
    return rows.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("_start")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve_index"
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Whole documents under path/shard=k, each shard in curve order, for pruning by column statistics.

    Rows meet their places by id, size and checksum of the text, and rows alike in these by turns, so null and repeated
    ids and repeated rows keep a row each. Columns named shard or slot give way to the plan's.
    """
    raw, key = F.coalesce(F.col("text"), F.lit("")), ["_id", "_size", "_crc", "_turn"]
    turn = lambda *order: F.row_number().over(Window.partitionBy("_id", "_size", "_crc").orderBy(*order))
    ident = F.struct(F.coalesce("doc_id", F.lit(0)).alias("i"), F.col("doc_id").isNull().alias("n"))
    plan = shard_plan(docs, shards).select(ident.alias("_id"), F.col("size").alias("_size"), F.col("text_crc32").alias("_crc"), "shard", "slot")
    plan = plan.withColumn("_turn", turn("shard", "slot"))
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    rows = docs.select(F.struct(*kept).alias("_doc"), ident.alias("_id"), (F.octet_length(raw) + 1).cast("long").alias("_size"), F.crc32(raw.cast("binary")).alias("_crc"))
    rows = rows.withColumn("_turn", turn(F.xxhash64("_doc"))).join(plan, key).select(*(F.col("_doc")[c].alias(c) for c in kept), "shard", "slot")
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_plan(table(spark, sf_dir, "documents"))
