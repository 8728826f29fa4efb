"""Document fingerprints: SimHash in DataFrame operations only, and exact Hamming search over permuted block tables.

A text's terms are its five-word shingles (the whole sequence when it has fewer words), each weighted by how often it
occurs. Every term hash votes on 128 bits; a bit is set when more than half of the weight votes for it. The votes are
summed in whole-stage code: two 32-bit counters share a long, so a term costs 64 additions and no Python.

search() finds every fingerprint within a Hamming radius of up to 26: fingerprints are cut into nine blocks, eight of 14
bits and one of 16, and each block in turn comes first in a permuted table. Of two fingerprints within 26 bits at least
one block differs in two bits at most, so a query asks each table for its block and for all values two flips away. Texts
whose five-word shingles are 0.8 alike differ in 19 bits on average, hence the radius. Equal fingerprints are looked up
once.

Null texts count as empty. Texts without words have the fingerprint of zeros. The order is by falling id, ties by a
hash of the text, null ids last; the document after the last is the first, which for one document is itself. Repeated
rows each have the next row of that order as their next document. An empty table gives no rows. Other columns,
whatever their names, are not carried.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopframe.llm.common import checkpointed, ranked, table, words

BITS, RADIUS, WORDS = 128, 26, 5
#: Bits of each block (the last is what the others leave of both halves), and flips in a block that are asked for; the
#: radius is below blocks times (flips + 1).
BLOCKS, FLIPS = (14,) * 8 + (16,), 2
#: Documents in a bucket of the order, and the most cut points; beyond their product buckets grow.
ROWS_PER_BUCKET, MOST_BUCKETS = 2_000, 1_000_000
_LOW, _HALF = 0x0000000100000001, 0xFFFFFFFF


def terms(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the array of term hashes of a text column."""
    df = df.withColumn("_w", words(text))
    several = F.expr(f"transform(slice(_w, 1, size(_w) - {WORDS - 1}), (x, i) -> xxhash64(x, {', '.join(f'_w[i + {k}]' for k in range(1, WORDS))}))")
    return df.withColumn(name, F.when(F.size("_w") >= WORDS, several).when(F.size("_w") > 0, F.array(F.xxhash64("_w"))).otherwise(F.array().cast("array<long>"))).drop("_w")


def fingerprints(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and `fp`, two longs a row: df's texts by SimHash. The keys tell rows apart."""
    df = terms(df.select(*keys, text), text, "_terms").select(*keys, F.explode_outer("_terms").alias("_a"))
    df = df.withColumn("_b", F.when(F.col("_a").isNotNull(), F.xxhash64("_a", F.lit(7))))  # no term, no vote
    sums = [F.sum(F.shiftrightunsigned(c, k).bitwiseAND(F.lit(_LOW))).alias(f"{c}{k}") for c in ("_a", "_b") for k in range(32)]
    df = df.groupBy(*keys).agg(F.count("_a").alias("_n"), *sums)

    def bits(c: str) -> Column:
        out = F.lit(0).cast("long")
        for k in range(32):
            votes = F.coalesce(F.col(f"{c}{k}"), F.lit(0))
            low, high = votes.bitwiseAND(F.lit(_HALF)), F.shiftrightunsigned(votes, 32)
            out = out.bitwiseOR(F.when(2 * low > F.col("_n"), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
            out = out.bitwiseOR(F.when(2 * high > F.col("_n"), F.lit((1 << (k + 32)) - (1 << 64 if k == 31 else 0))).otherwise(F.lit(0)).cast("long"))
        return out

    return df.select(*keys, F.struct(bits("_a").alias("a"), bits("_b").alias("b")).alias("fp"))


def as_hex(fp: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(fp["a"]), 16, "0"), F.lpad(F.hex(fp["b"]), 16, "0")))


def distance(x: Column, y: Column) -> Column:
    return F.bit_count(x["a"].bitwiseXOR(y["a"])) + F.bit_count(x["b"].bitwiseXOR(y["b"]))


def _cut_points(keys: DataFrame) -> Column:
    """The cut points of the order as one value that a job works out when it runs: first, the least key of all, and the
    others in `groups` of about the root of their number with their `heads`, so that a key is held against two short
    lists. At most MOST_BUCKETS points, 16 bytes each; no part of the plan grows with them.
    """
    n = keys.count()
    each = max(ROWS_PER_BUCKET, -(-n // MOST_BUCKETS))
    ends = ranked(keys, [F.col("_key")], {}).filter(F.col("rank") % each == 0).select("_key").distinct()
    points = ends.agg(F.array_sort(F.collect_list("_key")).alias("p")).select(F.get("p", F.lit(0)).alias("first"), F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))).alias("p"))
    width = F.ceil(F.sqrt(F.greatest(F.size("p"), F.lit(1)))).cast("int")
    starts = F.when(F.size("p") > 0, F.sequence(F.lit(1), F.size("p"), width)).otherwise(F.array().cast("array<int>"))
    points = points.select("first", width.alias("width"), F.size("p").alias("n"), F.transform(starts, lambda i: F.slice("p", i, F.col("width"))).alias("groups"))
    return checkpointed(points.withColumn("heads", F.transform("groups", lambda g: F.get(g, F.lit(0))))).select(F.struct("first", "width", "n", "groups", "heads")).scalar()


def _at_most(cuts: Column, key: Column) -> tuple[Column, Column]:
    """How many cut points are no larger than a key, and whether one equals it.

    A key's place in a short list is its place once the list is sorted with it; a sorted list but for its last takes one
    pass. Nothing of the lists enters a row.
    """

    def before(a: Column) -> Column:
        return F.array_position(F.sort_array(F.array_append(a, key)), key) - 1 + F.array_contains(a, key).cast("int")

    group = before(cuts["heads"]).cast("int")
    own = F.get(cuts["groups"], F.greatest(group - 1, F.lit(0)))
    return F.when(group > 0, (group - 1) * cuts["width"] + before(own)).otherwise(F.lit(0)), F.coalesce(F.array_contains(own, key), F.lit(False))


def in_falling_order(docs: DataFrame) -> DataFrame:
    """bucket, place, ghost, doc_id, text and next_text, by falling doc_id.

    The ranks of ids and text hashes give cut points that deal the rows to buckets, so each window is bounded. The head
    of each bucket also goes to the bucket before it as a ghost, and the very first document to the last bucket, so
    every row sees its next.
    """
    key = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).cast("long").bitwiseXOR(F.lit(-1)).alias("u"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key.alias("_key"))
    cuts = _cut_points(docs.select(key.alias("_key")))
    bucket, heads = _at_most(cuts, F.col("_key"))
    rows = rows.withColumns({"_bucket": bucket, "_head": heads})
    # as a ghost the top row follows the last bucket; the others follow the bucket before their own
    ghost = F.when(F.col("_key") == cuts["first"], cuts["n"]).when(F.col("_head"), F.col("_bucket") - 1)
    rows = rows.withColumn("_ghost", ghost)
    rows = rows.withColumn("_in", F.array_compact(F.array(F.struct(F.col("_bucket").alias("bucket"), F.lit(False).alias("ghost")), F.when(F.col("_ghost").isNotNull(), F.struct(F.col("_ghost").alias("bucket"), F.lit(True).alias("ghost"))))))
    rows = rows.select("doc_id", "text", "_key", F.explode("_in").alias("_in")).select("_in.*", "doc_id", "text", "_key")
    order = Window.partitionBy("bucket").orderBy("ghost", "_key")
    return rows.withColumns({"place": F.row_number().over(order), "next_text": F.lead("text").over(order)}).drop("_key")


def edited(text: Column, following: Column) -> Column:
    """text with its last third replaced by as many of the first characters of following."""
    k = F.floor(F.char_length(text) / 3).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.char_length(text) - k), F.substr(following, F.lit(1), k))


def neighbour_fingerprints(docs: DataFrame) -> DataFrame:
    rows = in_falling_order(docs)
    text, side = F.col("text"), F.struct
    plain = side(F.lit(0).alias("side"), text.alias("body"), F.lit(None).cast("string").alias("sha"))
    changed = edited(text, F.col("next_text"))
    other = side(F.lit(1).alias("side"), changed.alias("body"), F.sha2(changed.cast("binary"), 256).alias("sha"))
    rows = rows.withColumn("_both", F.when(F.col("ghost"), F.array(plain)).otherwise(F.array(plain, other)))
    rows = rows.select("bucket", "place", "ghost", "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.inline("_both"))
    fps = fingerprints(rows, ["bucket", "place", "ghost", "doc_id", "n_chars", "side", "sha"], "body")
    order = Window.partitionBy("bucket").orderBy("place", "side")
    fps = fps.withColumns({"_edited": F.lead("fp", 1).over(order), "_sha": F.lead("sha", 1).over(order), "_next": F.lead("fp", 2).over(order)}).filter(~F.col("ghost") & (F.col("side") == 0))
    likeness = lambda x, y: 1.0 - distance(x, y) / F.lit(float(BITS))
    return fps.select(
        "doc_id", "n_chars", F.col("_sha").alias("edited_sha256"), as_hex(F.col("fp")).alias("fingerprint"), as_hex(F.col("_edited")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("_edited")).alias("near_edited"), likeness(F.col("fp"), F.col("_next")).alias("near_next"), F.col("fp").alias("_fp"),
    )


def blocks(fp: Column) -> Column:
    """The permuted tables' leading blocks, one after another; the last has the 8 bits that each half has left."""
    part = lambda half, at, n: F.shiftrightunsigned(fp[half], at).bitwiseAND(F.lit((1 << n) - 1)).cast("int")
    rest = F.shiftleft(part("a", 56, 8), 8).bitwiseOR(part("b", 56, 8))
    return F.array(*(part(half, 14 * k, 14) for half in ("a", "b") for k in range(4)), rest)


def search(queries: DataFrame, index: DataFrame, radius: int = RADIUS) -> DataFrame:
    """query, key, distance: for each query (query, fp) every row of index (key, fp) within the radius, exactly.

    Queries and index are joined by table and leading block; a pair that meets in several tables is kept for the first
    of them only, so no distinct is needed.
    """
    if radius >= len(BLOCKS) * (FLIPS + 1):
        raise ValueError(f"a radius of {radius} needs more flips or more blocks")
    flips = [sorted({sum(1 << k for k in c) for n in range(FLIPS + 1) for c in combinations(range(bits), n)}) for bits in BLOCKS]
    masks = F.array(*(F.array(*map(F.lit, f)) for f in flips))
    near = lambda v: F.transform(F.get(masks, F.col("table")), lambda m: v.bitwiseXOR(m))
    q = queries.select("query", F.col("fp").alias("_q"), F.posexplode(blocks(F.col("fp"))).alias("table", "_v"))
    q = q.select("query", "_q", "table", F.explode(near(F.col("_v"))).alias("lead"))
    x = index.select("key", F.col("fp").alias("_x"), F.posexplode(blocks(F.col("fp"))).alias("table", "lead"))
    hits = q.join(x, ["table", "lead"]).withColumn("distance", distance(F.col("_q"), F.col("_x"))).filter(F.col("distance") <= radius)
    meet = F.zip_with(blocks(F.col("_q")), blocks(F.col("_x")), lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= FLIPS)
    return hits.filter(F.array_position(meet, F.lit(True)) == F.col("table") + 1).select("query", "key", "distance")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds n_near: for ids divisible by 50, how many documents have a fingerprint within the radius, itself included."""
    rows = checkpointed(neighbour_fingerprints(table(spark, sf_dir, "documents")))
    distinct = rows.groupBy(F.col("_fp").alias("key")).agg(F.count("*").alias("_n"), F.max((F.col("doc_id") % 50 == 0)).alias("_asked"))
    asked = distinct.filter("_asked").select(F.col("key").alias("query"), F.col("key").alias("fp"))
    hits = search(asked, distinct.select("key", F.col("key").alias("fp"))).join(distinct.select("key", "_n"), "key")
    near = hits.groupBy(F.col("query").alias("_fp")).agg(F.sum("_n").alias("_near"))
    return rows.join(near, "_fp", "left").withColumn("n_near", F.when(F.col("doc_id") % 50 == 0, F.col("_near"))).drop("_fp", "_near")
