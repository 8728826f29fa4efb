"""Task filters, explicit and stratified splits, epoch shards and monitor steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopframe.functions.hashing import h
from hopframe.functions.text import ENTITY_FAMILIES, task_family
from hopframe.session import checkpointed

# The filters by name, each with the families it keeps; None keeps all.
TASK_FILTERS: dict[str, tuple[str, ...] | None] = {
    "all": None, "counting": ("counting",), "entity": tuple(ENTITY_FAMILIES), "hop": ("hop",), "path_witness": ("path_witness",), "topic": ("topic",),
    "author_lookup": ("author_lookup",), "venue_lookup": ("venue_lookup",), "collab_rank": ("collab_rank",), "citation_rank": ("citation_rank",),
    "graph_lookup": ("graph_lookup",), "other": ("other",),
}
WITNESS_DOMAINS = ("pathexist_witness", "path_witness")
SPLITS = ("train", "val", "test")


def resolved_filter(name: str | None, domain: str | None) -> str:
    """The filter that applies: witness domains turn all and hop into path_witness. Unknown names are an error."""
    name = str(name or "all").strip().lower()
    if name not in TASK_FILTERS:
        raise ValueError(f"no such task filter: {name}")
    if any(x in str(domain or "").lower() for x in WITNESS_DOMAINS) and name in ("all", "hop", "path_witness"):
        return "path_witness"
    return name


def task_filtered(samples: DataFrame, name: str | None, domain: str | None = None, question: str = "question") -> DataFrame:
    """The samples whose question is of the filter's families; where none is, an error lists the families there are."""
    families = TASK_FILTERS[resolved_filter(name, domain)]
    if families is None:
        return samples
    family = task_family(F.col(question))
    kept = samples.filter(family.isin(*families))
    if kept.isEmpty():
        seen = sorted((r["f"], r["n"]) for r in samples.groupBy(family.alias("f")).agg(F.count("*").alias("n")).collect())  # a row a family
        raise ValueError(f"no sample matches the filter {name}; families: {', '.join(f'{f}={n}' for f, n in seen) or 'none'}")
    return kept


def ranked(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows with their rank from 0 in the order of the keys in `name`, without sorting all rows in one task.

    Rows are dealt by ranges of the keys, ranked within each range, and shifted by the rows of the ranges before. The
    ranges are written before they are counted: bounds are sampled anew each time rows are dealt, so sizes and ranks
    would else come from different ranges.
    """
    placed = checkpointed(rows.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))  # a row a range
    start = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    local = placed.withColumn("_rn", F.row_number().over(Window.partitionBy("_range").orderBy(*keys)) - 1)
    return local.join(F.broadcast(start), "_range").withColumn(name, (F.col("_rn") + F.col("_start")).cast("long")).drop("_range", "_rn", "_start")


def numbered(samples: DataFrame, key: str, name: str) -> DataFrame:
    """key and its rank from 0 in `name`."""
    return ranked(samples.select(key), [key], name)


def explicit_split(listed: DataFrame, kept: DataFrame, n_samples: int) -> DataFrame:
    """split, sample_index of listed (split, raw_index) over kept (raw_index, sample_index), distinct.

    A split whose raw indices are all kept is mapped; one that isn't, but whose numbers all are sample indices, is taken
    as such. Anything else is an error, as are indices in two splits and an empty train or test split.
    """
    joined = listed.join(kept, "raw_index", "left")
    inside = F.col("raw_index").between(0, n_samples - 1)
    state = {r["split"]: r for r in joined.groupBy("split").agg(F.every(F.col("sample_index").isNotNull()).alias("mapped"), F.every(inside).alias("inside")).collect()}  # a row a split
    for name, r in sorted(state.items()):
        if not r["mapped"] and not r["inside"]:
            raise ValueError(f"split {name} has indices outside the raw and the filtered samples")
    mapped = [k for k, r in state.items() if r["mapped"]]
    out = joined.select("split", F.when(F.col("split").isin(*mapped), F.col("sample_index")).otherwise(F.col("raw_index")).alias("sample_index")).distinct()
    if not overlapping(out, "sample_index").isEmpty():
        raise ValueError("splits overlap")
    for name in ("train", "test"):
        if name not in state:
            raise ValueError(f"the {name} split is empty")
    return out


def overlapping(splits: DataFrame, key: str) -> DataFrame:
    """The keys that stand in more than one split."""
    return splits.groupBy(key).agg(F.count_distinct("split").alias("n")).filter("n > 1").select(key)


def _turn(strata: DataFrame, target: int, name: str) -> DataFrame:
    """strata (k, left) with `name`: how many of each go into a split of `target`, by largest remainders."""
    all_ = Window.partitionBy()  # a row a stratum
    x = strata.withColumn("_raw", F.coalesce(F.try_divide(F.col("left") * target, F.sum("left").over(all_)), F.lit(0.0)))
    x = x.withColumn("_base", F.least(F.col("left"), F.floor("_raw")))
    # one more each, the largest remainder first, to strata that have room
    rank = F.row_number().over(Window.orderBy((F.col("_base") < F.col("left")).desc(), F.desc(F.col("_raw") - F.col("_base")), F.desc(F.col("left") - F.col("_base")), F.desc("k")))
    x = x.withColumn(name, (F.col("_base") + (rank <= F.lit(target) - F.sum("_base").over(all_)).cast("long")).cast("long"))
    return x.withColumn("left", F.col("left") - F.col(name)).drop("_raw", "_base")


def stratified_split(rows: DataFrame, key: str, stratum: str, counts: tuple[int, int, int], seed: int) -> DataFrame:
    """rows' key with its split: exact counts, in each turn apportioned over what the turns before left of a stratum.

    Blank and null strata are one, "unknown". The counts must add up to the rows. A stratum's rows are in hash order.
    """
    if min(counts) < 0:
        raise ValueError("split counts must not be negative")
    x = rows.select(key, F.coalesce(F.nullif(F.trim(F.col(stratum).cast("string")), F.lit("")), F.lit("unknown")).alias("k"))
    strata = x.groupBy("k").agg(F.count("*").alias("left"))
    total = strata.agg(F.sum("left")).first()[0] or 0
    if total != sum(counts):
        raise ValueError(f"split counts add up to {sum(counts)}, rows to {total}")
    for name, n in zip(SPLITS, counts, strict=True):
        strata = _turn(strata, n, name)
    rank = F.row_number().over(Window.partitionBy("k").orderBy(h(key, seed), key))
    x = x.withColumn("_rn", rank).join(F.broadcast(strata), "k")  # a row a stratum
    return x.select(key, F.when(F.col("_rn") <= F.col("train"), "train").when(F.col("_rn") <= F.col("train") + F.col("val"), "val").otherwise("test").alias("split"))


def epoch_shard(position: Column, world: int, n: int, drop_last: bool = False) -> tuple[Column, Column]:
    """The rank that reads the row at a position of an epoch, and whether the epoch reads it at all."""
    return F.pmod(position, F.lit(world)).cast("int"), (position < n // world * world) if drop_last else F.lit(True)


def monitor_steps(steps: DataFrame, every: int) -> DataFrame:
    """step, better of a table step, em: at every so many optimizer steps, whether its score beats all before it."""
    x = steps.filter((F.col("step") > 0) & (F.col("step") % every == 0))
    before = F.max("em").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1))  # a row a monitored step
    return x.select("step", "em", (before.isNull() | (F.col("em") > before)).alias("better"))
