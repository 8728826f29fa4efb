"""Ranks over ranges stay right when Spark works an exchange out twice."""

from pyspark.sql import functions as F

from hopframe.operators.splits import numbered


def test_ranks_without_exchange_reuse(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.exchange.reuse", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        for adaptive in ("true", "false"):
            for k, v in zip(old, ("false", adaptive, "16"), strict=True):
                spark.conf.set(k, v)
            keys = spark.range(200_000).select(F.xxhash64("id").alias("k"))
            got = numbered(keys, "k", "n").agg(F.count_distinct("n"), F.min("n"), F.max("n")).first()
            assert tuple(got) == (200_000, 0, 199_999)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
