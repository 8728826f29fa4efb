"""The seeded order hash that stands in for every random draw, in BIGINT arithmetic that any SQL engine reproduces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

M = 2147483647


def h(key: Column | str, seed: int) -> Column:
    """A hash in [0, M) of a whole number 0 <= key < 6.9e9."""
    k = (F.col(key) if isinstance(key, str) else key).cast("long")
    x = (k * 1327217885 + seed * 69621 + 12345) % M
    return (x * (x % 65521 + 1)) % M


def h2(a: Column | str, b: Column | str, seed: int) -> Column:
    """A hash of a pair, folded from the left."""
    b = F.col(b) if isinstance(b, str) else b
    return h(h(a, seed) + b, seed)
