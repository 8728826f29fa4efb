"""The few functions SQL cannot state, as Arrow-batched pandas functions."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

DIM = 16


def stable_index(token: str, dim: int) -> tuple[int, float]:
    """A token's place and sign from its BLAKE2b hash."""
    b = hashlib.blake2b(token.encode(), digest_size=16).digest()
    return int.from_bytes(b[:8], "little") % dim, 1.0 if b[8] % 2 == 0 else -1.0


def embed(text: str | None, dim: int = DIM) -> list[float]:
    """Hashed bag of words, L2-normalised; zeros for a text without words."""
    x = [0.0] * dim
    for t in re.findall(r"[A-Za-z0-9_]+", (text or "").lower()):
        i, sign = stable_index(t, dim)
        x[i] += sign
    norm = sum(v * v for v in x) ** 0.5
    return [v / norm for v in x] if norm else x


@pandas_udf(ArrayType(DoubleType()))
def light_embedding(texts: pd.Series) -> pd.Series:
    return texts.map(embed)


_TOKEN = re.compile(r"\w+|[^\w\s]")


def lcs(a: list[str], b: list[str]) -> int:
    """The length of the longest common subsequence, a bit a token of a: linear in b for short a."""
    at: dict[str, int] = {}
    for i, t in enumerate(a):
        at[t] = at.get(t, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for t in b:
        m = row & at.get(t, 0)
        row = ((row + m) | (row - m)) & full
    return len(a) - row.bit_count()


def rouge_l_score(pred: str | None, label: str | None) -> float:
    p, q = _TOKEN.findall((pred or "").lower()), _TOKEN.findall((label or "").lower())
    n = lcs(p, q) if p and q else 0
    return 2 * n / (len(p) + len(q)) if n else 0.0


@pandas_udf(DoubleType())
def rouge_l_f1(preds: pd.Series, labels: pd.Series) -> pd.Series:
    return pd.Series([rouge_l_score(p, q) for p, q in zip(preds, labels, strict=True)])
