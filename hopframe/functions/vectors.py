"""Vector arithmetic on array columns, in double precision and inside the engine."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def clip_residual(base: Column, residual: Column, ratio: float) -> Column:
    """The factor that keeps a residual's norm within ratio of the base's."""
    return F.least(F.lit(1.0), F.greatest(norm(base), F.lit(1e-6)) * ratio / F.greatest(norm(residual), F.lit(1e-6)))


def vector_sum(vector: Column, dim: int, weight: Column | None = None) -> Column:
    """Aggregate: the sum of vectors of dim numbers, each times its weight; no row a dimension."""
    return F.array(*(F.sum(vector[i] if weight is None else vector[i] * weight) for i in range(dim)))


def plus(*vectors: Column) -> Column:
    out = vectors[0]
    for v in vectors[1:]:
        out = F.zip_with(out, v, lambda x, y: x + y)
    return out


def times(vector: Column, factor: Column) -> Column:
    return F.transform(vector, lambda x: x * factor)


def literal(numbers) -> Column:
    return F.array(*(F.lit(float(x)) for x in numbers))


def dense(x: Column, weight, bias=None) -> Column:
    """weight x + bias of given weights (a row an output); a batch of vectors is one matrix product.

    The weights travel with the task: they belong to a model of fixed size, not to the data.
    """
    import numpy as np

    w = np.asarray(weight, float)
    b = np.zeros(len(w)) if bias is None else np.asarray(bias, float)

    @F.arrow_udf(ArrayType(DoubleType()))
    def product(v: pa.Array) -> pa.Array:
        out = np.full((len(v), len(w)), np.nan)
        some = v.is_valid().to_numpy(zero_copy_only=False)
        out[some] = v.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, w.shape[1]) @ w.T + b
        sizes = pa.array(np.arange(0, out.size + 1, len(w), dtype=np.int32))
        return pa.ListArray.from_arrays(sizes, pa.array(out.ravel()), mask=pa.array(~some))

    return product(x)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def gelu(x: Column) -> Column:
    """x times the normal distribution function, by an approximation of erf with an error below 2e-7."""
    z = F.abs(x) / 2**0.5
    t = 1 / (1 + 0.3275911 * z)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-z * z)
    return x * F.when(x >= 0, 1 - tail / 2).otherwise(tail / 2)
