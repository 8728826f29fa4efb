"""Exact nearest neighbours: blocks of queries meet blocks of vectors, a block pair is one matrix product."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of vectors and of a block of queries, and queries and pairs that a task has in hand at once.
VECTORS, QUERIES, AT_ONCE, PAIRS = 16_384, 16_384, 256, 65_536
#: Two cosines so far apart have different roundings to six digits, the error of a matrix product included.
STEP = 1.01e-6


def nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """qid, vec_id, sim: the k vectors (vec_id, embedding) nearest to each query (qid, q) by cosine, rounded to six
    digits, but not that of the query's own number; ties by vec_id, pairs without a cosine last.

    Blocks are dealt by hash, so work is spread evenly and a task's memory is bounded, whatever the tables' sizes. The
    product of two blocks only names the pairs that may be among the first; these are summed anew term by term.
    """
    cells, groups = (max(1, math.ceil(df.count() / n)) for df, n in ((vectors, VECTORS), (queries, QUERIES)))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.filter("qid is not null").select(each(cells).alias("_c"), deal("qid", groups).alias("_g"), "qid", "q")
    v = vectors.filter("vec_id is not null").select(deal("vec_id", cells).alias("_c"), each(groups).alias("_g"), "vec_id", F.col("embedding").alias("v"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = list(_block(_column(left, "qid"), *_matrix(left.column("q")), _column(right, "vec_id"), *_matrix(right.column("v")), k))
        qid, vec, sim, some = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else ([], [], [], np.zeros(0, bool))
        return pa.table({"qid": pa.array(qid, pa.int64()), "vec_id": pa.array(vec, pa.int64()), "sim": pa.array(sim, pa.float64(), mask=~some)})

    got = q.groupBy("_c", "_g").cogroup(v.groupBy("_c", "_g")).applyInArrow(meet, "qid long, vec_id long, sim double")
    by = Window.partitionBy("qid").orderBy(F.desc("sim"), "vec_id")
    return got.withColumn("sim", F.round("sim", 6)).withColumn("_r", F.row_number().over(by)).filter(F.col("_r") <= k).drop("_r")


def _column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy().astype(np.int64)


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as rows, filled up with zeros, and their lengths; -1 for one that is null or holds a null."""
    x = column.combine_chunks()
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    size = np.where(np.asarray(x.is_valid()), np.asarray(x.value_lengths().fill_null(0)), -1)
    flat, row = x.flatten(), np.repeat(np.arange(len(x)), np.maximum(size, 0))
    place = np.arange(len(row)) - np.repeat(np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0), np.maximum(size, 0))
    out = np.zeros((len(x), max(1, size.max(initial=0))))
    out[row, place] = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
    size[row[np.asarray(flat.is_null())]] = -1
    return out, size


def _sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The products of rows, summed from the first to the last."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def _first(ids: np.ndarray, qid: int, k: int) -> np.ndarray:
    return ids[ids != qid][:k]


def _block(qid: np.ndarray, q: np.ndarray, q_size: np.ndarray, vec: np.ndarray, v: np.ndarray, v_size: np.ndarray, k: int) -> Iterator[tuple]:
    """qid, vec_id, cosine, whether there is one: of each query the pairs of this block that may be among its first k."""
    order = np.argsort(vec, kind="stable")
    vec, v, v_size = vec[order], v[order], v_size[order]
    with np.errstate(all="ignore"):
        q_norm, v_norm = np.sqrt(_sum(q, q)), np.sqrt(_sum(v, v))
    for size in np.unique(q_size):
        mine, like = np.flatnonzero(q_size == size), v_size == size
        strange = np.flatnonzero(like & ~np.isfinite(v_norm)) if size >= 0 else np.zeros(0, int)
        plain = np.flatnonzero(like & np.isfinite(v_norm) & (v_norm > 0)) if size >= 0 else np.zeros(0, int)
        zero = like & (v_norm == 0)
        usual = mine[np.isfinite(q_norm[mine]) & (q_norm[mine] > 0)] if size > 0 else mine[:0]
        whole = v[plain, : max(size, 0)]
        unit = whole / v_norm[plain, None]
        for at in range(0, len(usual), AT_ONCE):
            some = usual[at : at + AT_ONCE]
            if len(plain):
                yield from _pairs(qid[some], q[some, :size], q_norm[some], vec[plain], whole, v_norm[plain], unit, k)
        others = np.flatnonzero(~like | zero)
        for i in mine:
            # what is not finite has no number for a cosine and comes first, no cosine at all comes last
            if size < 0 or q_norm[i] == 0:
                nan, null = strange if size >= 0 else strange[:0], np.setdiff1d(np.arange(len(vec)), strange)
            elif not np.isfinite(q_norm[i]):
                nan, null = np.flatnonzero(like), np.flatnonzero(~like)
            else:
                nan, null = strange, others if len(strange) + len(plain) <= k else others[:0]
            for rows, there in ((nan, True), (null, False)):
                ids = _first(vec[rows], qid[i], k)
                if len(ids):
                    yield np.full(len(ids), qid[i]), ids, np.full(len(ids), np.nan), np.full(len(ids), there)


def _pairs(qid: np.ndarray, q: np.ndarray, q_norm: np.ndarray, vec: np.ndarray, v: np.ndarray, v_norm: np.ndarray, unit: np.ndarray, k: int) -> Iterator[tuple]:
    near = q / q_norm[:, None] @ unit.T
    near[qid[:, None] == vec[None, :]] = -np.inf
    last = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(near), -np.inf)
    a, b = np.nonzero((near >= last[:, None] - STEP) & (near > -np.inf))
    sim = np.empty(len(a))
    for at in range(0, len(a), PAIRS):
        s = slice(at, at + PAIRS)
        sim[s] = _sum(q[a[s]], v[b[s]]) / (q_norm[a[s]] * v_norm[b[s]])
    # by rounded cosine and id; near the middle between two roundings, what Spark will make of it is left open
    scaled = sim * 1e6
    unsure = np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4
    order = np.lexsort((vec[b], -np.floor(scaled + 0.5), a, unsure))
    a, b, sim, unsure = a[order], b[order], sim[order], unsure[order]
    sure = int((~unsure).sum())
    rank = np.arange(sure) - np.searchsorted(a[:sure], a[:sure])
    kept = np.concatenate([rank < k, np.ones(len(a) - sure, bool)])
    yield qid[a[kept]], vec[b[kept]], sim[kept], np.ones(int(kept.sum()), bool)
