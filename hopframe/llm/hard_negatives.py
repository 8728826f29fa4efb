"""Hard-negative mining: exact top-k by inner product over k-means inverted lists with stored centroid radii.

K-means is fitted on at most FIT_ROWS rows, chosen by a hash of their content; every row is then indexed in the list
of its nearest centroid, and each list keeps its radius, the greatest distance of a row to its centroid. By
Cauchy-Schwarz a query q scores every row of a list between <q,c> - |q|r and <q,c> + |q|r. A query visits the lists by
descending upper bound, skips those that lie outside its score window, and stops when the next bound falls strictly
below its kth score, so ties are never lost. It visits them in rounds of growing width: each round joins queries with
lists, in blocks of bounded size, and the kth score so far decides who goes on. Long lists are cut into parts by hash,
so a list that holds a third of all rows is many tasks. Results are exact: the index only saves work.

Rows with a null label, a null vector, or a null or non-finite component take no part; the shorter of two vectors of
unequal length counts as padded with zeros. Rows are told apart by place, not by id: repeated rows are other rows.
Null ids come last in ties and are never anchors. Ties beyond the id are broken by an internal row number. Scores are
computed exactly, in doubles where they and the window's multiples of them fit 53 bits and in unbounded integers
otherwise; a score that a long cannot hold is an error. Other columns are ignored. An empty table, or one without anchors, gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from hopframe.llm.common import checkpointed, table, tidied

#: Rows that k-means is fitted on, at most; rounds of the fit.
FIT_ROWS, FIT_ROUNDS = 32_768, 6
#: Lists at most, and numbers in all centroids at most (8 MB): what travels to every task is bounded.
MOST_LISTS, MOST_NUMBERS = 4_096, 1 << 20
#: Rows of a part of a list, and queries of a block, about.
PART_ROWS, QUERY_ROWS = 4_096, 512
#: Lists that a query visits in the first round, and the growth from round to round.
WIDTH, GROWTH = 16, 8
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
#: Stands for a null id in comparisons, where nulls come last.
LAST = 2**63 - 1


# ---- the index


def _matrix(column, dim: int):
    """An Arrow list column as a matrix of doubles, shorter rows padded with zeros."""
    import numpy as np

    column = column.cast(pa.large_list(pa.float64()))
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    values, sizes = column.values.to_numpy(zero_copy_only=False), np.diff(offsets)
    if (sizes == dim).all():
        return values[offsets[0] : offsets[-1]].reshape(-1, dim)
    out = np.zeros((len(sizes), dim))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(rows)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = values[offsets[0] : offsets[-1]]
    return out


def fitted(rows: DataFrame, n: int, dim: int):
    """Centroids from a bounded sample: the rows of least content hash among a share of about twice FIT_ROWS."""
    import numpy as np
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    lists = max(1, min(MOST_LISTS, MOST_NUMBERS // max(dim, 1), int(n**0.5)))
    padded = F.concat("v", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("v")))
    of = F.xxhash64("vec_id", "v")
    share = rows.filter(F.pmod(of, F.lit(1 << 20)) < min(1 << 20, max(1, (FIT_ROWS * 2 << 20) // n)))
    sample = share.orderBy(of).limit(FIT_ROWS).select(array_to_vector(padded).alias("features"))
    if lists == 1 or sample.isEmpty():
        return np.zeros((1, dim))
    model = KMeans(k=lists, seed=7, maxIter=FIT_ROUNDS, initSteps=1).fit(checkpointed(sample))
    return np.array(model.clusterCenters())


def indexed(rows: DataFrame, centroids) -> DataFrame:
    """rows (vec_id, label, v, anchor) with row (a number), list (of the nearest centroid) and distance to its centroid."""
    dim, schema = centroids.shape[1], "vec_id long, label int, v array<double>, anchor boolean, list int, distance double"

    def assigned(batches):
        import numpy as np

        squares = (centroids**2).sum(1)
        for b in batches:
            m = _matrix(b.column(2), dim)
            nearest = np.zeros(len(m), np.int32)
            for s in range(0, len(m), 1024):
                nearest[s : s + 1024] = (squares - 2 * (m[s : s + 1024] @ centroids.T)).argmin(1)
            distance = np.sqrt(((m - centroids[nearest]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nearest), pa.array(distance)], ["vec_id", "label", "v", "anchor", "list", "distance"])

    return checkpointed(rows.mapInArrow(tidied(assigned), schema).withColumn("row", F.monotonically_increasing_id()))


class Index:
    """Centroids, radii and sizes of all lists (bounded), and the rows of the lists in parts, one row a part."""

    def __init__(self, rows: DataFrame, n: int, dim: int) -> None:
        import numpy as np

        centroids = fitted(rows, n, dim)
        self.spark, self.dim, self.centroids = rows.sparkSession, dim, centroids
        self.rows = indexed(rows, centroids)
        # at most MOST_LISTS rows
        stats = self.rows.groupBy("list").agg(F.max("distance").alias("radius"), F.count("*").alias("n")).collect()
        self.radii, self.used = np.zeros(len(centroids)), np.zeros(len(centroids), bool)
        for s in stats:
            self.radii[s.list], self.used[s.list] = s.radius, True
        self.sizes = self.spark.createDataFrame([(s.list, -(-s.n // PART_ROWS)) for s in stats], "list int, parts long")
        members = self.rows.join(F.broadcast(self.sizes), "list").withColumn("part", F.pmod(F.xxhash64("row"), "parts"))
        self.parts = checkpointed(members.groupBy("list", "part").agg(F.collect_list(F.struct("row", "vec_id", "label", "v")).alias("members")))


# ---- the search


def visits(index: Index, low: int, high: int, scale: int):
    """A function of queries: the lists that each visits this round, at most `width` from place `seen` on.

    window: the positive's score, null for no window; kth: the kth score so far, null while there are fewer.
    """
    centroids, radii, used, dim = index.centroids, index.radii, index.used, index.dim

    @F.arrow_udf(ArrayType(IntegerType()))
    def chosen(v: pa.Array, window: pa.Array, kth: pa.Array, seen: pa.Array, width: pa.Array) -> pa.Array:
        import numpy as np

        m, norms, out = _matrix(v, dim), np.sqrt((centroids**2).sum(1)), []
        args = list(zip(window.to_pylist(), kth.to_pylist(), seen.to_pylist(), width.to_pylist(), strict=True))
        for s in range(0, len(m), 256):
            lengths, mid = np.sqrt((m[s : s + 256] ** 2).sum(1))[:, None], m[s : s + 256] @ centroids.T
            slack = 1 + 1e-9 * lengths * (norms + radii)  # rounding never costs a list
            upper, lower = mid + lengths * radii + slack, mid - lengths * radii - slack
            for up, down, (p, k, at, w) in zip(upper, lower, args[s : s + 256], strict=True):
                ok, bound = used, up
                if p is not None:
                    ok = used & (scale * up >= low * p) & (scale * down <= high * p)
                    bound = np.minimum(up, high * p / scale + 1)
                order = np.argsort(np.where(ok, -bound, np.inf), kind="stable")[: int(ok.sum())][at : at + w]
                out.append(order[bound[order] >= k] if k is not None else order)
        return pa.array(out, pa.list_(pa.int32()))

    return chosen


def best_in(dim: int, k: int, same: bool, low: int, high: int, scale: int):
    """mapInArrow function: the first k rows of a part for every query of a block."""

    def scored(batches):
        import numpy as np

        for batch in batches:
            for i in range(batch.num_rows):
                asked, members = batch.column(0).slice(i, 1).flatten(), batch.column(1).slice(i, 1).flatten()
                q, m = _matrix(asked.field("v"), dim), _matrix(members.field("v"), dim)
                if np.sqrt((q**2).sum(1).max() * (m**2).sum(1).max()) * max(low, high, scale) < 2**52:
                    scores, exact = q @ m.T, np.int64
                else:
                    whole = lambda a: np.array([[int(x) for x in r] for r in a.tolist()], object)
                    scores, exact = whole(q).dot(whole(m).T), object
                rows, labels = (members.field(x).to_numpy(zero_copy_only=False) for x in ("row", "label"))
                ids = members.field("vec_id").fill_null(LAST).to_numpy(zero_copy_only=False)
                out = []
                for j, (key, p, row, label, window) in enumerate(zip(*(asked.field(x).to_pylist() for x in ("key", "p", "row", "label", "window")), strict=True)):
                    s = scores[j]
                    ok = ((labels == label) & (rows != row)) if same else labels != label
                    if window is not None:
                        ok = ok & (scale * s >= low * window) & (scale * s <= high * window)
                    at = np.flatnonzero(ok)
                    if len(at) > k and exact is np.int64:
                        at = at[s[at] >= np.partition(s[at], -k)[-k]]  # ties at the kth stay until ids decide
                    order = sorted(at.tolist(), key=lambda x: (-s[x], ids[x], rows[x]))[:k]
                    out += [(key, p, int(rows[x]), int(ids[x]), int(s[x])) for x in order]
                cols = list(zip(*out, strict=True)) or [[]] * 5
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["key", "p", "found", "found_id", "score"])

    return tidied(scored)


def search(index: Index, queries: DataFrame, k: int, same: bool, low: int = 0, high: int = 0, scale: int = 1) -> DataFrame:
    """key, p, found, found_id, score, rank: for each query (key, p, row, label, v, window) its first k rows of the same
    or of another label whose scores lie in its window; higher scores first, ties by smaller id.
    """
    chosen, scored = visits(index, low, high, scale), best_in(index.dim, k, same, low, high, scale)
    order = Window.partitionBy("key", "p").orderBy(F.desc("score"), "found_id", "found")
    best, seen, width, lists = None, 0, WIDTH, len(index.centroids)
    while seen < lists:
        asking = queries
        if best is None:
            asking = asking.withColumn("kth", F.lit(None).cast("long"))
        else:
            kth = best.filter(F.col("rank") == k).select("key", "p", F.col("score").alias("kth"))
            asking = asking.join(kth, ["key", "p"], "left")
        now = asking.withColumn("list", F.explode(chosen("v", "window", "kth", F.lit(seen), F.lit(width)))).drop("kth")
        now = checkpointed(now)
        # at most MOST_LISTS rows
        blocks = now.groupBy("list").agg(F.ceil(F.count("*") / QUERY_ROWS).alias("blocks"))
        now = now.join(F.broadcast(blocks), "list").withColumn("block", F.pmod(F.xxhash64("key", "p"), "blocks"))
        now = now.groupBy("list", "block").agg(F.collect_list(F.struct("key", "p", "row", "label", "v", "window")).alias("asked"))
        now = now.join(F.broadcast(index.sizes), "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        met = now.join(index.parts, ["list", "part"]).select("asked", "members")
        found = met.mapInArrow(scored, "key long, p int, found long, found_id long, score long")
        found = found if best is None else found.unionByName(best.drop("rank"))
        best = checkpointed(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))
        seen, width = seen + width, width * GROWTH
    return best


def hard_negatives(vectors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 100) -> DataFrame:
    """For each anchor of vectors (vec_id, label, v: doubles that are whole numbers, anchor) and each of its first
    `positives` rows of the same label, the first `negatives` rows of other labels whose scores lie between low/scale
    and high/scale of the positive's.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("int"), "v", F.coalesce("anchor", F.lit(False)).alias("anchor"))
    n, dim = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n or not dim:
        return spark.createDataFrame([], RESULT)
    index = Index(rows, n, dim)
    anchors = index.rows.filter("anchor").select(F.col("row").alias("key"), F.lit(0).alias("p"), "row", "label", "v", F.lit(None).cast("long").alias("window"))
    pos = search(index, anchors, positives, True)
    pairs = anchors.drop("p", "window").join(pos.select("key", F.col("rank").alias("p"), F.col("score").alias("window"), F.col("found_id").alias("positive_id")), "key")
    pairs = checkpointed(pairs)
    neg = search(index, pairs.drop("positive_id"), negatives, False, low, high, scale)
    names = index.rows.filter("anchor").select(F.col("row").alias("key"), F.col("vec_id").alias("anchor_id"))
    known = lambda c: F.when(F.col(c) != LAST, F.col(c)).alias
    return neg.join(pairs.select("key", "p", "positive_id", "window"), ["key", "p"]).join(names, "key").select(
        "anchor_id", known("positive_id")("positive_id"), "rank", known("found_id")("negative_id"), F.col("window").alias("positive_score"), F.col("score").alias("negative_score")
    )


def usable(vector: str, label: str) -> Column:
    """Rows that take part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.col(label).isNotNull() & F.col(vector).isNotNull() & ~bad


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("e", lambda x: F.floor(x * 256).cast("double"))
    return hard_negatives(raw.filter(usable("e", "label")).select("vec_id", label.alias("label"), whole.alias("v"), (F.col("vec_id") % 100 == 0).alias("anchor")))


ORACLE_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, other_id AS positive_id, score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, other_id) AS INTEGER) AS rank,
       other_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY rank <= 10
"""
