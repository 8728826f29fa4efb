"""Graph operators as relational plans: degrees, ranks, breadth-first levels, roles, orders and sampling."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopframe.functions.hashing import h
from hopframe.session import checkpointed, few


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_idx, in_deg, out_deg, total_deg, zero for isolated nodes; one aggregation over both edge ends."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("src_idx").alias("node_idx"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst_idx").alias("node_idx"), F.lit(0).alias("o"), F.lit(1).alias("i")))))
    d = ends.groupBy("node_idx").agg(F.sum("i").alias("in_deg"), F.sum("o").alias("out_deg"))
    n = nodes.select("node_idx").join(d, "node_idx", "left")
    n = n.select("node_idx", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("in_deg", "out_deg")))
    return n.withColumn("total_deg", F.col("in_deg") + F.col("out_deg"))


def sorted_codes(df: DataFrame, col: str, code: str = "code") -> DataFrame:
    """A row a distinct value with its rank from 0 in value order; only the distinct values meet in the window."""
    return df.select(col).distinct().withColumn(code, (F.row_number().over(Window.orderBy(col)) - 1).cast("int"))


def first_seen_codes(df: DataFrame, col: str, pos: str, code: str = "code") -> DataFrame:
    seen = df.groupBy(col).agg(F.min(pos).alias("first_pos"))
    return seen.withColumn(code, (F.row_number().over(Window.orderBy("first_pos")) - 1).cast("int"))


def light_features(nodes: DataFrame, edges: DataFrame, dim: int = 16) -> DataFrame:
    """node_idx and x: one-hot type, log1p of the degrees, two flags, padded to dim."""
    codes = sorted_codes(nodes, "node_type")
    n_types = codes.count()
    if dim < 8 or n_types > dim:
        raise ValueError("the dimension is too small for the types")
    d = nodes.select("node_idx", "node_type").join(F.broadcast(codes), "node_type").join(degrees(nodes, edges), "node_idx")
    hot = F.transform(F.sequence(F.lit(0), F.lit(n_types - 1)), lambda i: F.when(i == F.col("code"), 1.0).otherwise(0.0))
    rest = F.array(*(F.log1p(c) for c in ("in_deg", "out_deg", "total_deg")), *((F.col(c) > 0).cast("double") for c in ("in_deg", "out_deg")))
    x = F.slice(F.concat(hot, rest, F.array_repeat(F.lit(0.0), dim)), 1, dim)
    return d.select("node_idx", "code", x.alias("x"))


def top_by_degree(nodes: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """ord, node_idx: the first k by falling degree; all nodes in index order where there are at most k or no edges."""
    n = nodes.count()
    if n <= k or edges.limit(1).count() == 0:
        return nodes.orderBy("node_idx").limit(min(n, k)).select(F.col("node_idx").alias("ord"), "node_idx")
    top = degrees(nodes, edges).orderBy(F.desc("total_deg"), "node_idx").limit(k)
    return top.select((F.row_number().over(Window.orderBy(F.desc("total_deg"), "node_idx")) - 1).cast("long").alias("ord"), "node_idx")


def round_robin_anchors(nodes: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """ord, node_idx, node_type: by rank within type, types interleaved in code order."""
    d = degrees(nodes, edges).join(nodes.select("node_idx", "node_type"), "node_idx")
    w = Window.partitionBy("node_type").orderBy(F.desc("total_deg"), "node_idx")
    best = d.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k).orderBy("rn", "node_type").limit(k)
    return best.select((F.row_number().over(Window.orderBy("rn", "node_type")) - 1).cast("long").alias("ord"), "node_idx", "node_type")


def bfs(sources: DataFrame, und: DataFrame, depth: int) -> DataFrame:
    """src, node, d: least distances up to depth from every source at once.

    Each level joins the frontier with the edges and drops what was seen; frontiers are written to the checkpoint
    folder, or every later level would work them out anew.
    """
    front = checkpointed(sources.select(F.col("node_idx").alias("src"), F.col("node_idx").alias("node"), F.lit(0).alias("d")).distinct())
    pairs = checkpointed(und.distinct())
    seen = front
    for k in range(1, depth + 1):
        nxt = front.join(pairs, front["node"] == pairs["u"]).select("src", F.col("v").alias("node")).distinct()
        front = checkpointed(nxt.join(seen.select("src", "node"), ["src", "node"], "left_anti").withColumn("d", F.lit(k)))
        seen = seen.unionByName(front)
    return seen


def bfs_paths(sources: DataFrame, und: DataFrame, depth: int, max_visited: int | None = None) -> DataFrame:
    """src, node, path: one shortest path each, over the parent with the least index.

    A source whose nodes so far come to max_visited or more at a level gives none from that level on, and is not
    followed any further.
    """
    front = checkpointed(sources.select(F.col("node_idx").alias("src"), F.col("node_idx").alias("node"), F.array("node_idx").alias("path")).distinct())
    pairs = checkpointed(und.distinct())
    seen = front
    for _ in range(depth):
        nxt = front.join(pairs, front["node"] == pairs["u"]).select("src", F.col("v").alias("to"), F.col("node").alias("via"), "path")
        nxt = nxt.join(seen.select("src", F.col("node").alias("to")), ["src", "to"], "left_anti")
        front = checkpointed(nxt.groupBy("src", "to").agg(F.min_by("path", "via").alias("path")).select("src", F.col("to").alias("node"), F.concat("path", F.array("to")).alias("path")))
        if max_visited is not None:
            full = seen.select("src").unionByName(front.select("src")).groupBy("src").count().filter(F.col("count") >= max_visited)
            front = checkpointed(front.join(full, "src", "left_anti"))
        seen = seen.unionByName(front)
    return seen


def guarded_pairs(nodes: DataFrame, edges: DataFrame, limit: int, scope: str) -> DataFrame:
    """One row: scope, n, disabled, edge_pairs; a graph of more than `limit` nodes is not counted any further."""
    n = nodes.count()
    given = [F.lit(scope).alias("scope"), F.lit(n).cast("long").alias("n"), F.lit(n > limit).alias("disabled")]
    if n > limit:
        return nodes.sparkSession.range(1).select(*given, F.lit(None).cast("long").alias("edge_pairs"))
    return edges.agg(F.countDistinct("src_id", "dst_id").alias("edge_pairs")).select(*given, "edge_pairs")


def links_within(sub: DataFrame, und: DataFrame) -> DataFrame:
    """qid, u, v: the links of each question's subgraph (qid, node_idx)."""
    ends = lambda c: sub.select("qid", F.col("node_idx").alias(c))
    return und.select("u", "v").distinct().join(ends("u"), "u").join(ends("v"), ["qid", "v"], "left_semi").select("qid", "u", "v")


def levels_within(starts: DataFrame, links: DataFrame, depth: int | None = None) -> DataFrame:
    """qid, src, node, d: distances from each start (qid, src) within its question's links (qid, u, v), however far, or
    up to depth.

    A question drops out when its frontier is empty, and the loop ends when all have. What was seen is written as one
    table every few rounds, so neither plans nor unions grow with the distance.
    """
    front = checkpointed(starts.select("qid", "src", F.col("src").alias("node"), F.lit(0).alias("d")).distinct())
    links, seen, d = checkpointed(links), front, 0
    while depth is None or d < depth:
        d += 1
        near = front.join(links.withColumnRenamed("u", "node"), ["qid", "node"]).select("qid", "src", F.col("v").alias("node")).distinct()
        front = checkpointed(near.join(seen.select("qid", "src", "node"), ["qid", "src", "node"], "left_anti").withColumn("d", F.lit(d)))
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
        if d % 8 == 0:
            seen = checkpointed(seen)
    return seen


def proximity(levels: DataFrame, nodes: DataFrame, anchors: DataFrame, clip: int) -> DataFrame:
    """anchor, node_idx, proximity: clip + 1 at the anchor, falling by a hop, 0 where unreached."""
    grid = F.broadcast(anchors.select(F.col("node_idx").alias("src")))  # the anchors are few by definition
    got = levels.select("src", F.col("node").alias("node_idx"), (clip + 1 - F.least("d", F.lit(clip))).alias("p"))
    return nodes.select("node_idx").join(grid, how="cross").join(got, ["src", "node_idx"], "left").select(F.col("src").alias("anchor"), "node_idx", F.coalesce("p", F.lit(0)).cast("int").alias("proximity"))


def fanouts(layers: int, k_init: int, gamma: float, least: int = 1) -> list[int]:
    """The geometric fan-out of each hop."""
    return [max(least, int(k_init * gamma**k)) for k in range(layers)]


def sample_neighbourhood(seeds: DataFrame, edges: DataFrame | Callable[[DataFrame], DataFrame], fan: list[int], seed: int) -> tuple[DataFrame, DataFrame]:
    """Sampled nodes (qid, node_idx, hop) and edges (qid, src_idx, dst_idx, edge_id, hop).

    edges has edge_id; or it is a function that gives those into given nodes (node_idx), and others at will. For each
    newly reached node of a question the incoming edges with the least hash are taken; a node keeps its first hop. The
    hash does not depend on the question, so the edges into each reached node are ranked once, before any question meets
    them, and a hub brings each question no more than the fan-out.
    """
    front = checkpointed(seeds.select("qid", "node_idx").distinct())
    got = front.withColumn("hop", F.lit(0))
    taken = []
    w = Window.partitionBy("dst_idx").orderBy("_h", "edge_id")
    for k, n in enumerate(fan, 1):
        asked = few(front.select("node_idx").distinct())
        into = (edges(asked) if callable(edges) else edges).select("src_idx", "dst_idx", "edge_id").join(asked.withColumnRenamed("node_idx", "dst_idx"), "dst_idx", "left_semi")
        first = into.withColumn("_h", h("edge_id", seed)).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)
        near = front.join(first, front["node_idx"] == first["dst_idx"]).select("qid", "src_idx", "dst_idx", "edge_id").withColumn("hop", F.lit(k))
        near = checkpointed(near)
        taken.append(near)
        front = checkpointed(near.select("qid", F.col("src_idx").alias("node_idx")).distinct().join(got.select("qid", "node_idx"), ["qid", "node_idx"], "left_anti"))
        got = got.unionByName(front.withColumn("hop", F.lit(k)))
    return got, reduce(DataFrame.unionByName, taken)


def normalized(links: DataFrame, binary: bool) -> DataFrame:
    """u, v, w of every linked pair in both directions: its weight by the root of both ends' sums of weights.

    links: u, v and c, how often the pair is linked, in either direction. A pair's weight is the sum of its c, or 1 if
    binary. A pair travels once: to its larger end, where the pairs are summed up, and from there to the smaller one. A
    link with a null end counts for the other end only.
    """
    weight = F.lit(1.0) if binary else F.sum("c").cast("double")
    whole = links.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b"), "c").filter(F.col("u").isNotNull() & F.col("v").isNotNull())
    # the filter names what the joins below would ask for, or their shuffle of the pairs would not be the one of the sums
    pairs = whole.filter("a is not null and b is not null").repartition("a").groupBy("a", "b").agg(weight.alias("w"))
    half = links.filter(F.col("u").isNull() != F.col("v").isNull()).groupBy(F.coalesce("u", "v").alias("a")).agg(weight.alias("d"))
    ends = pairs.select(F.inline(F.array(F.struct("a", F.col("w").alias("d")), F.struct(F.when(F.col("b") < F.col("a"), F.col("b")).alias("a"), F.col("w").alias("d")))))
    sums = ends.unionByName(half).groupBy("a").agg(F.sum("d").alias("da"))
    x = pairs.join(sums, "a").join(sums.select(F.col("a").alias("b"), F.col("da").alias("db")), "b")
    x = x.select("a", "b", F.round(F.col("w") / F.sqrt(F.col("da") * F.col("db")), 6).alias("w"))
    way = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"), "w")
    return x.select(F.inline(F.when(F.col("a") == F.col("b"), F.array(way("a", "b"))).otherwise(F.array(way("a", "b"), way("b", "a")))))


def roles(pairs: DataFrame, und: DataFrame, sub: DataFrame, depth: int | None = None) -> DataFrame:
    """qid, node_idx, d_src, d_dst, d_sd, delta, role of the nodes of each question's subgraph.

    pairs: qid, src, dst. sub: qid, node_idx. Distances are those within the subgraph, up to depth if one is given;
    unreached ones are its size plus one.
    """
    starts = pairs.select("qid", F.explode(F.array("src", "dst")).alias("src")).join(sub.select("qid", F.col("node_idx").alias("src")), ["qid", "src"], "left_semi")
    d = levels_within(starts, links_within(sub, und), depth)
    n = sub.groupBy("qid").agg(F.count("*").alias("n"))
    x = sub.join(pairs, "qid").join(n, "qid")
    ds, dd, dsd = (d.select("qid", F.col("src").alias(a), F.col("node").alias(b), F.col("d").alias(c)) for a, b, c in (("src", "node_idx", "_ds"), ("dst", "node_idx", "_dd"), ("src", "dst", "_sd")))
    x = x.join(ds, ["qid", "src", "node_idx"], "left").join(dd, ["qid", "dst", "node_idx"], "left").join(dsd, ["qid", "src", "dst"], "left")
    far = F.col("n") + 1
    x = x.withColumns({"d_src": F.coalesce("_ds", far), "d_dst": F.coalesce("_dd", far)})
    cut = F.col("_sd").isNull()
    delta = F.when(cut | (F.col("d_src") > F.col("n")) | (F.col("d_dst") > F.col("n")), F.lit(-1)).otherwise(F.greatest(F.lit(0), F.col("d_src") + F.col("d_dst") - F.col("_sd")))
    x = x.withColumn("delta", delta.cast("int"))
    role = F.when(F.col("node_idx") == F.col("src"), 0).when(F.col("node_idx") == F.col("dst"), 1).when(~cut & (F.col("delta") == 0), 2).otherwise(3)
    return x.select("qid", "node_idx", F.col("d_src").cast("int"), F.col("d_dst").cast("int"), cut.alias("disconnected"), "delta", role.alias("role"))


def syntax_order(labelled: DataFrame, budget: int) -> DataFrame:
    """qid, pos, node_idx, role: endpoints first, then by corridor excess, detour, imbalance and base order."""
    total, gap = F.col("d_src") + F.col("d_dst"), F.abs(F.col("d_src") - F.col("d_dst"))
    key: list[Column] = [F.when(F.col("role") < 2, F.col("role")).otherwise(2), F.when(F.col("disconnected"), 0).otherwise(F.col("delta")), total, F.when(F.col("disconnected"), 0).otherwise(gap), F.col("node_idx")]
    w = Window.partitionBy("qid").orderBy(*key)
    return labelled.withColumn("pos", F.row_number().over(w) - 1).filter(F.col("pos") < budget).select("qid", F.col("pos").cast("int").alias("pos"), "node_idx", "role")


def bfs_token_order(seeds: DataFrame, links: DataFrame, sub: DataFrame, depth: int) -> DataFrame:
    """qid, node_idx, pos: seeds in their order, then level by level by (rank of the earliest parent, edge position),
    and what is not reached in index order.

    seeds: qid, node_idx, ord. links: u, v, edge_pos, both directions. sub: qid, node_idx, the nodes of a question.
    """
    w = Window.partitionBy("qid")
    front = checkpointed(seeds.select("qid", "node_idx", (F.row_number().over(w.orderBy("ord")) - 1).cast("long").alias("pos")))
    seen = front
    for _ in range(depth):
        near = front.join(links, front["node_idx"] == links["u"]).select("qid", F.col("v").alias("node_idx"), F.struct("pos", "edge_pos").alias("k"))
        near = near.join(sub, ["qid", "node_idx"], "left_semi").join(seen.select("qid", "node_idx"), ["qid", "node_idx"], "left_anti")
        near = near.groupBy("qid", "node_idx").agg(F.min("k").alias("k"))
        start = seen.groupBy("qid").agg(F.count("*").alias("n"))
        near = near.join(start, "qid").select("qid", "node_idx", (F.row_number().over(w.orderBy("k", "node_idx")) - 1 + F.col("n")).alias("pos"))
        front = checkpointed(near)
        seen = seen.unionByName(front)
    start = seen.groupBy("qid").agg(F.count("*").alias("n"))
    rest = sub.join(seen.select("qid", "node_idx"), ["qid", "node_idx"], "left_anti").join(start, "qid")
    return seen.unionByName(rest.select("qid", "node_idx", (F.row_number().over(w.orderBy("node_idx")) - 1 + F.col("n")).alias("pos")))
