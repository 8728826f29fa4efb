"""Prize-based subgraph retrieval: node and edge prizes, and a growth solver for the prize-collecting tree."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def node_prizes(scores: DataFrame, key: str, score: str, k: int) -> DataFrame:
    """key, prize: k for the best down to 1; only the first k are ranked after a bounded top-k."""
    top = scores.orderBy(F.desc(score), key).limit(k)
    return top.select(key, (k + 1 - F.row_number().over(Window.orderBy(F.desc(score), key))).cast("double").alias("prize"))


def edge_prizes(scores: DataFrame, key: str, score: str, k: int) -> DataFrame:
    """key, prize over the k best distinct scores: rank values shared by ties, each under the one before by a hundredth."""
    levels = scores.groupBy(score).agg(F.count("*").alias("_c")).orderBy(F.desc(score)).limit(k)
    rows = levels.agg(F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("o"), "_c"))).alias("_l"))  # at most k

    def fold(s: Column, e: Column) -> Column:
        v = F.least((k - s["i"]) / e["_c"], s["prev"] * 0.99)
        return F.struct((s["i"] + 1).alias("i"), v.alias("prev"), F.array_append(s["out"], F.struct((-e["o"]).alias("v"), v.alias("p"))).alias("out"))

    zero = F.struct(F.lit(0).alias("i"), F.lit(float(k) / 0.99).alias("prev"), F.array().cast("array<struct<v:double,p:double>>").alias("out"))
    table = rows.select(F.explode(F.aggregate("_l", zero, fold, lambda s: s["out"])).alias("r")).select(F.col("r.v").alias(score), F.col("r.p").alias("prize"))
    return scores.join(F.broadcast(table), score, "left").select(key, F.coalesce("prize", F.lit(0.0)).alias("prize"))


def ranked_edge_prizes(edges: DataFrame, group: str, score: str, k: int) -> DataFrame:
    """edges with `prize`: edge_prizes() within each group. Distinct scores are ranked, not edges, and only k of them
    are gathered for a group."""
    levels = edges.groupBy(group, score).agg(F.count("*").alias("_c"))
    levels = levels.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score)))).filter(F.col("_r") <= k)
    rows = levels.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_r", F.col(score).alias("v"), "_c"))).alias("_l"))
    zero = F.struct(F.lit(None).cast("double").alias("prev"), F.array().cast("array<struct<v:double,p:double>>").alias("out"))

    def fold(s: Column, e: Column) -> Column:
        top = F.size("_l").cast("double")
        v = F.least((top - e["_r"] + 1) / e["_c"], F.coalesce(s["prev"] * 0.99, top))
        return F.struct(v.alias("prev"), F.array_append(s["out"], F.struct(e["v"].alias("v"), v.alias("p"))).alias("out"))

    table = rows.select(group, F.explode(F.aggregate("_l", zero, fold, lambda s: s["out"])).alias("r")).select(group, F.col("r.v").alias(score), F.col("r.p").alias("prize"))
    return edges.join(table, [group, score], "left").withColumn("prize", F.coalesce("prize", F.lit(0.0)))


def grow(n: int, edges: list[tuple[int, int, float]], prizes: list[float]) -> list[tuple]:
    """The growth phase of Goemans and Williamson without a root: merges in order, until one cluster is active.

    Every active cluster's moat grows at the same pace. Where the moats at an edge's ends use up its cost, the clusters
    merge; where a cluster's moats use up its prizes, it stops. A merge is (edge, cluster of u, cluster of v, whether
    each was active, new cluster). The last entry is the cluster that is active at the end, or the last one that was.
    """
    import numpy as np

    if not n:
        return [-1, {}]
    u, v, cost = (np.array([e[k] for e in edges], float if k == 2 else np.int64) for k in range(3))
    top, dual, parent = np.arange(n), np.zeros(n), {}  # each node's cluster, and the moats around it
    active, moat = np.zeros(2 * n, bool), np.zeros(2 * n)  # by cluster; merged ones are inactive
    prize = np.concatenate([np.array(prizes, float), np.zeros(n)])
    active[:n] = prize[:n] > 0
    members = {i: [i] for i in range(n)}
    merges, new = [], n
    last = max(range(n), key=lambda i: (prizes[i], -i))
    while active.sum() > 1:
        # what happens first: a cluster that is used up, before an edge at the same time; the least number among equals
        left = np.where(active, prize - moat, np.inf)
        spent = int(left.argmin())
        a, b = top[u], top[v]
        pace = active[a].astype(float) + active[b]
        with np.errstate(divide="ignore", invalid="ignore"):
            when = np.where((a != b) & (pace > 0), (cost - dual[u] - dual[v]) / pace, np.inf)
        edge = int(when.argmin()) if len(when) else -1
        stops = edge < 0 or not when[edge] < left[spent]
        step = max(0.0, float(left[spent] if stops else when[edge]))
        moat[active] += step
        dual += step * active[top]
        if stops:
            active[spent], last = False, spent
            continue
        a, b = int(a[edge]), int(b[edge])
        merges.append((edge, a, b, bool(active[a]), bool(active[b]), new))
        members[new], prize[new], moat[new] = members.pop(a) + members.pop(b), prize[a] + prize[b], moat[a] + moat[b]
        active[[a, b]], active[new], parent[a], parent[b] = False, True, new, new
        top[members[new]] = new
        new += 1
    last = int(active.argmax()) if active.any() else last
    while last in parent:
        last = parent[last]
    return [*merges, last, dict(members)]


def prize_tree(prizes: dict[int, float], edges: list[tuple[int, int, float]]) -> tuple[set[int], list[int]]:
    """nodes, indices of edges: the prize-collecting tree of Goemans and Williamson with their pruning, one cluster."""
    names = sorted(set(prizes) | {x for u, v, _ in edges for x in (u, v)})
    at = {x: i for i, x in enumerate(names)}
    if not names:
        return set(), []
    local = [(at[u], at[v], c) for u, v, c in edges]
    *merges, last, members = grow(len(names), local, [max(0.0, prizes.get(x, 0.0)) for x in names])
    good, parent = set(members[last]), {}
    for _, a, b, _, _, new in merges:
        parent[a] = parent[b] = new
    below: dict[int, list[int]] = {i: [i] for i in range(len(names))}
    for _, a, b, _, _, new in merges:
        below[new] = below[a] + below[b]
    needed: set[int] = set()

    def need(node: int) -> None:
        while node is not None and node not in needed:
            needed.add(node)
            node = parent.get(node)

    kept: list[int] = []
    for k, a, b, on_a, on_b, _ in reversed(merges):
        u, v, _ = local[k]
        if u not in good or v not in good:
            continue
        idle = a if not on_a else b if not on_b else None
        if idle is not None and idle not in needed:
            # a cluster that had stopped and leads to nothing that is kept
            good -= set(below[idle])
            continue
        kept.append(k)
        need(u)
        need(v)
    # what the pruning has cut off from the tree's edges goes too
    touched = {x for k in kept for x in local[k][:2]}
    good = good & touched if touched else {max(good, key=lambda i: (prizes.get(names[i], 0.0), -i))}
    return {names[i] for i in good}, sorted(kept)


def retrieve_subgraph(prizes: dict[int, float], edges: list[tuple[int, int, float]], cost: float) -> tuple[set[int], list[int]]:
    """nodes, indices of edges for edges (u, v, prize) of one cost.

    The cost is at most a little under the best edge prize. A prize up to the cost lowers it; a larger one becomes a
    node of its own between two free edges. The ends of every kept edge are kept.
    """
    best = max((p for *_, p in edges), default=0.0)
    cost = min(cost, best * 0.995) if best > 0 else cost
    first = max([*prizes, *(x for u, v, _ in edges for x in (u, v))], default=0) + 1
    plain, owner, prized = [], [], dict(prizes)
    for k, (u, v, p) in enumerate(edges):
        if p <= cost:
            plain.append((u, v, cost - p))
            owner.append(k)
        else:
            prized[first + k] = p - cost
            plain += [(u, first + k, 0.0), (first + k, v, 0.0)]
            owner += [None, None]
    nodes, kept = prize_tree(prized, plain)
    own = sorted({owner[k] for k in kept if owner[k] is not None} | {x - first for x in nodes if x >= first})
    return {x for x in nodes if x < first} | {x for k in own for x in edges[k][:2]}, own


def retrieve(graphs: DataFrame, cost: float) -> DataFrame:
    """qid, kind, u, v: the nodes (u) and edges of each question's subgraph.

    graphs: a row an edge, qid, u, v, prize_u, prize_v, prize. Each question's graph is small by construction: the
    neighbourhood that was sampled for it.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["u", "v", "prize"], ignore_index=True)
        prizes = dict(zip(pdf["u"].tolist(), pdf["prize_u"].tolist(), strict=True)) | dict(zip(pdf["v"].tolist(), pdf["prize_v"].tolist(), strict=True))
        edges = list(zip(pdf["u"].tolist(), pdf["v"].tolist(), pdf["prize"].tolist(), strict=True))
        nodes, kept = retrieve_subgraph(prizes, edges, cost)
        rows = [("node", x, None) for x in sorted(nodes)] + [("edge", *edges[k][:2]) for k in kept]
        return pd.DataFrame(rows, columns=["kind", "u", "v"]).astype({"u": "Int64", "v": "Int64"}).assign(qid=int(pdf["qid"].iloc[0]))[["qid", "kind", "u", "v"]]

    return graphs.groupBy("qid").applyInPandas(solve, "qid long, kind string, u long, v long")
