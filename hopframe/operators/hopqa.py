"""Balanced hop-count questions: quotas by hop, hash-chosen endpoint pairs, names and templates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopframe.functions.hashing import h, h2
from hopframe.operators.graph import bfs_paths, degrees
from hopframe.operators.splits import ranked
from hopframe.session import checkpointed

# The three ways a question is put.
TEMPLATES = (
    "What is the minimum number of graph hops needed to connect {a} to {b}?",
    "What is the shortest hop count from {a} to {b} in the graph?",
    "How many graph hops at minimum separate {a} from {b}?",
)


def sources(nodes: DataFrame, edges: DataFrame, k: int, seed: int) -> DataFrame:
    """The k nodes with the least hash among those with an edge: a uniform sample without replacement."""
    d = degrees(nodes, edges).filter("total_deg > 0").select("node_idx", h("node_idx", seed).alias("hash"))
    return d.orderBy("hash", "node_idx").limit(k)


def records(nodes: DataFrame, edges: DataFrame, und: DataFrame, n: int, hops: int, n_sources: int, seed: int) -> DataFrame:
    """qid, src, dst, hop, path, src_id, dst_id, question, answer: n questions, as many for each hop as can be."""
    reached = bfs_paths(sources(nodes, edges, n_sources, seed), und, hops).withColumn("hop", F.size("path") - 1).filter("hop > 0")
    quota = F.lit(n // hops) + (F.col("hop") <= n % hops).cast("int")
    by = Window.partitionBy("hop").orderBy("_h", "src", "node")
    # no hop's quota is over the literal bound, by which each task prunes its rows before they meet
    got = reached.withColumn("_h", h2("src", "node", seed)).withColumn("rn", F.row_number().over(by)).filter(F.col("rn") <= -(-n // hops)).filter(F.col("rn") <= quota)
    qid = F.col("hop") * 100000 + F.col("rn")
    names = nodes.select("node_idx", "node_id")
    got = got.select(qid.cast("long").alias("qid"), "src", F.col("node").alias("dst"), "hop", "path")
    got = got.join(names.select(F.col("node_idx").alias("src"), F.col("node_id").alias("src_id")), "src").join(names.select(F.col("node_idx").alias("dst"), F.col("node_id").alias("dst_id")), "dst")
    text = F.element_at(F.array(*map(F.lit, TEMPLATES)), (h("qid", seed) % len(TEMPLATES) + 1).cast("int"))
    text = F.replace(F.replace(text, F.lit("{a}"), F.col("src_id")), F.lit("{b}"), F.col("dst_id"))
    return got.withColumns({"question": text, "answer": F.col("hop").cast("string")})


def balanced(nodes: DataFrame, edges: DataFrame, und: DataFrame, n: int, min_hop: int, max_hop: int, seed: int, batch: int = 64, max_attempts: int = 20_000, max_visited: int = 200_000) -> tuple[DataFrame, dict]:
    """n pairs (src, dst, hop, path), as many for each hop from min_hop to max_hop as can be, the first ones one more;
    and an account: attempts, pairs by hop.

    Sources are tried in the order of their hash, a batch a round; one whose surroundings come to max_visited gives no
    pair that far out. Rounds end when every hop has its number. An attempt is a source and a hop that was still short;
    where they run out, or the sources do, too few pairs are an error.
    """
    if n <= 0 or min_hop < 1 or max_hop < min_hop:
        raise ValueError("needs a number of pairs, and hops from 1 up")
    hops = range(min_hop, max_hop + 1)
    wanted = {hop: n // len(hops) + (k < n % len(hops)) for k, hop in enumerate(hops)}
    order = ranked(degrees(nodes, edges).filter("total_deg > 0").select(h("node_idx", seed).alias("_h"), "node_idx"), ["_h", "node_idx"], "_r")
    order = checkpointed(order)
    total, attempts, got, parts, at = order.count(), 0, dict.fromkeys(hops, 0), [], 0
    if not total:
        raise ValueError("no node has a neighbour")
    while (short := {hop: wanted[hop] - got[hop] for hop in hops if wanted[hop] > got[hop]}) and attempts < max_attempts and at < total:
        size = min(batch, -(-(max_attempts - attempts) // len(short)))
        tried = order.filter((F.col("_r") >= at) & (F.col("_r") < at + size))
        found = bfs_paths(tried, und, max(short), max_visited).withColumn("hop", F.size("path") - 1).filter(F.col("hop").isin(*short))
        need = F.element_at(F.create_map(*(F.lit(x) for kv in short.items() for x in kv)), F.col("hop"))
        by = Window.partitionBy("hop").orderBy(h2("src", "node", seed), "src", "node")
        found = found.withColumn("rn", F.row_number().over(by)).filter(F.col("rn") <= max(short.values())).filter(F.col("rn") <= need)
        found = checkpointed(found.select("src", F.col("node").alias("dst"), "hop", "path"))
        parts.append(found)
        for r in found.groupBy("hop").count().collect():  # a row a hop
            got[r["hop"]] += r["count"]
        attempts, at = attempts + len(short) * min(size, total - at), at + size
    if sum(got.values()) != n:
        raise RuntimeError(f"only {sum(got.values())} of {n} pairs after {attempts} attempts; allow more attempts or other hops")
    return reduce(DataFrame.unionByName, parts), {"attempts": attempts, "per_hop": got, "min_hop": min_hop, "max_hop": max_hop, "seed": seed}
