"""Seeds of questions by tiers: what is forced, what the question names, what is marked, what is persisted, and the
nodes of the highest degree to fill up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopframe.operators.graph import degrees


def listed(df: DataFrame, column: str) -> DataFrame:
    """A source from a list column: qid, node_idx, ord; null and empty lists give none."""
    return df.select("qid", F.posexplode(column).alias("ord", "node_idx")).select("qid", F.col("node_idx").cast("long").alias("node_idx"), F.col("ord").cast("long").alias("ord"))


def marked(questions: DataFrame, nodes: DataFrame, mask: str) -> DataFrame:
    """A source from a mask over the nodes, in node order, the same for all questions. Only the first nodes that any
    budget could take should be marked; a mask that marks none gives no source."""
    hit = nodes.filter(F.coalesce(F.col(mask), F.lit(False))).agg(F.array_sort(F.collect_list("node_idx")).alias("_m"))  # one row
    return listed(questions.select("qid").distinct().join(F.broadcast(hit), F.size("_m") > 0), "_m")


def select_seeds(questions: DataFrame, nodes: DataFrame, edges: DataFrame, budget: int, forced: DataFrame | None = None, primary: list[DataFrame] = [], secondary: list[DataFrame] = []) -> DataFrame:  # noqa: B006
    """qid, ord, node_idx: up to `budget` seeds of each question (qid), each once, in the order of the tiers: forced,
    the primary sources one after another, the secondary ones, then all nodes by falling degree. Ids that are no node
    are left out.
    """
    n_nodes = nodes.count()
    if n_nodes <= budget:  # every node, in order
        top = nodes.select("node_idx", F.col("node_idx").alias("ord"))
    else:
        best = degrees(nodes, edges).orderBy(F.desc("total_deg"), "node_idx").limit(budget)
        top = best.select("node_idx", (F.row_number().over(Window.orderBy(F.desc("total_deg"), "node_idx")) - 1).cast("long").alias("ord"))
    fill = F.broadcast(top.agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "node_idx"))), lambda r: r["node_idx"]).alias("_t")))  # at most `budget` ids
    sources = [x for x in (forced, *primary, *secondary) if x is not None] + [listed(questions.select("qid").distinct().join(fill, F.lit(True)), "_t")]
    all_ = None
    for tier, x in enumerate(sources):
        x = x.select("qid", "node_idx", F.struct(F.lit(tier).alias("tier"), F.col("ord").cast("long").alias("ord")).alias("k"))
        all_ = x if all_ is None else all_.unionByName(x)
    known = all_.join(nodes.select("node_idx"), "node_idx", "left_semi").groupBy("qid", "node_idx").agg(F.min("k").alias("k"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("k", "node_idx")) - 1
    return known.withColumn("ord", rank.cast("long")).filter(F.col("ord") < budget).select("qid", "ord", "node_idx")
