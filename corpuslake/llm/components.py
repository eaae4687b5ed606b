"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.common import checkpointed

#: A chain of n nodes contracts in about log2(n) rounds; this many are never needed.
MOST_ROUNDS = 100


def _least(neighbours: DataFrame) -> DataFrame:
    return neighbours.groupBy("u").agg(F.min("v").alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the least node of its neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "least").alias("least"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and the neighbours below it are linked to the least of them. Edges point down here."""
    least = _least(edges)
    moved = edges.join(least, "u").filter("v > least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.union(least.select("u", F.col("least").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns u, v, of any ordered type) that is not itself the
    least node of its component; root is that least node.

    Null ends and loops are ignored; repeated edges don't matter; no edges give no rows. A round's stars
    are pre-aggregated before they are shuffled, so a hot node's neighbours never meet in one task
    but for a join that adaptive execution can split, and each round cuts its lineage with a checkpoint.
    """
    now = checkpointed(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(MOST_ROUNDS):
        now = checkpointed(_small_star(_large_star(now)))
        seen = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("components have not settled")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
