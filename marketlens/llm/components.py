"""Connected components of an edge table, by large stars and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm import shared


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) of all nodes of edges (a long, b long); a component's name is its smallest node.

    Each round joins every neighbour that is larger than a node to the node's
    smallest neighbour, and then the rest likewise, until no edge changes. Smallest
    neighbours come from a partial aggregation, so a node with many edges is
    split. Loops, repeated edges and both directions are allowed. An error says that the rounds ran out.
    """
    now = shared.staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        after = shared.staged(small, "edges")
        if after.exceptAll(now).isEmpty() and now.exceptAll(after).isEmpty():
            break
        now = after
    else:
        raise RuntimeError(f"edges still change after {rounds} rounds: components would be too many")
    stars = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()).groupBy("node").agg(F.min("component").alias("component"))
