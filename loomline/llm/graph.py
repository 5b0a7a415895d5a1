"""Connected components of an edge table by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _mark(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    )


def components(edges: DataFrame, most_steps: int = 60) -> DataFrame:
    """(node, label) for every node of edges(a, b): label is the smallest node that links reach.

    Each step hangs every node on the smallest neighbour (first its larger neighbours, then its smaller ones) with
    an aggregate and a join, so no neighbour list is ever gathered. The aggregate is checkpointed before the join, which
    then has shuffles of its own on both sides: a node with very many edges is an ordinary skewed join key that adaptive
    execution splits. The edges of each step are checkpointed too. Nulls and self links are ignored; an empty table
    gives an empty result.
    """
    now = cut(edges.select("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(now)
    for _ in range(most_steps):
        if not mark[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.filter("a <> b").distinct())
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = cut(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        then = _mark(after)
        if then == mark:
            break
        now, mark = after, then
    else:
        raise RuntimeError(f"components did not settle in {most_steps} steps")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        roots.select("node", F.col("node").alias("label"))
    )
