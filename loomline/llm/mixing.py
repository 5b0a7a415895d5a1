"""Mixing sources to target weights by capped water-filling.

The mix has `share` times all words. Each source's target is its weight times a common water level, clamped at
`most` times its own words; what clamped sources leave is shared by weight among the others until none is above its
clamp. Every document is then repeated target / size times: the whole part for all, the fractional part for those
first in a seeded hash order until their words make up the rest.

The level is found by a few aggregates over the sources; the fractional part is cut off in a bucket of the hash range
found from bucket sums, so only about BUCKET documents of a source are ever ordered together; there an exact subset sum
over the POOL documents around the edge brings the words nearest to the target.

Defined results: null and empty texts have no words, count for nothing and are taken by the whole part alone; a null
source is the last one; repeated rows of an id and size are decided together; with no words all targets are
zero; an empty table gives an empty result; other columns go through `mix` unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, dense_index, word_count

SHARE, MOST, BUCKET, SEED = 1.0, 3.0, 4000, "mix-1"
#: Documents of the edge bucket among which an exact subset sum picks, so that a source's words come as near as they can.
POOL = 96


def cycle_weights(position: Column) -> Column:
    """1, 2, 3 by turns."""
    return (F.pmod(position, F.lit(3)) + 1).cast("double")


def water_level(sources: DataFrame, total: float) -> float:
    """The level at which targets min(cap, level * weight) of sources(weight, cap) add up to total.

    The clamped sources only grow from step to step, so the steps end.
    """
    level = -1.0
    while True:
        clamped = F.col("cap") <= F.lit(level) * F.col("weight")
        fixed, weight = sources.agg(F.sum(F.when(clamped, F.col("cap")).otherwise(0.0)), F.sum(F.when(clamped, 0.0).otherwise(F.col("weight")))).first()
        if not weight:
            return max(level, 0.0)
        if (after := max(level, (total - fixed) / weight)) == level:
            return level
        level = after


def targets(sizes: DataFrame, share: float = SHARE, most: float = MOST, weigh: Callable[[Column], Column] = cycle_weights) -> DataFrame:
    """(source, docs, source_size, weight, target) of sizes(source, size)."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    ranked = dense_index(cut(sums), [F.col("source").asc_nulls_last()], "position")
    ranked = ranked.withColumn("weight", weigh(F.col("position"))).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = water_level(ranked, total * share)
    return ranked.select("source", "docs", "source_size", "weight", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def plan(sizes: DataFrame, share: float = SHARE, most: float = MOST, weigh: Callable[[Column], Column] = cycle_weights) -> DataFrame:
    """sizes(doc_id, source, size, ..) with source_size, target and times, the repeats of the row."""
    names = sizes.columns
    per = cut(targets(sizes, share, most, weigh))
    per = per.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    per = per.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    per = per.withColumn("buckets", F.ceil(F.col("docs") / F.lit(BUCKET)).cast("long")).withColumnRenamed("source", "__source")
    row = F.xxhash64(F.lit(SEED), "doc_id", "size")
    dealt = sizes.join(F.broadcast(per) if _small(per) else per, F.col("source").eqNullSafe(F.col("__source")))
    dealt = dealt.withColumn("hash", row).withColumn("bucket", F.pmod(F.xxhash64(F.col("hash")), F.col("buckets")))
    sums = dealt.groupBy("__source", "bucket").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    upto = F.sum("words").over(Window.partitionBy("__source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    edge = sums.withColumn("upto", upto).filter("upto > rest").groupBy("__source").agg(F.min(F.struct("bucket", (F.col("rest") - F.col("upto") + F.col("words")).alias("room"))).alias("e"))
    edge = cut(edge.select(F.col("__source").alias("__e_source"), F.col("e.bucket").alias("edge"), F.col("e.room").alias("room")))
    dealt = dealt.join(F.broadcast(edge) if _small(edge) else edge, F.col("__source").eqNullSafe(F.col("__e_source")), "left")
    at_edge = dealt.filter("bucket = edge").groupBy("__source", "doc_id", "size", "hash").agg(F.count(F.lit(1)).alias("n"), F.first("room").alias("room"))
    picked = at_edge.groupBy("__source").applyInPandas(_fill, "__p_source string, __p_id long, __p_size long")
    picked = cut(picked)
    dealt = dealt.join(
        picked,
        (F.col("bucket") == F.col("edge")) & F.col("__source").eqNullSafe(F.col("__p_source")) & F.col("doc_id").eqNullSafe(F.col("__p_id")) & (F.col("size") == F.col("__p_size")),
        "left",
    )
    extra = (F.coalesce(F.col("bucket") < F.col("edge"), F.lit(True)) & (F.col("rest") > 0)) | F.col("__p_size").isNotNull()
    return dealt.select(*names, "source_size", "target", (F.col("whole") + F.when(extra & (F.col("size") > 0), 1).otherwise(0)).alias("times"))


def _small(df: DataFrame, rows: int = 10_000) -> bool:
    """Few enough rows to broadcast; beyond that the join shuffles."""
    return df.limit(rows + 1).count() <= rows


def nearest_subset(sizes: list[int], goal: float) -> list[int]:
    """Places of a subset of sizes whose sum is as near to goal as any subset's, the smaller of two as near."""
    reached = [1]  # bit s: some of the first k sizes add up to s
    for size in sizes:
        reached.append(reached[-1] | reached[-1] << size)
    low = max(0, int(goal))
    below = (reached[-1] & ((1 << low + 1) - 1)).bit_length() - 1  # 0 is always reached
    above = reached[-1] >> low + 1
    over = low + 1 + (above & -above).bit_length() - 1
    left = over if above and abs(over - goal) < abs(goal - below) else below
    out = []
    for k in range(len(sizes) - 1, -1, -1):
        if not reached[k] >> left & 1:
            out.append(k)
            left -= sizes[k]
    return out[::-1]


def _fill(rows: pd.DataFrame) -> pd.DataFrame:
    """The edge bucket in hash order as far as it fits; around the end, that subset of POOL rows which brings the sum nearest."""
    rows = rows.sort_values(["hash", "doc_id", "size"])
    room, need = float(rows["room"].iloc[0]), (rows["size"] * rows["n"]).to_numpy()
    some = need > 0
    fit = int((need.cumsum() <= room).sum())
    pool = [k for k in range(max(0, fit - POOL // 2), len(need)) if some[k]][:POOL]
    if len(pool) < POOL:
        pool = ([k for k in range(len(need)) if some[k]])[-POOL:]
    first = pool[0] if pool else 0
    chosen = nearest_subset([int(need[k]) for k in pool], room - float(need[:first].sum()))
    got = rows.iloc[[*range(first), *(pool[k] for k in chosen)]]
    return pd.DataFrame({"__p_source": got["__source"], "__p_id": got["doc_id"], "__p_size": got["size"]})


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("source"), word_count(F.col("text")).alias("size"))


def mixture(docs: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row."""
    got = plan(cut(sized(docs)), share, most)
    return got.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mix(docs: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The rows of docs, each as often as the mix takes it. Texts are shuffled once, to meet the decisions."""
    got = plan(cut(sized(docs)), share, most).filter("times > 0")
    got = cut(got.select(F.col("doc_id").alias("__id"), F.col("size").alias("__size"), F.col("source").alias("__src"), F.col("times").alias("__times")).distinct())
    rows = docs.withColumn("__words", word_count(F.col("text")))
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__words") == F.col("__size")) & F.col("source").eqNullSafe(F.col("__src"))
    taken = rows.join(got, on)
    return taken.select(*docs.columns, F.explode(F.array_repeat(F.lit(1), F.col("__times"))).alias("__copy")).drop("__copy")
