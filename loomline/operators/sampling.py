"""Proportional quotas and seeded stratified samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def allocate(strata: DataFrame, total: int, stratum: str = "stratum", size: str = "n") -> DataFrame:
    """strata(stratum, n) with quota: proportional shares, rounded down, the largest remainders rounded up, at most n."""
    everything = strata.agg(F.sum(size).alias("__all"))
    share = F.lit(total) * F.col(size) / F.col("__all")
    got = strata.crossJoin(F.broadcast(everything)).withColumn("__floor", F.floor(share)).withColumn("__rest", share - F.floor(share))
    left = got.agg((F.lit(total) - F.sum("__floor")).alias("__left"))
    order = F.row_number().over(Window.orderBy(F.desc("__rest"), stratum))  # a row a stratum
    got = got.withColumn("__rank", order).crossJoin(F.broadcast(left))
    quota = F.least(F.col(size), F.col("__floor") + (F.col("__rank") <= F.col("__left")).cast("int"))
    return got.withColumn("quota", quota.cast("long")).drop("__all", "__floor", "__rest", "__rank", "__left")


def stratified(rows: DataFrame, quotas: DataFrame, key: str, seed: int, stratum: str = "stratum", buckets: int = 1024) -> DataFrame:
    """quota rows of each stratum, the first in an order by a seeded hash of key: input order doesn't matter.

    The hash range is cut into buckets whose counts tell which of them a stratum's sample reaches into; only rows of
    those are ranked, so a stratum that holds most rows is not ranked as a whole.
    """
    place = F.floor((F.col("__h") / F.lit(2.0**64) + 0.5) * buckets).cast("int")
    own = rows.join(quotas.select(stratum, "quota"), stratum).withColumn("__h", F.xxhash64(F.lit(seed), key)).withColumn("__b", place)
    counts = own.groupBy(stratum, "__b").agg(F.count(F.lit(1)).alias("__n"), F.first("quota").alias("__q"))
    upto = F.sum("__n").over(Window.partitionBy(stratum).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    reached = counts.withColumn("__before", F.coalesce(upto, F.lit(0))).filter("__before < __q").select(stratum, "__b")
    ranked = own.join(reached, [stratum, "__b"], "left_semi")
    w = Window.partitionBy(stratum).orderBy("__h", key)
    return ranked.withColumn("__r", F.row_number().over(w)).filter("__r <= quota").drop("__h", "__b", "__r", "quota")


def numbered_sample(sample: DataFrame, prefix: str, key: str, seed: int, nested: int = 100) -> DataFrame:
    """sample, shuffled, with id (prefix-001) and nested, true for its first rows; for samples of bounded size."""
    w = Window.orderBy(F.xxhash64(F.lit(seed + 1), key), key)
    got = sample.withColumn("__r", F.row_number().over(w))
    return got.withColumn("id", F.concat(F.lit(f"{prefix}-"), F.lpad(F.col("__r").cast("string"), 3, "0"))).withColumn("nested", F.col("__r") <= nested).drop("__r")


def strata_table(corpus: DataFrame, sample: DataFrame, stratum: str = "stratum") -> DataFrame:
    """(stratum, corpus_n, corpus_share, sample_n, sample_share), zeros included."""
    a = corpus.groupBy(stratum).agg(F.count(F.lit(1)).alias("corpus_n"))
    b = sample.groupBy(stratum).agg(F.count(F.lit(1)).alias("sample_n"))
    got = a.join(b, stratum, "full_outer").na.fill(0, ["corpus_n", "sample_n"])
    sums = got.agg(F.sum("corpus_n").alias("__a"), F.sum("sample_n").alias("__b"))
    got = got.crossJoin(F.broadcast(sums))
    return got.select(stratum, "corpus_n", F.try_divide("corpus_n", "__a").alias("corpus_share"), "sample_n", F.try_divide("sample_n", "__b").alias("sample_share"))


def examples(rows: DataFrame, by: str, key: str, n: int, seed: int) -> DataFrame:
    """n random rows of each group: those first by a digest of seed and key.

    The first n of each 256th of a group are found first, so a large group is no large task.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    marked = rows.withColumn("__d", digest)
    first = F.row_number().over(Window.partitionBy(by).orderBy("__d"))
    part = F.row_number().over(Window.partitionBy(by, F.substring("__d", 1, 2)).orderBy("__d"))
    few = marked.withColumn("__r", part).filter(F.col("__r") <= n)  # n of each 256th of a group
    return few.withColumn("__r", first).filter(F.col("__r") <= n).drop("__d", "__r")
