"""Weighted rendezvous sharding of stable record keys.

A record goes to the shard with the largest score -weight / ln(u), u being a uniform hash of the record's key and the
shard's number. A shard's score doesn't depend on the other shards, so a shard that is added only takes records into
itself, and one that is removed only gives its own away.

Defined results: the key decides alone, so repeated rows and rows with null keys (one key) share a shard; null texts
have 8 bytes and the check sum of nothing; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PER_BUCKET, cut, numbered

SHARDS = 24


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard 0.. of key; larger weights draw proportionally more keys."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")

    def scored(shard: int, weight: float) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(F.lit("shard"), key, F.lit(shard)), 11)
        u = (bits.cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
        return F.struct((F.lit(-float(weight)) / F.ln(u)).alias("score"), F.lit(shard).alias("shard"))

    return F.array_max(F.array(*[scored(s, w) for s, w in enumerate(weights)]))["shard"]


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: Sequence[float] = (1.0,) * SHARDS, grown: float = 1.0) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard); grown: the weight of one more shard."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    key = F.col("doc_id")
    rows = rows.withColumn("shard", rendezvous(key, weights)).withColumn("grown_shard", rendezvous(key, [*weights, grown]))
    rows = cut(rows)  # small: the texts are read once, the shards chosen once
    counts = {r["shard"]: r["n"] for r in rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # one a shard
    buckets = F.lit([-(-counts.get(s, 1) // PER_BUCKET) for s in range(len(weights))])
    order = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    return numbered(rows, ["shard"], F.xxhash64(*order), order, F.get(buckets, F.col("shard")), "slot")


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", weights: Sequence[float] = (1.0,) * SHARDS, files: int = 8) -> None:
    """docs as Parquet under path, one folder (shard=N) for each shard, up to `files` files each.

    The shard of a row is that of its key, so nothing is joined. A column of docs that is called shard would clash with
    the folders' and is written as __shard.
    """
    key = F.col(id_col).cast("long")
    own = docs.withColumnRenamed("shard", "__shard").withColumn("shard", rendezvous(key, weights))
    spread = F.xxhash64(*[f.name for f in docs.schema if "map<" not in f.dataType.simpleString() and f.name != "shard"])
    own.repartition("shard", F.pmod(spread, F.lit(files))).write.partitionBy("shard").parquet(path)
