"""The given tables in the roles of the engine: candles, headlines, scored headlines, label sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "2024-01-01 00:00:00"
#: Word patterns of the two tags, with word edges spelt out so that all regular-expression engines agree.
EDGE = r"(?:^|$|[^\p{L}\p{N}_])"
TAGS = {"tag_a": EDGE + r"(?:that|und|les)" + EDGE, "tag_b": EDGE + r"(?:from|des|que)" + EDGE}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_utc(ts: Column) -> Column:
    """A clock reading without zone, taken as UTC."""
    return ts.cast("timestamp")


def shown(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly candles of each event type; hours without an event have no row."""
    from ..operators.grid import ohlc

    ticks = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), as_utc(F.col("ts")).alias("ts"), "event_id", F.col("value").alias("price"))
    return ohlc(ticks.filter("price > 0"), "ts", "event_id")


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as headlines: published and source clock derive from doc_id, the address from source and doc_id."""
    raw = F.col("doc_id") * 433 % 2_592_000
    day = raw - raw % 86_400
    second = F.when(F.pmod("doc_id", F.lit(17)) == 0, day).when(F.col("source").isin("src5", "src9") & (F.pmod("doc_id", F.lit(2)) == 0), day + 18_000).otherwise(raw)
    score = (F.pmod("n_chars", F.lit(201)) - 100) / F.lit(100.0)
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("text").alias("title"),
        "lang",
        "source",
        F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH)) + second).alias("published"),
        F.concat(F.lit("https://www."), "source", F.lit(".example.com/"), (F.col("doc_id") % 700).cast("string")).alias("url"),
        score.alias("score"),
        F.when(score < -0.33, "negative").when(score > 0.33, "positive").otherwise("neutral").alias("label"),
    )


def tagged_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import tag

    return tag(headlines(spark, sf_dir), "title", TAGS)
