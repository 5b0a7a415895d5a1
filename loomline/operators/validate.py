"""Checks that stop a pipeline: each returns violations, and `require` raises on any."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def candle_violations(grid: DataFrame, most_missing: float = 0.01, symbol: str = "symbol", time: str = "open_time") -> DataFrame:
    """(symbol, check, violations): order, step, prices, bounds, and missing rows beyond the share allowed."""
    w = Window.partitionBy(symbol).orderBy(time)
    step = F.unix_timestamp(time) - F.lag(F.unix_timestamp(time), 1).over(w)
    rows = grid.withColumn("__step", step)
    inside = lambda c: (F.col(c) >= F.col("low")) & (F.col(c) <= F.col("high"))
    checks = {
        "repeated_time": F.count_if(F.col("__step") == 0),
        "irregular_step": F.count_if((F.col("__step") != 3600) & (F.col("__step") != 0)),
        "not_positive": F.count_if(F.least("open", "high", "low", "close") <= 0),
        "high_below_low": F.count_if(F.col("high") < F.col("low")),
        "open_outside": F.count_if(~inside("open")),
        "close_outside": F.count_if(~inside("close")),
        "too_many_missing": F.when(F.avg(F.col("close").isNull().cast("double")) > most_missing, F.count_if(F.col("close").isNull())).otherwise(0).cast("long"),
    }
    one = rows.groupBy(symbol).agg(*[c.alias(name) for name, c in checks.items()])
    pairs = ", ".join(f"'{name}', {name}" for name in checks)
    return one.selectExpr(symbol, f"stack({len(checks)}, {pairs}) as (check, violations)")


def require(violations: DataFrame, what: str) -> None:
    """Raises if any count in violations is above zero."""
    bad = violations.filter("violations > 0").limit(20).collect()
    if bad:
        raise ValueError(f"{what}: " + "; ".join(str(r.asDict()) for r in bad))


def extreme_targets(table: DataFrame, limit: float = 0.5, target: str = "target") -> DataFrame:
    """Rows whose simple return exceeds limit."""
    return table.filter(F.abs(F.expm1(target)) > limit)


def large_moves(returns: DataFrame, threshold: float, symbols: list[str], symbol: str = "symbol", time: str = "open_time", value: str = "ret") -> DataFrame:
    """Hours in which any symbol's simple return exceeds threshold, all symbols side by side."""
    wide = returns.groupBy(time).pivot(symbol, symbols).agg(F.first(F.bround(F.expm1(value), 4), ignorenulls=True))
    return wide.filter(F.greatest(*[F.abs(F.coalesce(F.col(s), F.lit(0.0))) for s in symbols], F.lit(0.0)) > threshold)


def news_misaligned(news: DataFrame) -> DataFrame:
    """Records outside the hour they were put into."""
    apart = F.unix_timestamp("published") - F.unix_timestamp("hour")
    return news.filter((apart < 0) | (apart >= 3600))


def truth_differs(predictions: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Hours for which models were given different truths."""
    return predictions.groupBy("symbol", "open_time").agg((F.max("y_true") - F.min("y_true")).alias("spread")).filter(F.col("spread") > tolerance)


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(check, violations): repeated keys on either side, and left rows without a partner."""
    repeated = lambda df, name: df.groupBy(key).count().filter("count > 1").agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("violations"))
    lone = left.join(right.select(key), key, "left_anti").agg(F.lit("unmatched").alias("check"), F.count(F.lit(1)).alias("violations"))
    return repeated(left, "repeated_left").unionByName(repeated(right, "repeated_right")).unionByName(lone)


def unknown_labels(labels: DataFrame, column: str, vocabulary: list[str]) -> DataFrame:
    known = labels.sparkSession.createDataFrame([(v,) for v in vocabulary], f"{column} string")
    return labels.join(F.broadcast(known), column, "left_anti")


def share_complete(collected: int, declared: int, least: float) -> bool:
    """collected reaches the share `least` of declared."""
    return declared > 0 and collected / declared >= least


def input_size(read: DataFrame, declared: DataFrame, zoned: str, within: float = 0.01, mixed: tuple[float, float] = (0.05, 0.95)) -> DataFrame:
    """(read, declared, size_ok, zone_share, mixed_zones) of read rows against declared(n): one row.

    Sizes may differ by the share `within`; times of which some have a zone and some have none are told apart.
    """
    one = read.agg(F.count(F.lit(1)).alias("read"), F.avg(F.col(zoned).cast("double")).alias("zone_share"))
    got = one.crossJoin(declared.agg(F.max("n").alias("declared")))
    ok = F.abs(F.col("read") - F.col("declared")) <= F.lit(within) * F.col("declared")
    return got.select("read", "declared", ok.alias("size_ok"), "zone_share", F.col("zone_share").between(*mixed).alias("mixed_zones"))


def cross_check(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """(keys, difference, agrees) of two computations of one value; a row that only one of them has does not agree."""
    both = a.select(*keys, F.col(value).alias("__a")).join(b.select(*keys, F.col(value).alias("__b")), keys, "full")
    gap = F.abs(F.col("__a") - F.col("__b"))
    return both.select(*keys, gap.alias("difference"), F.coalesce(gap <= tolerance, F.col("__a").isNull() & F.col("__b").isNull()).alias("agrees"))


def completeness(collected: DataFrame, declared: DataFrame, keys: list[str], least: float = 0.99) -> DataFrame:
    """(keys, collected, declared, complete): collected rows of each key against declared(keys, n)."""
    per = collected.groupBy(*keys).agg(F.count(F.lit(1)).alias("collected"))
    got = declared.withColumnRenamed("n", "declared").join(per, keys, "left").na.fill(0, ["collected"])
    return got.select(*keys, "collected", "declared", ((F.col("declared") > 0) & (F.col("collected") >= F.lit(least) * F.col("declared"))).alias("complete"))
