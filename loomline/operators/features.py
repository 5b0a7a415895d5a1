"""Features on a complete hourly grid. Every frame shares one window, so Spark sorts each symbol once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import hour_of

RULES = ("own_or_general", "own_only", "all")


def by_time(symbol: str = "symbol", time: str = "open_time"):
    return Window.partitionBy(symbol).orderBy(time)


def full(value: Column, frame, rows: int, result: Column) -> Column:
    """result where the frame holds `rows` values, else null: Spark shortens frames at the edges and skips nulls."""
    return F.when(F.count(value).over(frame) == rows, result)


def log_return(close: Column, w) -> Column:
    return F.ln(close) - F.lag(F.ln(close), 1).over(w)


def price_features(grid: DataFrame, lags: int = 6, vol_windows: tuple[int, ...] = (6, 24), symbol: str = "symbol", time: str = "open_time") -> DataFrame:
    """grid with ret_lag1.., rv_{n}, volume_change and target, the next hour's log return."""
    w = by_time(symbol, time)
    got = grid.withColumn("__ret", log_return(F.col("close"), w))
    ret = F.col("__ret")
    out = {f"ret_lag{k}": F.lag(ret, k - 1).over(w) if k > 1 else ret for k in range(1, lags + 1)}
    for n in vol_windows:
        frame = w.rowsBetween(-(n - 1), 0)
        out[f"rv_{n}"] = full(ret, frame, n, F.sqrt(F.sum(ret * ret).over(frame)))
    out["volume_change"] = F.log1p("volume") - F.lag(F.log1p("volume"), 1).over(w)
    out["target"] = F.ln(F.lead("close", 1).over(w) / F.col("close"))
    return got.withColumns(out).drop("__ret")


def for_asset(news: DataFrame, own: str, flags: list[str], rule: str = "own_or_general") -> DataFrame:
    """News of an asset: its own, those that name no asset at all, or all."""
    if rule not in RULES:
        raise ValueError(f"unknown rule: {rule}")
    if rule == "all":
        return news
    mine = F.col(own)
    return news.filter(mine if rule == "own_only" else mine | ~reduce(lambda a, b: a | b, map(F.col, flags)))


def hourly_news(news: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, hour, n, sent_mean, neg_share); a record at 10:59 belongs to the hour that opens at 10:00."""
    return news.groupBy(*(keys or []), hour_of(F.col("published")).alias("hour")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("score").alias("sent_mean"),
        F.avg(F.when(F.col("label") == "negative", 1.0).otherwise(0.0)).alias("neg_share"),
    )


def news_on_grid(grid: DataFrame, hourly: DataFrame, time: str = "open_time", keys: list[str] | None = None) -> DataFrame:
    """The grid's rows with n (0 in silent hours), sent_mean and neg_share (null there)."""
    on = [*(keys or []), time]
    return grid.join(hourly.withColumnRenamed("hour", time), on, "left").na.fill(0, ["n"])


def news_features(rows: DataFrame, prefix: str, window: int = 6, trend: int = 3, lag: int = 1, intensity: int = 168, symbol: str = "symbol", time: str = "open_time") -> DataFrame:
    """Sentiment and flow features of one language, from n, sent_mean and neg_share of each hour."""
    w = by_time(symbol, time)
    s, n = F.coalesce("sent_mean", F.lit(0.0)), F.col("n").cast("double")
    usual = F.coalesce(F.avg(n).over(w.rowsBetween(-intensity, -1)), F.lit(0.0))
    frame, late, early = w.rowsBetween(-(window - 1), 0), w.rowsBetween(-(trend - 1), 0), w.rowsBetween(-(2 * trend - 1), -trend)
    return rows.withColumns(
        {
            f"{prefix}_sent_mean": s,
            f"{prefix}_news_intensity": F.log1p(n) - F.log1p(usual),
            f"{prefix}_neg_share": F.coalesce("neg_share", F.lit(0.0)),
            f"{prefix}_sent_lag{lag}": F.lag(s, lag).over(w),
            f"{prefix}_sent_max{window}": full(s, frame, window, F.max(s).over(frame)),
            f"{prefix}_sent_min{window}": full(s, frame, window, F.min(s).over(frame)),
            f"{prefix}_sent_std{window}": full(s, frame, window, F.stddev_samp(s).over(frame)),
            f"{prefix}_sent_trend{trend}": full(s, early, trend, F.avg(s).over(late) - F.avg(s).over(early)),
            f"{prefix}_news_count": n,
        }
    ).drop("n", "sent_mean", "neg_share")


def warmup_hours(window: int = 6, trend: int = 3, lag: int = 1, intensity: int = 168) -> int:
    """Hours of history before the first row that all news features need."""
    return max(intensity + 1, window, 2 * trend, lag + 1)


def feature_columns(prefixes: list[str], lags: int = 6, vol_windows: tuple[int, ...] = (6, 24), window: int = 6, trend: int = 3, lag: int = 1) -> list[str]:
    """Model columns of a feature set: price features, then eight for each language."""
    price = [*(f"ret_lag{k}" for k in range(1, lags + 1)), *(f"rv_{n}" for n in vol_windows), "volume_change"]
    kinds = ["sent_mean", "news_intensity", "neg_share", f"sent_lag{lag}", f"sent_max{window}", f"sent_min{window}", f"sent_std{window}", f"sent_trend{trend}"]
    return price + [f"{p}_{k}" for p in prefixes for k in kinds]


def valid(columns: list[str]) -> Column:
    """No null among columns."""
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def shifted(table: DataFrame, columns: list[str], hours: int, need: list[str], symbol: str = "symbol", time: str = "open_time") -> DataFrame:
    """columns moved `hours` rows later (earlier if negative), and valid recomputed."""
    w = by_time(symbol, time)
    return table.withColumns({c: F.lag(c, hours).over(w) for c in columns}).withColumn("valid", valid(need))


def complete_windows(ok: Column, rows: int, w) -> Column:
    """The last `rows` rows exist and are all ok."""
    frame = w.rowsBetween(-(rows - 1), 0)
    return (F.count(ok).over(frame) == rows) & (F.min(ok.cast("int")).over(frame) == 1)


def expanding_mean(value: Column, w) -> Column:
    """Mean of all values so far; nulls are skipped, none gives zero."""
    return F.coalesce(F.avg(value).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))


def lag_block(table: DataFrame, columns: list[str], lags: int, symbol: str = "symbol", time: str = "open_time") -> DataFrame:
    """Columns c_0 .. c_{lags-1}: c now and at the rows before."""
    w = by_time(symbol, time)
    return table.withColumns({f"{c}_{k}": F.lag(c, k).over(w) if k else F.col(c) for c in columns for k in range(lags)})


def at_earlier_time(rows: DataFrame, values: DataFrame, column: str, hours: int, symbol: str = "symbol", time: str = "open_time") -> DataFrame:
    """column as it was `hours` earlier by the clock, not by rows; zero where there is none."""
    moved = values.select(symbol, (F.col(time) + F.make_dt_interval(F.lit(0), F.lit(hours))).alias(time), F.col(column).alias(f"{column}_at"))
    return rows.join(moved, [symbol, time], "left").na.fill(0.0, [f"{column}_at"])
