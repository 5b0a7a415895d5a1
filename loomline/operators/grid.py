"""Candles, complete hourly grids, gaps and sample periods."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import ceil_day, hour_of, month_start

VALUES = ("open", "high", "low", "close", "volume", "trades")


def ohlc(ticks: DataFrame, ts: str = "ts", tie: str = "event_id", price: str = "price", symbol: str = "symbol") -> DataFrame:
    """Hourly candles of ticks; the first and last price are by time, then tie. One partial aggregate, one shuffle."""
    order = F.struct(ts, tie)
    return ticks.groupBy(symbol, hour_of(F.col(ts)).alias("open_time")).agg(
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
        F.sum(price).alias("volume"),
        F.count(F.lit(1)).alias("trades"),
    )


def first_of(frame: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    ranked = frame.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("__n = 1").drop("__n")


def regrid(candles: DataFrame, symbol: str = "symbol", time: str = "open_time", step_seconds: int = 3600) -> DataFrame:
    """Every step from a symbol's first to its last row, with nulls where a row is missing.

    The grid starts at the first time as it stands, so rows off the grid vanish; off_grid counts them. Each row fills
    the steps up to the next one, so candles are read once and joined with nothing.
    """
    whole, ordered = Window.partitionBy(symbol), Window.partitionBy(symbol).orderBy(time)
    off = (F.unix_micros(time) - F.unix_micros(F.min(time).over(whole))) % (step_seconds * 1_000_000)
    rows = candles.filter(F.col(time).isNotNull()).withColumn("__off", off).filter("__off = 0").drop("__off")
    step = F.make_dt_interval(secs=F.lit(step_seconds))
    last = F.greatest(F.col(time), F.lead(time, 1).over(ordered) - step)  # greatest skips the null behind the last row
    filled = rows.withColumn("__last", last).withColumn("__t", F.explode(F.sequence(F.col(time), F.col("__last"), step)))
    values = [F.when(F.col("__t") == F.col(time), F.col(c)).alias(c) for c in candles.columns if c not in (symbol, time)]
    return filled.select(symbol, F.col("__t").alias(time), *values)


def off_grid(candles: DataFrame, symbol: str = "symbol", time: str = "open_time") -> DataFrame:
    """Rows of each symbol whose time is not a full hour."""
    return candles.groupBy(symbol).agg(F.count_if(F.col(time) != hour_of(F.col(time))).alias("off_grid"))


def gaps(grid: DataFrame, missing: Column | None = None, symbol: str = "symbol", time: str = "open_time") -> DataFrame:
    """(symbol, start, end, hours) of each run of missing rows on a grid."""
    missing = F.col("close").isNull() if missing is None else missing
    order = Window.partitionBy(symbol).orderBy(time)
    marked = grid.select(symbol, time, missing.alias("missing"))
    marked = marked.withColumn("turn", F.when(F.col("missing") != F.lag("missing", 1).over(order), 1).otherwise(0))
    marked = marked.withColumn("island", F.sum("turn").over(order))
    found = marked.filter("missing").groupBy(symbol, "island").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count(F.lit(1)).alias("hours"))
    return found.drop("island")


def coverage(grid: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Hours, missing hours and their share, rounded to five digits."""
    return grid.groupBy(symbol).agg(
        F.count(F.lit(1)).alias("hours"),
        F.count_if(F.col("close").isNull()).alias("missing"),
        F.bround(F.avg(F.col("close").isNull().cast("double")), 5).alias("missing_share"),
    )


def daily_rate(daily: DataFrame, key: str, last_day: Column | datetime, window: int = 7) -> DataFrame:
    """(key, day, n, rate): n filled with zeros up to last_day; rate is its centred mean over window days.

    Near the ends the window is shorter, but at least half of it (or the whole calendar, if that is shorter).
    """
    last_day = F.lit(last_day) if isinstance(last_day, datetime) else last_day
    calendar = daily.groupBy(key).agg(F.min("day").alias("lo")).select(key, F.explode(F.sequence("lo", last_day, F.expr("INTERVAL 1 DAY"))).alias("day"))
    filled = calendar.join(daily, [key, "day"], "left").na.fill(0, ["n"])
    own = Window.partitionBy(key).orderBy("day")
    near = own.rowsBetween(-(window // 2), (window - 1) // 2)
    least = F.least(F.lit((window + 1) // 2), F.count(F.lit(1)).over(Window.partitionBy(key)))
    return filled.withColumn("rate", F.when(F.count("n").over(near) >= least, F.avg("n").over(near)))


def regular_end(rates: DataFrame, key: str, last_day: datetime, ratio: float = 0.5, reference_days: int = 365) -> DataFrame:
    """(key, usual_rate, regular_until): the day after the last one whose rate reaches ratio of the usual rate.

    The usual rate is the median of positive rates in the last reference_days.
    """
    recent = (F.col("day") > F.lit(last_day) - F.make_dt_interval(F.lit(reference_days))) & (F.col("rate") > 0)
    usual = rates.groupBy(key).agg(F.percentile(F.when(recent, F.col("rate")), F.lit(0.5)).alias("usual_rate"))
    found = rates.join(usual, key).groupBy(key).agg(
        F.first("usual_rate").alias("usual_rate"), F.max(F.when(F.col("rate") >= ratio * F.col("usual_rate"), F.col("day"))).alias("day")
    )
    return found.select(key, "usual_rate", (F.coalesce("day", F.lit(last_day)) + F.expr("INTERVAL 1 DAY")).alias("regular_until"))


def coverage_end(news: DataFrame, min_share: float = 0.05, recent_months: int = 12, window: int = 7, ratio: float = 0.5, reference_days: int = 365) -> DataFrame:
    """Major sources with the end of their regular collection; the earliest month start among them bounds the data."""
    from .clean import sources_span

    span = sources_span(news, recent_months)
    major = span.filter(F.col("recent_share") >= min_share)
    last_day = news.agg(F.date_trunc("day", F.max("published"))).first()[0]
    daily = news.join(major.select("source"), "source", "left_semi").groupBy("source", F.date_trunc("day", "published").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    ends = regular_end(daily_rate(daily, "source", last_day, window), "source", last_day, ratio, reference_days)
    return major.join(ends, "source").withColumn("complete_until", month_start(F.col("regular_until")))


@dataclass(frozen=True)
class Period:
    """A half-open sample period and the bounds it came from."""

    start: datetime
    end: datetime
    starts: dict[str, datetime]
    ends: dict[str, datetime]

    def holds(self, time: Column) -> Column:
        return (time >= F.lit(self.start)) & (time < F.lit(self.end))


def sample_period(candles: DataFrame, news: dict[str, DataFrame], ends: dict[str, datetime] | None = None, start: datetime | None = None, end: datetime | None = None) -> Period:
    """From the first midnight at which all series exist to the earliest end; start and end override both."""
    first, last = candles.groupBy("symbol").agg(F.min("open_time").alias("a"), F.max("open_time").alias("b")).agg(F.max("a"), F.min("b") + F.expr("INTERVAL 1 HOUR")).first()
    starts = {"candles": first} | {name: frame.agg(F.min("published")).first()[0] for name, frame in news.items()}
    finish = {"candles": last} | (ends or {})
    opened = candles.sparkSession.createDataFrame([(max(starts.values()),)], "t timestamp").select(ceil_day(F.col("t"))).first()[0]
    begin, stop = start or opened, end or min(finish.values())
    if begin >= stop:
        raise ValueError(f"the sample is empty: {begin} to {stop}")
    return Period(begin, stop, starts, finish)
