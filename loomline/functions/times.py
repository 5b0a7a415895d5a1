"""Time functions over columns; all clocks are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = r"(?:Z|[+-]\d{2}:?\d{2})$"
FORMATS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "dd.MM.yyyy HH:mm", "yyyy-MM-dd")


def hour_of(ts: Column) -> Column:
    return F.date_trunc("hour", ts)


def month_start(ts: Column) -> Column:
    return F.date_trunc("month", ts)


def ceil_day(ts: Column) -> Column:
    """The first midnight at or after ts."""
    day = F.date_trunc("day", ts)
    return F.when(ts == day, day).otherwise(day + F.expr("INTERVAL 1 DAY"))


def month_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def clock(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def has_zone(text: Column) -> Column:
    return F.trim(text).rlike(ZONE)


def parse_time(text: Column) -> Column:
    """A time in any of FORMATS; a written offset is applied, others are UTC; null if none fits."""
    clean = F.trim(text)
    return F.coalesce(*[F.try_to_timestamp(clean, F.lit(f)) for f in FORMATS])


def to_utc(ts: Column, offset_minutes: Column | int) -> Column:
    """A source's clock reading as UTC."""
    minutes = F.lit(offset_minutes) if isinstance(offset_minutes, int) else offset_minutes
    return ts - F.make_dt_interval(F.lit(0), F.lit(0), minutes)


def offset_label(minutes: Column) -> Column:
    """UTC+06:00"""
    sign = F.when(minutes < 0, "-").otherwise("+")
    whole = F.floor(F.abs(minutes) / 60).cast("int")
    return F.format_string("UTC%s%02d:%02d", sign, whole, (F.abs(minutes) - whole * 60).cast("int"))


def month_range(start: str, end: str) -> Column:
    """An array of the months from start to end, both included, as yyyy-MM."""
    months = F.sequence(F.trunc(F.to_date(F.lit(start)), "MM"), F.trunc(F.to_date(F.lit(end)), "MM"), F.expr("INTERVAL 1 MONTH"))
    return F.transform(months, lambda m: F.date_format(m, "yyyy-MM"))
