"""Walk-forward windows and their rows."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Window:
    """Rows before train_end teach; rows from test_start up to test_end, excluded, are forecast."""

    name: str
    train_end: datetime
    test_start: datetime
    test_end: datetime


def walk_forward(start: datetime, end: datetime, test: int, fold: int, tuning: int, embargo_hours: int, unit: str = "months") -> list[Window]:
    """The tuning window, then folds that cover the last `test` units before end.

    Training ends embargo_hours before each window. The test span must be a multiple of a fold, and history must exist.
    """
    if test % fold:
        raise ValueError(f"{test} {unit} can't be split into folds of {fold}")
    step = lambda n: pd.DateOffset(**{unit: n})
    end, gap = pd.Timestamp(end), timedelta(hours=embargo_hours)
    first = end - step(test)
    tuning_start = first - step(tuning)
    if tuning_start - gap <= pd.Timestamp(start):
        raise ValueError("no history is left before the tuning window")
    window = lambda name, a, b: Window(name, (a - gap).to_pydatetime(), a.to_pydatetime(), b.to_pydatetime())
    out = [window("tuning", tuning_start, first)]
    for k in range(test // fold):
        out.append(window(f"fold_{k + 1:02d}", end - step(test - k * fold), end - step(test - (k + 1) * fold)))
    return out


def as_table(spark: SparkSession, windows: list[Window]) -> DataFrame:
    return spark.createDataFrame([tuple(asdict(w).values()) for w in windows], "name string, train_end timestamp, test_start timestamp, test_end timestamp")


def to_json(windows: list[Window]) -> list[dict]:
    return [{k: v.isoformat() if isinstance(v, datetime) else v for k, v in asdict(w).items()} for w in windows]


def from_json(rows: list[dict]) -> list[Window]:
    return [Window(r["name"], *(datetime.fromisoformat(r[k]) for k in ("train_end", "test_start", "test_end"))) for r in rows]


def assign(rows: DataFrame, windows: list[Window], time: str = "open_time") -> DataFrame:
    """rows inside a window, with its name as fold; windows are a handful of driver-side literals."""
    spans = as_table(rows.sparkSession, windows).select(F.col("name").alias("fold"), "test_start", "test_end")
    return rows.join(F.broadcast(spans), (F.col(time) >= F.col("test_start")) & (F.col(time) < F.col("test_end"))).drop("test_start", "test_end")


def row_counts(table: DataFrame, windows: list[Window], time: str = "open_time", symbol: str = "symbol") -> DataFrame:
    """(symbol, fold, train_rows, test_rows) of valid rows."""
    spans = as_table(table.sparkSession, windows).withColumnRenamed("name", "fold")
    t = F.col(time)
    rows = table.filter("valid").join(F.broadcast(spans), t < F.col("test_end"))
    return rows.groupBy(symbol, "fold").agg(F.count_if(t < F.col("train_end")).alias("train_rows"), F.count_if(t >= F.col("test_start")).alias("test_rows"))


def check_windows(windows: list[Window], embargo_hours: int) -> None:
    """Raises if folds overlap or leave gaps, tuning reaches into them, or training ends too late."""
    tuning, folds = windows[0], windows[1:]
    if folds and tuning.test_end > folds[0].test_start:
        raise ValueError("tuning reaches into the test")
    for a, b in zip(folds, folds[1:]):
        if a.test_end != b.test_start:
            raise ValueError(f"{a.name} and {b.name} are not contiguous")
    for w in windows:
        if w.test_start - w.train_end < timedelta(hours=embargo_hours):
            raise ValueError(f"{w.name}: training ends too late")
