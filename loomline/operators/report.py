"""Report tables as DataFrames; figures are left to plotting tools, which get the same tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def data_flow(stages: DataFrame, per_asset: DataFrame, folds: DataFrame) -> DataFrame:
    """(part, item, n): cleaning stages, records of each asset, rows of each fold."""
    a = stages.select(F.lit("stage").alias("part"), F.col("name").alias("item"), F.col("left").alias("n"))
    b = per_asset.select(F.lit("asset").alias("part"), F.col("asset").alias("item"), "n")
    c = folds.select(F.lit("fold").alias("part"), F.concat_ws("/", "symbol", "fold").alias("item"), F.col("test_rows").alias("n"))
    return a.unionByName(b).unionByName(c)


def wide(table: DataFrame, rows: list[str], column: str, values: list[str], value: str) -> DataFrame:
    """One column for each of values."""
    return table.groupBy(*rows).pivot(column, values).agg(F.first(value))


def tuning_ratios(tried: DataFrame, zero_mse: Column) -> DataFrame:
    """(model, chosen_ratio, worst_ratio): squared errors of the chosen and the worst parameters over those of zero."""
    return tried.groupBy("model").agg((F.min("mse") / F.first(zero_mse)).alias("chosen_ratio"), (F.max("mse") / F.first(zero_mse)).alias("worst_ratio"))


def formatted(table: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Columns rounded half to even, as printed tables are."""
    return table.withColumns({c: F.bround(c, n) for c, n in digits.items()})


def seconds_by_model(runs: DataFrame) -> DataFrame:
    return runs.groupBy("model").agg(F.sum("seconds").alias("seconds"), F.count(F.lit(1)).alias("runs"), F.countDistinct("commit").alias("commits"))


def environment(runs: DataFrame) -> DataFrame:
    """(commit, runs, models, seconds) of runs(model, commit, seconds)."""
    return runs.groupBy("commit").agg(F.count(F.lit(1)).alias("runs"), F.countDistinct("model").alias("models"), F.sum("seconds").alias("seconds"))


def coverage_text(start: Column, end: Column) -> Column:
    """A span of days as 01.02.2024 to 03.04.2024."""
    return F.concat(F.date_format(start, "dd.MM.yyyy"), F.lit(" to "), F.date_format(end, "dd.MM.yyyy"))


def write_sheets(sheets: dict[str, tuple[str, DataFrame]], path: str) -> DataFrame:
    """Writes each sheet {name: (title, table)} as one CSV folder under path, and a sheet `contents`, which is returned."""
    from ..sources.files import write_report

    spark = next(iter(sheets.values()))[1].sparkSession
    contents = spark.createDataFrame([(i + 1, name, title) for i, (name, (title, _)) in enumerate(sheets.items())], "number int, sheet string, title string")
    for name, (_, table) in sheets.items():
        write_report(table, f"{path}/{name}")
    write_report(contents, f"{path}/contents")
    return contents
