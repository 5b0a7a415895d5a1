"""Walk-forward forecasts: naive, tree ensembles, and ARMA models by group.

An adapter takes (table, columns, window, params, seed) and returns forecasts of the window's test rows, having seen
only valid rows before train_end. Tree models come from histograms that Spark adds up; ARMA runs one task for each symbol, window and order.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce
from itertools import product
from typing import Protocol

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as Frame
from pyspark.sql import functions as F

from ..sources import files
from . import arma as exact
from . import trees
from .features import expanding_mean
from .splits import Window


class Adapter(Protocol):
    name: str

    def __call__(self, table: DataFrame, columns: list[str], window: Window, params: dict, seed: int) -> DataFrame: ...


def train_rows(table: DataFrame, window: Window) -> DataFrame:
    return table.filter("valid").filter(F.col("open_time") < F.lit(window.train_end))


def test_rows(table: DataFrame, window: Window) -> DataFrame:
    return table.filter("valid").filter((F.col("open_time") >= F.lit(window.test_start)) & (F.col("open_time") < F.lit(window.test_end)))


def naive(table: DataFrame, ret: str = "ret_lag1", symbol: str = "symbol", time: str = "open_time") -> DataFrame:
    """The long table of four forecasts: zero, the mean so far, the last return, the mean of the last six."""
    w = Frame.partitionBy(symbol).orderBy(time)
    models = F.create_map(
        F.lit("zero"), F.lit(0.0),
        F.lit("mean"), expanding_mean(F.col(ret), w),
        F.lit("last"), F.col(ret),
        F.lit("mean6"), F.avg(ret).over(w.rowsBetween(-5, 0)),
    )
    rows = table.select(symbol, time, F.col("target").alias("y_true"), "valid", models.alias("m"))
    return rows.filter("valid").select(symbol, time, "y_true", F.explode("m").alias("model", "y_pred"))


def _by_symbol(many: Callable) -> Callable:
    """An adapter of one window and seed, with `many`, which fits all windows and seeds together."""

    def adapter(table: DataFrame, columns: list[str], window: Window, params: dict, seed: int) -> DataFrame:
        return many(table, columns, [window], params, (seed,)).drop("fold", "seed")

    adapter.many = many
    return adapter


#: Forests and boosting are fitted by symbol: no other symbol's rows change a forecast.
forest, boosting = _by_symbol(trees.forest), _by_symbol(trees.boosting)


def run(table: DataFrame, columns: list[str], windows: list[Window], adapter: Callable, params: dict, seeds: tuple[int, ...] = (0,), parallel: int = 8) -> DataFrame:
    """Forecasts of every fold and seed, with fold and seed columns; up to `parallel` fits share the cluster.

    An adapter that can fit many windows and seeds together does so.
    """
    if many := getattr(adapter, "many", None):
        return many(table, columns, windows, params, seeds)

    def one(window: Window, seed: int) -> DataFrame:
        return adapter(table, columns, window, params, seed).withColumn("fold", F.lit(window.name)).withColumn("seed", F.lit(seed))

    return reduce(DataFrame.unionByName, side_by_side(table.sparkSession, [partial(one, w, s) for w in windows for s in seeds], parallel))


def side_by_side(spark: SparkSession, jobs: list[Callable[[], DataFrame]], parallel: int) -> list[DataFrame]:
    """What the jobs return, in their order; up to `parallel` of them submit work to the cluster at once."""
    with ThreadPoolExecutor(parallel) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]]


def run_stored(table: DataFrame, columns: list[str], windows: list[Window], adapter: Callable, params: dict, path: str, seeds: tuple[int, ...] = (0,), restart: bool = False) -> DataFrame:
    """As run(), each fold and seed written as Parquet under path as soon as it is done.

    A run that was broken off goes on where it stopped: folds whose folder has its success mark are read, not fitted
    again. restart moves what is there aside and begins anew.
    """
    spark = table.sparkSession
    if restart:
        files.aside(spark, path)
    for window in windows:
        for seed in seeds:
            folder = f"{path}/fold={window.name}/seed={seed}"
            if not files.exists(spark, f"{folder}/_SUCCESS"):
                adapter(table, columns, window, params, seed).write.mode("overwrite").parquet(folder)
    wanted = F.col("fold").isin([w.name for w in windows]) & F.col("seed").isin(list(seeds))
    return spark.read.option("basePath", path).parquet(f"{path}/fold=*/seed=*").filter(wanted)


def tune(table: DataFrame, columns: list[str], window: Window, adapter: Callable, grid: dict[str, list], seed: int = 0) -> tuple[dict, list[dict]]:
    """The parameters with the least squared error on the tuning window (the first wins ties), and all results."""
    tried = []
    for i, values in enumerate(product(*grid.values())):
        params = dict(zip(grid, values))
        got = adapter(table, columns, window, params, seed)
        mse = got.agg(F.avg(F.pow(F.col("y_true") - F.col("y_pred"), 2))).first()[0]
        tried.append({"i": i, "mse": mse if mse is not None else math.inf, "params": params})
    return min(tried, key=lambda r: (r["mse"], r["i"]))["params"], tried


def arma(
    grid: DataFrame, windows: list[Window], orders: tuple[tuple[int, int], ...] = exact.ORDERS, history: int = 8760, exog: list[str] | None = None, value: str = "ret_lag1", taken: DataFrame | None = None,
) -> DataFrame:
    """One-step forecasts (symbol, fold, open_time, y_true, model, y_pred) of the next hour's return.

    For each symbol and window the order with the least AIC over the `history` hours before the window is taken, or that
    of `taken` where it is given, as `exact.chosen` and a stored run have it; with exog the errors of a regression have it.
    """
    taken = exact.chosen(exact.orders(grid, windows, orders, history, value)) if taken is None else taken
    return exact.forecasts(grid, windows, taken, history, exog, value)
