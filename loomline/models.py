"""The registry of forecast models: families, feature sets, seeds, and the keys under which results stand."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import features, forecast, sequence
from .operators.splits import Window

#: Languages of each feature set, beside prices.
FEATURE_SETS = {"P": (), "P_EN": ("en",), "P_RU": ("ru",), "P_EN_RU": ("en", "ru")}
NEWS_SETS = ("P_EN", "P_RU", "P_EN_RU")


@dataclass(frozen=True)
class Model:
    """fit(table, columns, windows, params, seeds) gives forecasts of all windows; quick holds the smoke run's settings."""

    name: str
    family: str
    sets: tuple[str, ...]
    seeds: tuple[int, ...]
    fit: Callable[[DataFrame, list[str], list[Window], dict, tuple[int, ...]], DataFrame]
    quick: dict


def _learned(adapter: Callable) -> Callable:
    return lambda table, columns, windows, params, seeds: forecast.run(table, columns, windows, adapter, params, seeds)


def _naive(kind: str) -> Callable:
    def fit(table: DataFrame, columns: list[str], windows: list[Window], params: dict, seeds: tuple[int, ...]) -> DataFrame:
        from .operators.splits import assign

        rows = assign(forecast.naive(table).filter(F.col("model") == kind), windows)
        return rows.withColumn("seed", F.lit(0)).select("symbol", "open_time", "y_true", "model", "y_pred", "fold", "seed")

    return fit


def _arma(table: DataFrame, columns: list[str], windows: list[Window], params: dict, seeds: tuple[int, ...]) -> DataFrame:
    news = [c for c in columns if c.endswith(("_sent_mean", "_news_intensity"))]
    got = forecast.arma(table, windows, exog=news or None, **params)
    return got.withColumn("seed", F.lit(0)).select("symbol", "open_time", "y_true", "model", "y_pred", "fold", "seed")


MODELS = (
    Model("zero", "baselines", ("P",), (0,), _naive("zero"), {}),
    Model("mean", "baselines", ("P",), (0,), _naive("mean"), {}),
    Model("arima", "arima", ("P",), (0,), _arma, {"orders": ((0, 0), (1, 0))}),
    Model("arimax", "arima", NEWS_SETS, (0,), _arma, {"orders": ((0, 0), (1, 0))}),
    Model("forest", "trees", tuple(FEATURE_SETS), (0, 1, 2, 3, 4), _learned(forecast.forest), {"trees": 10, "depth": 4}),
    Model("boosting", "trees", tuple(FEATURE_SETS), (0, 1, 2, 3, 4), _learned(forecast.boosting), {"rounds": 10}),
    Model("lstm", "lstm", tuple(FEATURE_SETS), (0, 1, 2), _learned(sequence.lstm), {"epochs": 2, "hidden": 4}),
)


def keys(models: tuple[Model, ...] = MODELS) -> list[str]:
    """model:set of every entry, 18 in all."""
    return [f"{m.name}:{s}" for m in models for s in m.sets]


def columns_of(feature_set: str, table_columns: list[str]) -> list[str]:
    """Columns of a feature set; a table with one news source only has them under the prefix all."""
    languages = FEATURE_SETS[feature_set]
    have = [x for x in languages if f"{x}_sent_mean" in table_columns] or (["all"] if languages else [])
    return features.feature_columns(have)


def run(table: DataFrame, windows: list[Window], path: str, wanted: list[str] | None = None, quick: bool = False, restart: bool = False) -> list[str]:
    """Forecasts of the wanted models (names, families or keys; all by default), a Parquet folder for each key.

    A key's folds and seeds are stored one by one, and a later run goes on where this one stops; restart moves what is
    there aside. A quick run takes the last window, one seed and small settings.
    """
    done = []
    for model in MODELS:
        for name in model.sets:
            key = f"{model.name}:{name}"
            if wanted and not {model.name, model.family, key} & set(wanted):
                continue
            columns = columns_of(name, table.columns)
            rows = table.withColumn("valid", features.valid([*columns, "target"]))

            def adapter(rows: DataFrame, columns: list[str], window: Window, params: dict, seed: int, model: Model = model) -> DataFrame:
                return model.fit(rows, columns, [window], params, (seed,)).drop("fold", "seed")

            params, seeds = (model.quick, model.seeds[:1]) if quick else ({}, model.seeds)
            forecast.run_stored(rows, columns, windows[-1:] if quick else windows, adapter, params, f"{path}/{key.replace(':', '-')}", seeds, restart)
            done.append(key)
    return done
