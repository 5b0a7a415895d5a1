"""Closed-form tests on forecast series. Lags count surviving rows, so every series has a dense total order."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .metrics import directed, guess, squared_error, truth


@F.pandas_udf(DoubleType())
def normal_sf(z: pd.Series) -> pd.Series:
    """P(Z > z) of a standard normal."""
    return z.map(lambda x: None if x is None or x != x else 0.5 * math.erfc(x / math.sqrt(2)))


def normal_ppf(p: float) -> float:
    return NormalDist().inv_cdf(p)


def lag_rule(n: Column) -> Column:
    """floor(4 (n / 100)^(2/9))"""
    return F.floor(4 * F.pow(n / F.lit(100.0), F.lit(2.0 / 9.0))).cast("int")


def most_lags(n: int) -> int:
    return int(math.floor(4 * (max(n, 1) / 100) ** (2 / 9)))


def long_run_variance(rows: DataFrame, keys: list[str], value: str, order: list[str], lags: int | None = None) -> DataFrame:
    """(keys, n, mean, lrv, lags): Bartlett-weighted variance of the demeaned series.

    One window pass makes the lagged products, one aggregate adds them up. Lags follow lag_rule unless given.
    """
    per = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    most = lags if lags is not None else most_lags(per.agg(F.max("n")).first()[0] or 1)
    w = Window.partitionBy(*keys).orderBy(*order)
    x = rows.filter(F.col(value).isNotNull()).join(per, keys).withColumn("__x", F.col(value) - F.col("mean"))
    products = {"__p0": F.col("__x") * F.col("__x")} | {f"__p{k}": F.col("__x") * F.lag("__x", k).over(w) for k in range(1, most + 1)}
    x = x.select(*keys, "n", "mean", *[c.alias(k) for k, c in products.items()])
    sums = x.groupBy(*keys).agg(F.first("n").alias("n"), F.first("mean").alias("mean"), *[F.sum(f"__p{k}").alias(f"__p{k}") for k in range(most + 1)])
    used = F.lit(lags) if lags is not None else lag_rule(F.col("n"))
    total = F.col("__p0") / F.col("n")
    for k in range(1, most + 1):
        weight = F.when(F.lit(k) <= used, 2 * (1 - F.lit(k) / (used + 1))).otherwise(0.0)
        total = total + weight * F.coalesce(f"__p{k}", F.lit(0.0)) / F.col("n")
    return sums.select(*keys, "n", "mean", total.alias("lrv"), used.alias("lags"))


def loss_differences(predictions: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(symbol, base, model, open_time, y_true, base_loss, model_loss, d): d = squared error of base less that of model.

    The few models of an hour come together in one shuffle; pairs are then read from that row.
    """
    losses = predictions.groupBy("symbol", "open_time").agg(
        F.first("y_true").alias("y_true"), F.map_from_entries(F.collect_list(F.struct("model", squared_error().alias("loss")))).alias("m")
    )
    asked = F.array(*[F.struct(F.lit(b).alias("base"), F.lit(m).alias("model")) for b, m in pairs])
    rows = losses.withColumn("p", F.explode(asked))
    got = rows.select("symbol", "p.base", "p.model", "open_time", "y_true", F.try_element_at("m", F.col("p.base")).alias("base_loss"), F.try_element_at("m", F.col("p.model")).alias("model_loss"))
    return got.filter("base_loss is not null and model_loss is not null").withColumn("d", F.col("base_loss") - F.col("model_loss"))


def diebold_mariano(differences: DataFrame, keys: list[str] | None = None, lags: int | None = None) -> DataFrame:
    """(keys, n, mean_d, hac_lags, dm): large values say that the model is more accurate; null without variance."""
    keys = keys or ["symbol", "base", "model"]
    got = long_run_variance(differences, keys, "d", ["open_time"], lags)
    stat = F.when(F.col("lrv") > 0, F.col("mean") / F.sqrt(F.col("lrv") / F.col("n")))
    return got.select(*keys, "n", F.col("mean").alias("mean_d"), F.col("lags").alias("hac_lags"), stat.alias("dm"))


def with_p_value(table: DataFrame, stat: str, out: str = "p_value") -> DataFrame:
    return table.withColumn(out, normal_sf(F.col(stat)))


def pesaran_timmermann(predictions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, n, hit_rate, pt): whether signs are foretold better than by chance; null if one sign only."""
    keys = keys or ["symbol", "model"]
    rows = predictions.filter(directed())
    share = lambda c: F.avg(c.cast("double"))
    got = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), share(truth() > 0).alias("a"), share(guess() > 0).alias("b"), share((truth() > 0) == (guess() > 0)).alias("hit_rate"))
    a, b, n = F.col("a"), F.col("b"), F.col("n")
    chance = a * b + (1 - a) * (1 - b)
    spread = chance * (1 - chance) / n
    expected = F.pow(2 * a - 1, 2) * b * (1 - b) / n + F.pow(2 * b - 1, 2) * a * (1 - a) / n + 4 * a * b * (1 - a) * (1 - b) / (n * n)
    stat = F.when(spread - expected > 0, (F.col("hit_rate") - chance) / F.sqrt(spread - expected))
    return got.select(*keys, "n", "hit_rate", stat.alias("pt"))


def holm(table: DataFrame, p: str, family: list[str], tie: list[str], out: str = "p_holm") -> DataFrame:
    """Step-down adjusted p-values of each family; nulls stay null and don't count."""
    there = F.col(p).isNotNull()
    w = Window.partitionBy(*family, there).orderBy(p, *tie)
    m = F.count(F.lit(1)).over(Window.partitionBy(*family, there))
    step = (m - F.row_number().over(w) + 1) * F.col(p)
    got = table.withColumn("__step", step)
    upto = F.max("__step").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return got.withColumn(out, F.when(there, F.least(F.lit(1.0), upto))).drop("__step")


def effect_bounds(differences: DataFrame, keys: list[str] | None = None, level: float = 0.95, power: float = 0.8) -> DataFrame:
    """(keys, n, change_pct, se_pct, ci_low, ci_high, mde_pct, dm): the change of the squared error in per cent of the base's."""
    keys = keys or ["symbol", "base", "model"]
    base = differences.groupBy(*keys).agg(F.avg("base_loss").alias("base_mse"))
    got = long_run_variance(differences, keys, "d", ["open_time"]).join(base, keys)
    z, both = normal_ppf(0.5 + level / 2), normal_ppf(level) + normal_ppf(power)
    se = F.when(F.col("lrv") > 0, F.sqrt(F.col("lrv") / F.col("n")) / F.col("base_mse") * 100)
    change = -F.col("mean") / F.col("base_mse") * 100
    return got.select(
        *keys, "n", change.alias("change_pct"), se.alias("se_pct"), (change - z * se).alias("ci_low"), (change + z * se).alias("ci_high"), (both * se).alias("mde_pct"),
        F.when(F.col("lrv") > 0, F.col("mean") / F.sqrt(F.col("lrv") / F.col("n"))).alias("dm"),
    )


def subset_masks(rows: DataFrame, count: str, intensity: str, quantile: float = 0.9, symbol: str = "symbol") -> DataFrame:
    """rows with has_news, in_burst (intensity at or above its quantile) and either."""
    edge = rows.groupBy(symbol).agg(F.percentile(intensity, F.lit(quantile)).alias("__edge"))
    got = rows.join(edge, symbol)
    return got.withColumns({"has_news": F.col(count) > 0, "in_burst": F.col(intensity) >= F.col("__edge")}).withColumn("either", F.col("has_news") | F.col("in_burst")).drop("__edge")


def relevant_language(base: Column, alternative: Column) -> Column:
    """The language whose news a pair of keys model:set compares: en, ru, or both."""
    of, to = F.split_part(base, F.lit(":"), F.lit(2)), F.split_part(alternative, F.lit(":"), F.lit(2))
    return F.when((to == "P_EN_RU") & (of == "P_EN"), "ru").when(to == "P_EN_RU", "both").when(to == "P_EN", "en").otherwise("ru")


def validity(rows: DataFrame, score: str, value: str, keys: list[str]) -> DataFrame:
    """Correlation and slope of value on score."""
    both = rows.filter(F.col(score).isNotNull() & F.col(value).isNotNull())
    return both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr(score, value).alias("corr"), F.regr_slope(F.col(value), F.col(score)).alias("slope"))


def sign_test(table: DataFrame, change: str, keys: list[str]) -> DataFrame:
    """(keys, improved, total, p_value): the chance of at least so many negative changes, were both signs as likely."""
    got = table.groupBy(*keys).agg(F.count_if(F.col(change) < 0).alias("improved"), F.count(change).alias("total"))
    terms = F.transform(F.sequence(F.col("improved"), F.col("total")), lambda k: F.exp(_log_choose(F.col("total"), k) - F.col("total") * math.log(2)))
    return got.withColumn("p_value", F.least(F.lit(1.0), F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)))


def _log_choose(n: Column, k: Column) -> Column:
    """ln of n choose k, as a sum of logarithms."""
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, F.lit(0.0), lambda a, i: a + F.ln((n - k + i) / i))
