"""Forecast accuracy on the long prediction table (symbol, model, open_time, y_true, y_pred)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def truth() -> Column:
    return F.col("y_true")


def guess() -> Column:
    return F.col("y_pred")


def squared_error() -> Column:
    return (truth() - guess()) * (truth() - guess())


def common_rows(predictions: DataFrame) -> DataFrame:
    """Rows of hours for which every model of the symbol has a forecast."""
    models = predictions.groupBy("symbol").agg(F.countDistinct("model").alias("__all"))
    hours = predictions.groupBy("symbol", "open_time").agg(F.countDistinct("model").alias("__n"))
    whole = hours.join(models, "symbol").filter("__n = __all").select("symbol", "open_time")
    return predictions.join(whole, ["symbol", "open_time"], "left_semi")


def seed_average(predictions: DataFrame) -> DataFrame:
    """One forecast of each hour: the mean over seeds."""
    return predictions.groupBy("symbol", "model", "open_time").agg(F.first("y_true").alias("y_true"), F.avg("y_pred").alias("y_pred"))


def rmse() -> Column:
    return F.sqrt(F.avg(squared_error()))


def mae() -> Column:
    return F.avg(F.abs(truth() - guess()))


def directed() -> Column:
    """Both signs exist."""
    return (truth() != 0) & (guess() != 0)


def direction() -> Column:
    """Share of equal signs on directed rows; null without any."""
    return F.avg(F.when(directed(), (F.signum(truth()) == F.signum(guess())).cast("double")))


def accuracy(predictions: DataFrame, keys: list[str] | None = None, zero: str = "zero", mean: str = "mean") -> DataFrame:
    """rmse, mae, ratio to the zero forecast, R2 against the mean forecast, and direction, for each model.

    One aggregate gives every model's sums; the two benchmarks are looked up among a symbol's models.
    """
    keys = keys or ["symbol"]
    sums = predictions.groupBy(*keys, "model").agg(
        F.count(F.lit(1)).alias("n"), rmse().alias("rmse"), mae().alias("mae"), direction().alias("direction"), F.count_if(directed()).alias("direction_n"), F.sum(squared_error()).alias("__sse")
    )
    beside = Window.partitionBy(*keys)  # a row a model
    base = F.max(F.when(F.col("model") == zero, F.col("rmse"))).over(beside)
    bench = F.max(F.when(F.col("model") == mean, F.col("__sse"))).over(beside)
    return sums.withColumn("ratio_to_zero", F.try_divide("rmse", base)).withColumn("r2_oos", 1 - F.try_divide("__sse", bench)).drop("__sse")


def pair_change(predictions: DataFrame, pairs: list[tuple[str, str, str]]) -> DataFrame:
    """(symbol, question, base, model, n, change_pct): the change of the squared error from base to model."""
    mse = predictions.groupBy("symbol", "model").agg(F.avg(squared_error()).alias("mse"), F.count(F.lit(1)).alias("n"))
    known = mse.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("model", F.struct("mse", "n")))).alias("m"))  # a few models
    asked = F.array(*[F.struct(*[F.lit(x).alias(k) for k, x in zip(("question", "base", "model"), p)]) for p in pairs])
    rows = known.withColumn("q", F.explode(asked))
    got = rows.select("symbol", "q.*", F.try_element_at("m", F.col("q.model")).alias("own"), F.try_element_at("m", F.col("q.base")).alias("ref"))
    got = got.filter("own is not null and ref is not null")
    return got.select("symbol", "question", "base", "model", F.col("own.n").alias("n"), ((F.try_divide("own.mse", "ref.mse") - 1) * 100).alias("change_pct"))


def describe_returns(returns: DataFrame, value: str = "ret", order: str = "open_time", symbol: str = "symbol", hours_per_year: float = 8760.0) -> DataFrame:
    """Moments of a return series; skewness and excess kurtosis are adjusted for the sample, as is usual in tables."""
    rows = returns.filter(F.col(value).isNotNull())
    rows = rows.withColumn("__before", F.lag(value, 1).over(Window.partitionBy(symbol).orderBy(order)))
    v, n = F.col(value), F.col("n")
    got = rows.groupBy(symbol).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.skewness(v).alias("__g1"), F.kurtosis(v).alias("__g2"), F.avg((v > 0).cast("double")).alias("share_up"), F.avg((v == 0).cast("double")).alias("share_zero"), F.corr(v, F.col("__before")).alias("autocorr"),
    )
    skew = F.when(n > 2, F.col("__g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, ((n + 1) * F.col("__g2") + 6) * (n - 1) / ((n - 2) * (n - 3)))
    return got.withColumn("annual_vol", F.col("std") * F.sqrt(F.lit(hours_per_year))).withColumn("skew", skew).withColumn("kurt", kurt).drop("__g1", "__g2")
