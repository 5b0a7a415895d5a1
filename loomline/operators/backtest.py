"""Backtests with costs on the long prediction table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RULES = ("long_flat", "long_short", "buy_and_hold")


def position(pred: Column, rule: str) -> Column:
    if rule == "long_flat":
        return F.when(pred > 0, 1.0).otherwise(0.0)
    if rule == "long_short":
        return F.signum(pred)
    if rule == "buy_and_hold":
        return F.lit(1.0)
    raise ValueError(f"unknown rule: {rule}")


def grid(predictions: DataFrame, rules: list[str], costs_bp: list[float]) -> DataFrame:
    """predictions for each rule and cost, with strategy, cost_bp and pos; both lists are short."""
    pos = F.create_map(*[x for r in rules for x in (F.lit(r), position(F.col("y_pred"), r))])
    rows = predictions.select("*", F.explode(pos).alias("strategy", "pos"))
    return rows.withColumn("cost_bp", F.explode(F.array(*[F.lit(float(c)) for c in costs_bp])))


def net_returns(rows: DataFrame, keys: list[str], time: str = "open_time") -> DataFrame:
    """rows with gross, turnover and net: simple returns of the position less costs of its changes, from flat."""
    w = Window.partitionBy(*keys).orderBy(time)
    turnover = F.abs(F.col("pos") - F.lag("pos", 1, 0.0).over(w))
    gross = F.col("pos") * F.expm1("y_true")
    return rows.withColumns({"turnover": turnover, "gross": gross}).withColumn("net", F.col("gross") - F.col("cost_bp") * 1e-4 * F.col("turnover"))


def equity(rows: DataFrame, keys: list[str], time: str = "open_time") -> DataFrame:
    """rows with value (of one unit at the start) and drawdown from the highest value so far, the start included."""
    upto = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    valued = rows.withColumn("value", F.product(1 + F.col("net")).over(upto))
    return valued.withColumn("drawdown", F.col("value") / F.greatest(F.lit(1.0), F.max("value").over(upto)) - 1)


def summary(rows: DataFrame, keys: list[str], hours_per_year: float = 8760.0, time: str = "open_time") -> DataFrame:
    """Returns, volatility, Sharpe, Sortino, drawdown, turnover, time in the market and break-even cost of each key."""
    valued = equity(rows, keys, time)
    net, n, root = F.col("net"), F.col("hours"), F.sqrt(F.lit(hours_per_year))
    got = valued.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("hours"), F.product(1 + net).alias("__value"), F.avg(net).alias("__mean"), F.stddev_samp(net).alias("__sd"),
        F.sqrt(F.avg(F.pow(F.least(net, F.lit(0.0)), 2))).alias("__down"), F.min("drawdown").alias("max_drawdown"), F.sum("turnover").alias("__turn"),
        F.avg((F.col("pos") != 0).cast("double")).alias("time_in_market"), F.avg("gross").alias("__gross"),
    )
    years, value = n / hours_per_year, F.col("__value")
    return got.select(
        *keys, "hours", (value - 1).alias("total_return"), F.when(value > 0, F.pow(value, 1 / years) - 1).otherwise(-1.0).alias("annual_return"), (F.col("__sd") * root).alias("annual_vol"),
        F.when(F.col("__sd") > 0, F.col("__mean") / F.col("__sd") * root).alias("sharpe"), F.when(F.col("__down") > 0, F.col("__mean") / F.col("__down") * root).alias("sortino"),
        "max_drawdown", (F.col("__turn") / years).alias("turnover_per_year"), "time_in_market",
        F.when(F.col("__turn") > 1, F.col("__gross") / (F.col("__turn") / n) * 1e4).alias("breakeven_bp"),
    )


def sharpe_by_cost(table: DataFrame, costs_bp: list[float], keys: list[str]) -> DataFrame:
    """One column bp_{cost} of Sharpe ratios for each cost."""
    named = table.withColumn("__c", F.concat(F.lit("bp_"), F.col("cost_bp").cast("int").cast("string")))
    return named.groupBy(*keys).pivot("__c", [f"bp_{int(c)}" for c in costs_bp]).agg(F.first("sharpe"))


def select_model(table: DataFrame, baselines: list[str], symbol: str = "symbol") -> DataFrame:
    """table(symbol, model, accurate, ci_low, sharpe) with passes and chosen: the best Sharpe ratio among those that pass."""
    got = table.withColumn("passes", F.col("accurate") & F.coalesce(F.col("ci_low") > 0, F.lit(False)) & ~F.col("model").isin(baselines))
    best = got.filter("passes").groupBy(symbol).agg(F.max_by("model", F.struct("sharpe", "model")).alias("__best"))
    return got.join(best, symbol, "left").withColumn("chosen", F.coalesce(F.col("model") == F.col("__best"), F.lit(False))).drop("__best")
