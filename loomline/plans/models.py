"""Queries that have no SQL form: resampling, regressions, learned forecasts, placebo tests."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import backtest, features, forecast, metrics, regression, resampling, sequence, stats
from ..sources import roles
from .evaluation import FOLDS, KEYS, PT, WINDOWS, predictions, traded
from .registry import R, erf, query, rounded, sql, timed
from .series import model_table, priced

COLUMNS = ["ret_lag1", "ret_lag2", "ret_lag3", "rv_6", "volume_change", "all_sent_mean", "all_news_intensity"]
#: Seeds of the walk-forward queries; each forecasts every fold with the adapter's own settings.
TREE_SEEDS, LSTM_SEEDS = (0, 1, 2, 3, 4), (0, 1, 2)


@query()
def bootstrap_sharpe_ci(spark, sf_dir):
    """Each model's Sharpe ratio at 10 basis points less that of holding."""
    net = traded(spark, sf_dir).filter("strategy = 'long_flat' and cost_bp = 10").select("symbol", F.col("model").alias("name"), "open_time", "net")
    truth = predictions(spark, sf_dir).filter("model = 'zero'").withColumn("y_true", F.least("y_true", F.lit(0.05)))
    hold = backtest.net_returns(backtest.grid(truth, ["buy_and_hold"], [10]), KEYS).select("symbol", F.lit("hold").alias("name"), "open_time", "net")
    return resampling.sharpe_interval(net.unionByName(hold), "hold", reps=2000, seed=11)


@query()
def mcs(spark, sf_dir):
    return resampling.model_confidence_set(metrics.common_rows(predictions(spark, sf_dir)), reps=1000, seed=11)


@query()
def f1_bootstrap(spark, sf_dir):
    """Macro F1 of one label as a guess of the other, and of a constant guess, with percentile intervals."""
    labels = roles.table(spark, sf_dir, "labels").filter("quality is not null and toxic is not null")
    guesses = F.create_map(F.lit("other_label"), F.col("toxic"), F.lit("constant"), F.lit(1))
    rows = labels.select(F.col("doc_id").alias("item"), F.col("quality").alias("truth"), F.explode(guesses).alias("model", "predicted"))
    return resampling.f1_interval(rows, "truth", "predicted", "model", [0, 1], reps=1000, seed=3)


@query()
def hac_wald(spark, sf_dir):
    return regression.hac_wald(model_table(spark, sf_dir).filter("valid"), ["symbol"], "target", ["ret_lag1", "all_sent_mean", "all_news_intensity"], ["all_sent_mean", "all_news_intensity"])


@query()
def granger(spark, sf_dir):
    """Both directions, on all hours and on those of the folds."""
    return regression.granger(model_table(spark, sf_dir), ["symbol"], "ret_lag1", ["all_sent_mean", "all_news_intensity"], test_start=FOLDS[0].test_start)


@query()
def adf(spark, sf_dir):
    rows = priced(spark, sf_dir).select("symbol", "open_time", F.ln("close").alias("log_close"))
    return regression.adf(rows, ["symbol"], "log_close")


_held: dict[tuple, DataFrame] = {}


def learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of all symbols as one panel; a row is valid if the columns in use are.

    Fits read it many times, so that it is cached; only the panel of the last folder asked for is held.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _held:
        for old in _held.values():
            if old.sparkSession.sparkContext.applicationId == key[0]:
                old.unpersist()
        _held.clear()
        _held[key] = model_table(spark, sf_dir).withColumn("valid", features.valid([*COLUMNS, "target"])).select("symbol", "open_time", "valid", "target", *COLUMNS).cache()
    return _held[key]


@query()
def random_forest_wf(spark, sf_dir):
    table = learned(spark, sf_dir)
    return timed(forecast.run(table, COLUMNS, FOLDS, forecast.forest, {}, seeds=TREE_SEEDS), "open_time")


@query()
def boosting_wf(spark, sf_dir):
    table = learned(spark, sf_dir)
    return timed(forecast.run(table, COLUMNS, FOLDS, forecast.boosting, {}, seeds=TREE_SEEDS), "open_time")


@query()
def arima_wf(spark, sf_dir):
    table = model_table(spark, sf_dir).withColumn("valid", F.col("target").isNotNull())
    return timed(forecast.arma(table, FOLDS), "open_time")


@query()
def arimax_wf(spark, sf_dir):
    table = model_table(spark, sf_dir).withColumn("valid", F.col("target").isNotNull())
    return timed(forecast.arma(table, FOLDS, exog=["all_sent_mean", "all_news_intensity"]), "open_time")


@query()
def tuning_grid(spark, sf_dir):
    """Squared errors of a small grid on the tuning window; the chosen entry is marked."""
    best, tried = forecast.tune(learned(spark, sf_dir), COLUMNS, WINDOWS[0], forecast.forest, {"trees": [10], "depth": [2, 4], "leaf": [20]}, seed=1)
    return spark.createDataFrame([(r["i"], r["params"]["depth"], float(r["mse"]), r["params"] == best) for r in tried], "i int, depth int, mse double, chosen boolean")


#: The forest of the leakage tests: many fits, each a small one.
QUICK = {"trees": 20, "depth": 5, "leaf": 20}


@query()
def shift_test(spark, sf_dir):
    """Errors of a forest whose news features are 0, 1, 2, 3 and 24 hours old, against prices alone, on common rows."""
    table, news = learned(spark, sf_dir), ["all_sent_mean", "all_news_intensity"]
    price = [c for c in COLUMNS if c not in news]

    def one(hours: int | None) -> DataFrame:
        moved, columns = (table, price) if hours is None else (features.shifted(table, news, hours, [*COLUMNS, "target"]), COLUMNS)
        name = "price" if hours is None else f"shift_{hours}"
        return forecast.run(moved, columns, FOLDS, forecast.forest, QUICK, (1,), parallel=1).withColumn("model", F.lit(name))

    parts = forecast.side_by_side(spark, [partial(one, h) for h in (None, 0, 1, 2, 3, 24)], 6)
    names = [f"shift_{h}" for h in (0, 1, 2, 3, 24)]
    wide = reduce(DataFrame.unionByName, parts).groupBy("symbol", "open_time").pivot("model", ["price", *names]).agg(F.first("y_pred"))
    truth = table.select("symbol", "open_time", F.col("target").alias("y_true"))
    rows = wide.dropna().join(truth, ["symbol", "open_time"]).unpivot(["symbol", "open_time", "y_true"], ["price", *names], "model", "y_pred")
    got = rows.groupBy("symbol", "model").agg(F.count(F.lit(1)).alias("n"), metrics.rmse().alias("rmse"), metrics.direction().alias("direction"))
    base = F.max(F.when(F.col("model") == "price", F.col("rmse"))).over(Window.partitionBy("symbol"))
    return rounded(got.withColumn("change_pct", (F.pow(F.col("rmse") / base, 2) - 1) * 100), "rmse", "direction", "change_pct")


@query()
def placebo(spark, sf_dir):
    """Direction accuracy of a forest on 20 random orders of each symbol's targets, beside what chance gives."""
    table = learned(spark, sf_dir).filter("valid")

    def one(i: int) -> DataFrame:
        mixed = resampling.permuted(table, ["target"], ["symbol"], 1000 + i)
        return forecast.run(mixed, COLUMNS, FOLDS, forecast.forest, QUICK, (1,), parallel=1).withColumn("permutation", F.lit(i))

    parts = forecast.side_by_side(spark, [partial(one, i) for i in range(20)], 8)
    rows = reduce(DataFrame.unionByName, parts).filter("y_true <> 0 and y_pred <> 0")
    up, said = (F.avg((F.col(c) > 0).cast("double")) for c in ("y_true", "y_pred"))
    got = rows.groupBy("permutation").agg(F.count(F.lit(1)).alias("n"), metrics.direction().alias("direction"), up.alias("share_up"), said.alias("share_said_up"))
    chance = F.col("share_up") * F.col("share_said_up") + (1 - F.col("share_up")) * (1 - F.col("share_said_up"))
    return rounded(got.withColumn("chance", chance), "direction", "share_up", "share_said_up", "chance")


@query(sql(PT, f"SELECT symbol, model, n, {R('h', 'hit_rate')}, {R('pt', 'pt')}, {R(f'0.5 * (1 - {erf("pt / sqrt(2)")})', 'p_value')} FROM pt"))
def pesaran_timmermann_p(spark, sf_dir):
    got = stats.with_p_value(stats.pesaran_timmermann(predictions(spark, sf_dir)), "pt")
    return rounded(got, "hit_rate", "pt", "p_value")


@query()
def lstm_wf(spark, sf_dir):
    table = learned(spark, sf_dir)
    return timed(forecast.run(table, COLUMNS, FOLDS, sequence.lstm, {}, seeds=LSTM_SEEDS), "open_time")
