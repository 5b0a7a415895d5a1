"""Queries over forecasts: accuracy, tests, backtests, label quality, samples."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import annotate, backtest, forecast, metrics, sampling, splits, stats, validate
from ..sources import roles
from .registry import PREDICTIONS, R, T, erf, query, rounded, sql, timed
from .series import TABLE, model_table, priced

START, END = datetime(2024, 1, 1), datetime(2024, 1, 31)
WINDOWS = splits.walk_forward(START, END, test=12, fold=3, tuning=4, embargo_hours=24, unit="days")
FOLDS = WINDOWS[1:]
SPANS = "spans AS (SELECT * FROM (VALUES " + ", ".join(f"('{w.name}', TIMESTAMP '{w.train_end}', TIMESTAMP '{w.test_start}', TIMESTAMP '{w.test_end}')" for w in WINDOWS) + ") s(fold, train_end, test_start, test_end))"
PAIRS = [("zero", "mean"), ("zero", "last"), ("mean", "mean6")]
QUESTIONS = [("Q1", "zero", "mean"), ("Q1", "zero", "mean6"), ("Q2", "last", "mean6")]


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = priced(spark, sf_dir)
    return forecast.naive(table.withColumn("valid", F.col("target").isNotNull() & F.col("rv_6").isNotNull() & F.col("volume_change").isNotNull()))


@query(sql(PREDICTIONS, f"SELECT symbol, {T('open_time', 'open_time')}, model, {R('y_true', 'y_true')}, {R('y_pred', 'y_pred')} FROM pred"))
def naive_forecasts(spark, sf_dir):
    return timed(rounded(predictions(spark, sf_dir), "y_true", "y_pred"), "open_time")


@query(
    sql(
        "e AS (SELECT date_trunc('month', max(o_orderdate)) AS e FROM orders), k AS (SELECT unnest(generate_series(0, 3)) AS k), f AS (SELECT 'fold_0' || CAST(k + 1 AS VARCHAR) AS fold, e - INTERVAL 1 MONTH * (24 - 6 * k) AS a, e - INTERVAL 1 MONTH * (18 - 6 * k) AS b FROM e, k UNION ALL SELECT 'tuning', e - INTERVAL 36 MONTH, e - INTERVAL 24 MONTH FROM e)",
        f"SELECT fold, {T('a - INTERVAL 24 HOUR', 'train_end')}, {T('a', 'test_start')}, {T('b', 'test_end')} FROM f",
    )
)
def walk_forward_folds(spark, sf_dir):
    """Folds over the order dates: the last 24 months in four folds, a year of tuning before them."""
    first, last = roles.table(spark, sf_dir, "orders").agg(F.min("o_orderdate"), F.date_trunc("month", F.max("o_orderdate"))).first()
    windows = splits.walk_forward(first, last, test=24, fold=6, tuning=12, embargo_hours=24)
    splits.check_windows(windows, 24)
    return timed(splits.as_table(spark, windows).withColumnRenamed("name", "fold"), "train_end", "test_start", "test_end")


@query(sql(TABLE + ", " + SPANS, "SELECT symbol, fold, count(*) FILTER (WHERE open_time < train_end) AS train_rows, count(*) FILTER (WHERE open_time >= test_start) AS test_rows FROM full_table JOIN spans ON open_time < test_end WHERE valid GROUP BY symbol, fold"))
def fold_row_counts(spark, sf_dir):
    return splits.row_counts(model_table(spark, sf_dir), WINDOWS)


@query(
    sql(
        PREDICTIONS + """, part AS (SELECT * FROM pred WHERE NOT (model = 'last' AND y_pred > 2)), per AS (SELECT symbol, count(DISTINCT model) AS models FROM part GROUP BY symbol),
        h AS (SELECT symbol, open_time, count(DISTINCT model) AS n FROM part GROUP BY 1, 2)""",
        "SELECT h.symbol, count(*) * max(p.models) AS n_rows, count(*) AS hours FROM h JOIN per p ON p.symbol = h.symbol WHERE h.n = p.models GROUP BY h.symbol",
    )
)
def common_rows(spark, sf_dir):
    some = predictions(spark, sf_dir).filter("not (model = 'last' and y_pred > 2)")  # one model lacks some hours
    return metrics.common_rows(some).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("open_time").alias("hours"))


ACC = """, acc AS (SELECT {keys}, model, count(*) AS n, sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS rmse, avg(abs(y_true - y_pred)) AS mae, avg(CASE WHEN y_true <> 0 AND y_pred <> 0 THEN CASE WHEN sign(y_true) = sign(y_pred) THEN 1.0 ELSE 0.0 END END) AS direction,
count(*) FILTER (WHERE y_true <> 0 AND y_pred <> 0) AS direction_n, sum((y_true - y_pred) * (y_true - y_pred)) AS sse FROM {source} GROUP BY {keys}, model)"""
ACC_OUT = f"a.n, {R('a.rmse', 'rmse')}, {R('a.mae', 'mae')}, {R('a.direction', 'direction')}, a.direction_n, {R('a.rmse / nullif(z.rmse, 0)', 'ratio_to_zero')}, {R('1 - a.sse / nullif(m.sse, 0)', 'r2_oos')}"


@query(sql(PREDICTIONS + ACC.format(keys="symbol", source="pred"), f"SELECT a.symbol, a.model, {ACC_OUT} FROM acc a LEFT JOIN acc z ON z.symbol = a.symbol AND z.model = 'zero' LEFT JOIN acc m ON m.symbol = a.symbol AND m.model = 'mean'"))
def accuracy_metrics(spark, sf_dir):
    return rounded(metrics.accuracy(predictions(spark, sf_dir)), "rmse", "mae", "direction", "ratio_to_zero", "r2_oos")


IN_FOLDS = f", {SPANS}, folded AS (SELECT p.*, s.fold FROM pred p JOIN spans s ON p.open_time >= s.test_start AND p.open_time < s.test_end WHERE s.fold <> 'tuning')"


@query(
    sql(
        PREDICTIONS + IN_FOLDS + ACC.format(keys="symbol, fold", source="folded"),
        f"SELECT a.symbol, a.fold, a.model, {ACC_OUT} FROM acc a LEFT JOIN acc z ON z.symbol = a.symbol AND z.fold = a.fold AND z.model = 'zero' LEFT JOIN acc m ON m.symbol = a.symbol AND m.fold = a.fold AND m.model = 'mean'",
    )
)
def fold_metrics(spark, sf_dir):
    rows = splits.assign(predictions(spark, sf_dir), FOLDS)
    return rounded(metrics.accuracy(rows, ["symbol", "fold"]), "rmse", "mae", "direction", "ratio_to_zero", "r2_oos")


MSE = ", mse AS (SELECT symbol, model, avg((y_true - y_pred) * (y_true - y_pred)) AS mse, count(*) AS n FROM pred GROUP BY 1, 2)"
ASKED = "(VALUES " + ", ".join(f"('{q}', '{b}', '{m}')" for q, b, m in QUESTIONS) + ") q(question, base, model)"


@query(sql(PREDICTIONS + MSE, f"SELECT m.symbol, q.question, q.base, q.model, m.n, {R('(m.mse / nullif(b.mse, 0) - 1) * 100', 'change_pct')} FROM {ASKED} JOIN mse m ON m.model = q.model JOIN mse b ON b.symbol = m.symbol AND b.model = q.base"))
def pair_mse_change(spark, sf_dir):
    return rounded(metrics.pair_change(predictions(spark, sf_dir), QUESTIONS), "change_pct")


LRV = """, pairs AS (SELECT * FROM (VALUES ('zero', 'mean'), ('zero', 'last'), ('mean', 'mean6')) v(base, model)),
loss AS (SELECT symbol, model, open_time, (y_true - y_pred) * (y_true - y_pred) AS loss FROM pred),
d AS (SELECT m.symbol, p.base, p.model, m.open_time, b.loss - m.loss AS d, b.loss AS base_loss FROM pairs p JOIN loss m ON m.model = p.model JOIN loss b ON b.model = p.base AND b.symbol = m.symbol AND b.open_time = m.open_time),
c AS (SELECT *, d - avg(d) OVER g AS x, count(*) OVER g AS n, row_number() OVER (PARTITION BY symbol, base, model ORDER BY open_time) AS i FROM d WINDOW g AS (PARTITION BY symbol, base, model)),
l AS (SELECT symbol, base, model, max(n) AS n, avg(d) AS mean_d, avg(base_loss) AS base_mse, CAST(floor(4 * pow(max(n) / 100.0, 2.0 / 9.0)) AS INTEGER) AS lags FROM c GROUP BY 1, 2, 3),
g0 AS (SELECT symbol, base, model, sum(x * x) / max(n) AS v FROM c GROUP BY 1, 2, 3),
gk AS (SELECT a.symbol, a.base, a.model, sum(2 * (1 - (a.i - b.i) / (l.lags + 1.0)) * a.x * b.x) / max(l.n) AS v FROM c a JOIN l ON l.symbol = a.symbol AND l.base = a.base AND l.model = a.model
  JOIN c b ON b.symbol = a.symbol AND b.base = a.base AND b.model = a.model AND b.i >= a.i - l.lags AND b.i < a.i GROUP BY 1, 2, 3),
lrv AS (SELECT l.*, g0.v + coalesce(gk.v, 0) AS lrv FROM l JOIN g0 ON g0.symbol = l.symbol AND g0.base = l.base AND g0.model = l.model LEFT JOIN gk ON gk.symbol = l.symbol AND gk.base = l.base AND gk.model = l.model)"""


def differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.loss_differences(predictions(spark, sf_dir), PAIRS)


@query(sql(PREDICTIONS + LRV, f"SELECT symbol, base, model, n, {R('mean_d', 'mean')}, {R('lrv', 'lrv')}, lags FROM lrv"))
def long_run_variance(spark, sf_dir):
    return rounded(stats.long_run_variance(differences(spark, sf_dir), ["symbol", "base", "model"], "d", ["open_time"]), "mean", "lrv")


@query(sql(PREDICTIONS + LRV, f"SELECT symbol, base, model, n, {R('mean_d', 'mean_d')}, lags AS hac_lags, {R('CASE WHEN lrv > 0 THEN mean_d / sqrt(lrv / n) END', 'dm')} FROM lrv"))
def diebold_mariano(spark, sf_dir):
    return rounded(stats.diebold_mariano(differences(spark, sf_dir)), "mean_d", "dm")


HOLM = """, hr AS (SELECT *, p IS NOT NULL AS there, count(*) OVER (PARTITION BY {family}, p IS NOT NULL) AS m, row_number() OVER (PARTITION BY {family}, p IS NOT NULL ORDER BY p, {tie}) AS i FROM {source}),
h AS (SELECT *, CASE WHEN there THEN least(1.0, max((m - i + 1) * p) OVER (PARTITION BY {family}, there ORDER BY i)) END AS p_holm FROM hr)"""
DM_P = PREDICTIONS + LRV + f""", z AS (SELECT *, CASE WHEN lrv > 0 THEN mean_d / sqrt(lrv / n) END AS dm FROM lrv), pv AS (SELECT *, 0.5 * (1 - {erf("dm / sqrt(2)")}) AS p FROM z)"""


@query(sql(DM_P + HOLM.format(family="symbol", tie="base, model", source="pv"), f"SELECT symbol, base, model, n, {R('mean_d', 'mean_d')}, lags AS hac_lags, {R('dm', 'dm')}, {R('p', 'p_value')}, {R('p_holm', 'p_holm')} FROM h"))
def diebold_mariano_p(spark, sf_dir):
    """One-sided p-values, and Holm's adjustment of each symbol's family."""
    got = stats.with_p_value(stats.diebold_mariano(differences(spark, sf_dir)), "dm")
    return rounded(stats.holm(got, "p_value", ["symbol"], ["base", "model"]), "mean_d", "dm", "p_value", "p_holm")


PT = PREDICTIONS + """, s AS (SELECT symbol, model, count(*) AS n, avg(CASE WHEN y_true > 0 THEN 1.0 ELSE 0.0 END) AS a, avg(CASE WHEN y_pred > 0 THEN 1.0 ELSE 0.0 END) AS b, avg(CASE WHEN (y_true > 0) = (y_pred > 0) THEN 1.0 ELSE 0.0 END) AS h
FROM pred WHERE y_true <> 0 AND y_pred <> 0 GROUP BY 1, 2), e AS (SELECT *, a * b + (1 - a) * (1 - b) AS p FROM s),
v AS (SELECT *, p * (1 - p) / n - ((2 * a - 1) ** 2 * b * (1 - b) / n + (2 * b - 1) ** 2 * a * (1 - a) / n + 4 * a * b * (1 - a) * (1 - b) / (n * n)) AS v FROM e),
pt AS (SELECT *, CASE WHEN v > 0 THEN (h - p) / sqrt(v) END AS pt FROM v)"""


@query(sql(PT, f"SELECT symbol, model, n, {R('h', 'hit_rate')}, {R('pt', 'pt')} FROM pt"))
def pesaran_timmermann(spark, sf_dir):
    return rounded(stats.pesaran_timmermann(predictions(spark, sf_dir)), "hit_rate", "pt")


@query(
    sql(
        "p AS (SELECT p_brand AS family, p_type AS item, CASE WHEN avg(p_size) > 27 THEN NULL ELSE avg(p_retailprice) / 131071.0 END AS p FROM part GROUP BY 1, 2), "
        "r AS (SELECT *, count(*) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family ORDER BY p, item) AS i FROM p WHERE p IS NOT NULL), "
        "a AS (SELECT family, item, least(1.0, max((m - i + 1) * p) OVER (PARTITION BY family ORDER BY i)) AS h FROM r)",
        f"SELECT p.family, p.item, {R('p.p', 'p')}, {R('a.h', 'p_holm')} FROM p LEFT JOIN a ON a.family = p.family AND a.item = p.item",
    )
)
def holm_adjust(spark, sf_dir):
    """Step-down adjustment inside each brand; prices stand for p-values."""
    parts = roles.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("family"), F.col("p_type").alias("item"))
    rows = parts.agg(F.when(F.avg("p_size") > 27, None).otherwise(F.avg("p_retailprice") / 131071.0).alias("p"))
    return rounded(stats.holm(rows, "p", ["family"], ["item"]), "p", "p_holm")


Z, MDE = stats.normal_ppf(0.975), stats.normal_ppf(0.95) + stats.normal_ppf(0.8)


@query(
    sql(
        PREDICTIONS + LRV + ", e AS (SELECT *, -mean_d / base_mse * 100 AS change, CASE WHEN lrv > 0 THEN sqrt(lrv / n) / base_mse * 100 END AS se FROM lrv)",
        f"SELECT symbol, base, model, n, {R('change', 'change_pct')}, {R('se', 'se_pct')}, {R(f'change - {Z!r} * se', 'ci_low')}, {R(f'change + {Z!r} * se', 'ci_high')}, {R(f'{MDE!r} * se', 'mde_pct')}, {R('CASE WHEN lrv > 0 THEN mean_d / sqrt(lrv / n) END', 'dm')} FROM e",
    )
)
def effect_bounds(spark, sf_dir):
    return rounded(stats.effect_bounds(differences(spark, sf_dir)), "change_pct", "se_pct", "ci_low", "ci_high", "mde_pct", "dm")


@query(
    sql(
        TABLE + ", v AS (SELECT * FROM full_table WHERE valid), q AS (SELECT symbol, quantile_cont(all_news_intensity, 0.9) AS edge FROM v GROUP BY symbol)",
        "SELECT v.symbol, count(*) AS n, count(*) FILTER (WHERE v.n > 0) AS has_news, count(*) FILTER (WHERE all_news_intensity >= edge) AS in_burst, count(*) FILTER (WHERE v.n > 0 OR all_news_intensity >= edge) AS either FROM v JOIN q ON q.symbol = v.symbol GROUP BY v.symbol",
    )
)
def subset_masks(spark, sf_dir):
    rows = stats.subset_masks(model_table(spark, sf_dir).filter("valid"), "all_news_count", "all_news_intensity")
    return rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(c) for c in ("has_news", "in_burst", "either")])


@query(sql(TABLE, f"SELECT symbol, count(*) AS n, {R('corr(all_sent_mean, ret_lag1)', 'corr')}, {R('regr_slope(ret_lag1, all_sent_mean)', 'slope')} FROM full_table WHERE valid AND n > 0 GROUP BY symbol"))
def validity_corr_slope(spark, sf_dir):
    rows = model_table(spark, sf_dir).filter("valid and all_news_count > 0")
    return rounded(stats.validity(rows, "all_sent_mean", "ret_lag1", ["symbol"]), "corr", "slope")


BT = PREDICTIONS + """, g AS (SELECT p.symbol, p.model, p.open_time, p.y_true, s.strategy, CAST(c.bp AS DOUBLE) AS cost_bp, CASE s.strategy WHEN 'long_flat' THEN CASE WHEN y_pred > 0 THEN 1.0 ELSE 0.0 END ELSE sign(y_pred) END AS pos
  FROM pred p CROSS JOIN (VALUES ('long_flat'), ('long_short')) s(strategy) CROSS JOIN (VALUES (0), (10)) c(bp)),
n AS (SELECT *, abs(pos - coalesce(lag(pos) OVER w, 0)) AS turnover, pos * (exp(least(y_true, 0.05)) - 1) AS gross FROM g WINDOW w AS (PARTITION BY symbol, model, strategy, cost_bp ORDER BY open_time)),
net AS (SELECT *, gross - cost_bp * 0.0001 * turnover AS net FROM n)"""
KEYS = ["symbol", "model", "strategy", "cost_bp"]


def traded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net returns of two strategies at two costs; returns are capped at 5 % up, as these series jump."""
    rows = predictions(spark, sf_dir).withColumn("y_true", F.least("y_true", F.lit(0.05)))
    return backtest.net_returns(backtest.grid(rows, ["long_flat", "long_short"], [0, 10]), KEYS)


@query(sql(BT, f"SELECT symbol, model, strategy, cost_bp, {T('open_time', 'open_time')}, {R('pos', 'pos')}, {R('turnover', 'turnover')}, {R('gross', 'gross')}, {R('net', 'net')} FROM net"))
def backtest_net(spark, sf_dir):
    got = traded(spark, sf_dir).select(*KEYS, "open_time", "pos", "turnover", "gross", "net")
    return timed(rounded(got, "pos", "turnover", "gross", "net"), "open_time")


@query(
    sql(
        BT + ", v AS (SELECT symbol, model, strategy, cost_bp, open_time, product(1 + net) OVER (PARTITION BY symbol, model, strategy, cost_bp ORDER BY open_time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM net)",
        f"SELECT symbol, model, strategy, cost_bp, {T('open_time', 'open_time')}, {R('value', 'value')}, {R('value / greatest(1.0, max(value) OVER (PARTITION BY symbol, model, strategy, cost_bp ORDER BY open_time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) - 1', 'drawdown')} FROM v WHERE cost_bp = 0 AND strategy = 'long_flat'",
    )
)
def equity_drawdown(spark, sf_dir):
    rows = traded(spark, sf_dir).filter("cost_bp = 0 and strategy = 'long_flat'")
    got = backtest.equity(rows, KEYS).select(*KEYS, "open_time", "value", "drawdown")
    return timed(rounded(got, "value", "drawdown"), "open_time")


SUMS = BT + """, v AS (SELECT *, product(1 + net) OVER w AS value FROM net WINDOW w AS (PARTITION BY symbol, model, strategy, cost_bp ORDER BY open_time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
dd AS (SELECT *, value / greatest(1.0, max(value) OVER (PARTITION BY symbol, model, strategy, cost_bp ORDER BY open_time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) - 1 AS dd FROM v),
s AS (SELECT symbol, model, strategy, cost_bp, count(*) AS hours, product(1 + net) AS total, avg(net) AS mean, stddev_samp(net) AS sd, sqrt(avg(pow(least(net, 0), 2))) AS down, min(dd) AS max_drawdown, sum(turnover) AS turn,
  avg(CASE WHEN pos <> 0 THEN 1.0 ELSE 0.0 END) AS time_in_market, avg(gross) AS gross FROM dd GROUP BY 1, 2, 3, 4)"""
SHARPE = "CASE WHEN sd > 0 THEN mean / sd * sqrt(8760) END"


@query(
    sql(
        SUMS,
        f"SELECT symbol, model, strategy, cost_bp, hours, {R('max_drawdown', 'max_drawdown')}, {R('sd * sqrt(8760)', 'annual_vol')}, {R(SHARPE, 'sharpe')}, {R('CASE WHEN down > 0 THEN mean / down * sqrt(8760) END', 'sortino')}, "
        f"{R('turn / (hours / 8760.0)', 'turnover_per_year')}, {R('time_in_market', 'time_in_market')}, {R('CASE WHEN turn > 1 THEN gross / (turn / hours) * 10000 END', 'breakeven_bp')} FROM s",
    )
)
def backtest_summary(spark, sf_dir):
    got = backtest.summary(traded(spark, sf_dir), KEYS).drop("total_return", "annual_return")
    return rounded(got, *[c for c in got.columns if c not in (*KEYS, "hours")])


@query(sql(SUMS, f"SELECT symbol, model, strategy, {R(f'max({SHARPE}) FILTER (WHERE cost_bp = 0)', 'bp_0')}, {R(f'max({SHARPE}) FILTER (WHERE cost_bp = 10)', 'bp_10')} FROM s GROUP BY 1, 2, 3"))
def sharpe_pivot(spark, sf_dir):
    got = backtest.sharpe_by_cost(backtest.summary(traded(spark, sf_dir), KEYS), [0, 10], ["symbol", "model", "strategy"])
    return rounded(got, "bp_0", "bp_10")


@query(sql(SUMS, "SELECT strategy, cost_bp, count(*) AS series, count(*) FILTER (WHERE sd > 0) AS moving, sum(hours) AS hours FROM s GROUP BY 1, 2"))
def cost_grid(spark, sf_dir):
    got = traded(spark, sf_dir).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("h"), F.stddev_samp("net").alias("sd"))
    return got.groupBy("strategy", "cost_bp").agg(F.count(F.lit(1)).alias("series"), F.count_if(F.col("sd") > 0).alias("moving"), F.sum("h").cast("double").alias("hours"))


@query(
    sql(
        SUMS + f""", a AS (SELECT symbol, model, sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS rmse FROM pred GROUP BY 1, 2),
        t AS (SELECT s.symbol, s.model, a.rmse <= 1.5 * z.rmse AS accurate, {SHARPE} AS sharpe, s.mean AS ci_low FROM s JOIN a ON a.symbol = s.symbol AND a.model = s.model JOIN a z ON z.symbol = s.symbol AND z.model = 'zero' WHERE strategy = 'long_flat' AND cost_bp = 10),
        p AS (SELECT *, accurate AND coalesce(ci_low > -1, FALSE) AND model NOT IN ('zero', 'mean') AS passes FROM t),
        k AS (SELECT *, row_number() OVER (PARTITION BY symbol, passes ORDER BY sharpe DESC NULLS LAST, model DESC) AS k FROM p)""",
        "SELECT symbol, model, accurate, passes, passes AND k = 1 AS chosen FROM k",
    )
)
def model_selection(spark, sf_dir):
    acc = metrics.accuracy(predictions(spark, sf_dir)).select("symbol", "model", (F.col("ratio_to_zero") <= 1.5).alias("accurate"))
    rows = traded(spark, sf_dir).filter("strategy = 'long_flat' and cost_bp = 10")
    table = backtest.summary(rows, KEYS).join(rows.groupBy("symbol", "model").agg((F.avg("net") + 1).alias("ci_low")), ["symbol", "model"]).join(acc, ["symbol", "model"])
    return backtest.select_model(table, ["zero", "mean"]).select("symbol", "model", "accurate", "passes", "chosen")


@query(sql(PREDICTIONS, "SELECT symbol, count(*) AS hours, count(*) FILTER (WHERE spread > 0.000000000001) AS differing FROM (SELECT symbol, open_time, max(y_true) - min(y_true) AS spread FROM pred GROUP BY 1, 2) GROUP BY symbol"))
def truth_check(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    bad = validate.truth_differs(rows).groupBy("symbol").agg(F.count(F.lit(1)).alias("differing"))
    return rows.groupBy("symbol").agg(F.countDistinct("open_time").alias("hours")).join(bad, "symbol", "left").na.fill(0, ["differing"])


PAIRED = "y AS (SELECT doc_id, quality, toxic FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL)"


@query(
    sql(
        PAIRED + ", t AS (SELECT count(*) AS n, avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END) AS po FROM y), c AS (SELECT sum(a.x * b.x) / (SELECT n * n FROM t) AS pe FROM (SELECT quality AS v, count(*) AS x FROM y GROUP BY 1) a JOIN (SELECT toxic AS v, count(*) AS x FROM y GROUP BY 1) b ON a.v = b.v)",
        f"SELECT n, {R('po', 'percent')}, {R('(po - pe) / (1 - pe)', 'kappa')} FROM t, c",
    )
)
def label_agreement(spark, sf_dir):
    return rounded(annotate.agreement(roles.table(spark, sf_dir, "labels"), "quality", "toxic"), "percent", "kappa")


@query(
    sql(
        PAIRED + ", k AS (SELECT unnest([0, 1]) AS class), f AS (SELECT class, count(*) FILTER (WHERE quality = class AND toxic = class) AS tp, count(*) FILTER (WHERE quality = class) AS support, count(*) FILTER (WHERE toxic = class) AS guessed FROM y CROSS JOIN k GROUP BY class)",
        f"SELECT class, support, {R('coalesce(2.0 * tp / nullif(support + guessed, 0), 0)', 'f1')} FROM f",
    )
)
def classification_f1(spark, sf_dir):
    return rounded(annotate.f1_scores(roles.table(spark, sf_dir, "labels"), "quality", "toxic", [0, 1]), "f1")


@query(sql("k AS (SELECT unnest([0, 1, 2]) AS label), c AS (SELECT quality AS label, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY 1)", f"SELECT k.label, coalesce(c.n, 0) AS n, {R('coalesce(c.n, 0) / (SELECT sum(n) FROM c)', 'share')} FROM k LEFT JOIN c ON c.label = k.label"))
def label_shares(spark, sf_dir):
    return rounded(annotate.label_shares(roles.table(spark, sf_dir, "labels"), "quality", [0, 1, 2]), "share")


@query(
    sql(
        "g AS (SELECT doc_id, CAST(n_chars % 7 AS DOUBLE) / 3.0 AS a, CAST(n_chars % 5 AS DOUBLE) / 2.0 AS b, CAST(n_chars % 11 AS DOUBLE) / 5.0 AS c FROM documents), e AS (SELECT doc_id, exp(a) AS a, exp(b) AS b, exp(c) AS c FROM g)",
        f"SELECT doc_id, {R('c / (a + b + c) - a / (a + b + c)', 'score')}, CASE WHEN a >= b AND a >= c THEN 'negative' WHEN b >= c THEN 'neutral' ELSE 'positive' END AS label FROM e",
    )
)
def argmax_label(spark, sf_dir):
    n = F.col("n_chars")
    logits = F.array((n % 7) / F.lit(3.0), (n % 5) / F.lit(2.0), (n % 11) / F.lit(5.0))
    rows = roles.table(spark, sf_dir, "documents").select("doc_id", scores.softmax(logits).alias("p"))
    return rounded(rows.select("doc_id", scores.score_of(F.col("p")).alias("score"), scores.label_of(F.col("p")).alias("label")), "score")


ALLOC = """st AS (SELECT source AS stratum, count(*) AS n FROM documents GROUP BY 1), q AS (SELECT stratum, n, 97 * n / CAST((SELECT sum(n) FROM st) AS DOUBLE) AS share FROM st),
f AS (SELECT *, floor(share) AS fl, row_number() OVER (ORDER BY share - floor(share) DESC, stratum) AS k FROM q),
quota AS (SELECT stratum, n, CAST(least(n, fl + CASE WHEN k <= 97 - (SELECT sum(fl) FROM f) THEN 1 ELSE 0 END) AS BIGINT) AS quota FROM f)"""


def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("stratum"))


def quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.allocate(strata(spark, sf_dir).groupBy("stratum").agg(F.count(F.lit(1)).alias("n")), 97)


@query(sql(ALLOC, "SELECT stratum, n, quota FROM quota"))
def sample_allocate(spark, sf_dir):
    return quotas(spark, sf_dir)


@query()
def stratified_sample(spark, sf_dir):
    got = sampling.stratified(strata(spark, sf_dir), quotas(spark, sf_dir), "doc_id", 7)
    return sampling.numbered_sample(got, "EN", "doc_id", 7, nested=20)


@query(sql(ALLOC, f"SELECT stratum, n AS corpus_n, {R('n / (SELECT sum(n) FROM quota)', 'corpus_share')}, quota AS sample_n, {R('quota / (SELECT sum(quota) FROM quota)', 'sample_share')} FROM quota"))
def strata_table(spark, sf_dir):
    rows = strata(spark, sf_dir)
    return rounded(sampling.strata_table(rows, sampling.stratified(rows, quotas(spark, sf_dir), "doc_id", 7)), "corpus_share", "sample_share")


@query(sql(PREDICTIONS + IN_FOLDS + ", m AS (SELECT symbol, fold, model, avg((y_true - y_pred) * (y_true - y_pred)) AS mse FROM folded GROUP BY 1, 2, 3), c AS (SELECT m.symbol, m.fold, m.mse - z.mse AS change FROM m JOIN m z ON z.symbol = m.symbol AND z.fold = m.fold AND z.model = 'zero' WHERE m.model = 'mean'), "
           "s AS (SELECT symbol, count(*) FILTER (WHERE change < 0) AS improved, count(*) AS total FROM c GROUP BY symbol), k AS (SELECT s.*, unnest(generate_series(improved, total)) AS k FROM s)",
           f"SELECT symbol, improved, total, {R('least(1.0, sum(factorial(CAST(total AS INTEGER)) / (factorial(CAST(k AS INTEGER)) * factorial(CAST(total - k AS INTEGER)))) / pow(2, max(total)))', 'p_value')} FROM k GROUP BY symbol, improved, total"))
def fold_sign_test(spark, sf_dir):
    """In how many folds the mean forecast beats zero, and the chance of as many by luck."""
    rows = splits.assign(predictions(spark, sf_dir), FOLDS)
    mse = rows.groupBy("symbol", "fold", "model").agg(F.avg(F.pow(F.col("y_true") - F.col("y_pred"), 2)).alias("mse"))
    zero = mse.filter("model = 'zero'").select("symbol", "fold", F.col("mse").alias("base"))
    changes = mse.filter("model = 'mean'").join(zero, ["symbol", "fold"]).withColumn("change", F.col("mse") - F.col("base"))
    return rounded(stats.sign_test(changes, "change", ["symbol"]), "p_value")
