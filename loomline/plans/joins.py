"""Queries over joins, look-ups, orders and small summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, times
from ..operators import backtest, grid, metrics, regression, stats
from ..sources import roles
from .evaluation import BT, HOLM, KEYS, predictions, traded
from .registry import CANDLES, FEATURES, NEWS, PREDICTIONS, TAGGED, R, T, erf, query, r6, rounded, sql, timed
from .series import TABLE, model_table, priced


@query(sql(NEWS, f"SELECT source, strftime(published, '%Y-%m') AS month, lang, count(*) AS n, {R('avg(score)', 'score')} FROM news GROUP BY 1, 2, 3"))
def source_summary(spark, sf_dir):
    """Records and mean score by source, month and language."""
    news = roles.headlines(spark, sf_dir)
    return rounded(news.groupBy("source", times.month_label(F.col("published")).alias("month"), "lang").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("score")), "score")


@query(sql(TAGGED, f"SELECT lower(lang) AS kind, count(*) AS n, {R('avg(CASE WHEN tag_a THEN 1.0 ELSE 0.0 END)', 'a_share')}, {R('avg(CASE WHEN tag_b THEN 1.0 ELSE 0.0 END)', 'b_share')} FROM tagged GROUP BY 1"))
def flag_by_kind(spark, sf_dir):
    """Shares of both tags by a declared kind."""
    rows = roles.tagged_headlines(spark, sf_dir).groupBy(F.lower("lang").alias("kind"))
    return rounded(rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("tag_a").cast("double")).alias("a_share"), F.avg(F.col("tag_b").cast("double")).alias("b_share")), "a_share", "b_share")


@query(sql(NEWS, f"SELECT l.doc_id, l.quality AS first_label, m.toxic AS second_label, {R('n.score', 'score')} FROM labels l JOIN labels m ON m.doc_id = l.doc_id LEFT JOIN news n ON n.doc_id = l.doc_id"))
def labels_with_scores(spark, sf_dir):
    """Two label sets side by side, with the scores of the labelled records."""
    labels, news = roles.table(spark, sf_dir, "labels"), roles.headlines(spark, sf_dir)
    both = labels.select("doc_id", F.col("quality").alias("first_label")).join(labels.select("doc_id", F.col("toxic").alias("second_label")), "doc_id")
    return both.join(news.select("doc_id", r6(F.col("score")).alias("score")), "doc_id", "left")


@query(
    sql(
        NEWS + ", d AS (SELECT url, doc_id AS translated, row_number() OVER (PARTITION BY url ORDER BY doc_id) AS k FROM news WHERE lang <> 'en')",
        "SELECT n.doc_id, coalesce(d.translated, -1) AS translated FROM news n LEFT JOIN d ON d.url = n.url AND d.k = 1 WHERE n.lang = 'en'",
    )
)
def translation_lookup(spark, sf_dir):
    """English records with the first record of another language at the same address, or -1."""
    news = roles.headlines(spark, sf_dir).select("doc_id", "url", "lang")
    known = grid.first_of(news.filter("lang <> 'en'"), ["url"], [F.col("doc_id")]).select("url", F.col("doc_id").alias("translated"))
    return news.filter("lang = 'en'").join(known, "url", "left").select("doc_id", F.coalesce("translated", F.lit(-1)).cast("long").alias("translated"))


@query(
    sql(
        NEWS + ", t AS (SELECT 'top' AS side, doc_id, score FROM news ORDER BY score DESC, doc_id LIMIT 5), b AS (SELECT 'bottom' AS side, doc_id, score FROM news ORDER BY score, doc_id LIMIT 5)",
        f"SELECT side, doc_id, {R('score', 'score')} FROM (SELECT * FROM t UNION ALL SELECT * FROM b)",
    )
)
def score_extremes(spark, sf_dir):
    """The five highest and lowest scores."""
    news = roles.headlines(spark, sf_dir).select("doc_id", "score")
    top = news.orderBy(F.desc("score"), "doc_id").limit(5).select(F.lit("top").alias("side"), "doc_id", "score")
    low = news.orderBy("score", "doc_id").limit(5).select(F.lit("bottom").alias("side"), "doc_id", "score")
    return rounded(top.unionByName(low), "score")


@query(
    sql(
        PREDICTIONS + ", m AS (SELECT symbol, model, sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS rmse FROM pred GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY rmse, model) AS k FROM m)",
        f"SELECT symbol, model, {R('rmse', 'rmse')} FROM k WHERE k = 1",
    )
)
def best_model(spark, sf_dir):
    """The model with the least error of each symbol; the first name wins ties."""
    errors = predictions(spark, sf_dir).groupBy("symbol", "model").agg(metrics.rmse().alias("rmse"))
    return rounded(errors.groupBy("symbol").agg(F.min_by("model", F.struct("rmse", "model")).alias("model"), F.min("rmse").alias("rmse")), "rmse")


@query(sql(CANDLES, f"SELECT {T('open_time', 'open_time')}, count(DISTINCT symbol) AS symbols FROM candles GROUP BY candles.open_time HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM candles)"))
def shared_hours(spark, sf_dir):
    """Hours in which every symbol has a candle."""
    rows = roles.candles(spark, sf_dir).select("symbol", "open_time")
    everyone = rows.agg(F.countDistinct("symbol").alias("all"))
    hours = rows.groupBy("open_time").agg(F.countDistinct("symbol").alias("symbols"))
    return timed(hours.crossJoin(F.broadcast(everyone)).filter("symbols = all").drop("all"), "open_time")


@query(
    sql(
        "f AS (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY 1, 2)",
        "SELECT conv_id, string_agg(role, ',' ORDER BY first, role) AS roles FROM f GROUP BY conv_id",
    )
)
def roles_in_order(spark, sf_dir):
    """Each conversation's roles in the order of their first turn."""
    first = roles.table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("first"))
    ordered = F.sort_array(F.collect_list(F.struct("first", "role")))
    return first.groupBy("conv_id").agg(F.array_join(ordered["role"], ",").alias("roles"))


@query(
    sql(
        CANDLES + ", " + NEWS + ", c AS (SELECT max(a) AS a, min(b) AS b FROM (SELECT min(open_time) AS a, max(open_time) + INTERVAL 1 HOUR AS b FROM candles GROUP BY symbol)), s AS (SELECT greatest(c.a, (SELECT min(published) FROM news)) AS s, c.b FROM c)",
        f"SELECT {T('''CASE WHEN date_trunc('day', s) = s THEN s ELSE date_trunc('day', s) + INTERVAL 1 DAY END''', 'period_start')}, {T('b', 'period_end')} FROM s",
    )
)
def sample_period(spark, sf_dir):
    """The common sample: from the first midnight with all series to the end of the first that stops."""
    got = grid.sample_period(roles.candles(spark, sf_dir), {"news": roles.headlines(spark, sf_dir)})
    return timed(spark.createDataFrame([(got.start, got.end)], "period_start timestamp, period_end timestamp"), "period_start", "period_end")


@query(
    sql(
        BT + ", v AS (SELECT *, product(1 + net) OVER (PARTITION BY symbol, model, strategy, cost_bp ORDER BY open_time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM net)",
        f"SELECT symbol, model, {T('open_time + INTERVAL 2 HOUR', 'at')}, {R('value', 'value')} FROM v WHERE strategy = 'long_short' AND cost_bp = 10 AND model = 'mean6'",
    )
)
def equity_curve(spark, sf_dir):
    """Portfolio values at the close of the hour that was traded, two hours after the forecast's hour opened."""
    rows = traded(spark, sf_dir).filter("strategy = 'long_short' and cost_bp = 10 and model = 'mean6'")
    got = backtest.equity(rows, KEYS).select("symbol", "model", (F.col("open_time") + F.expr("INTERVAL 2 HOUR")).alias("at"), "value")
    return timed(rounded(got, "value"), "at")


@query(
    sql(
        "x AS (SELECT doc_id, CASE quality WHEN 1 THEN ' Pos ' WHEN 0 THEN 'NEG' END AS written FROM labels)",
        "SELECT doc_id, CASE trim(lower(written)) WHEN 'pos' THEN 'positive' WHEN 'neg' THEN 'negative' END AS label FROM x",
    )
)
def label_aliases(spark, sf_dir):
    written = F.when(F.col("quality") == 1, " Pos ").when(F.col("quality") == 0, "NEG")
    return roles.table(spark, sf_dir, "labels").select("doc_id", text.parse_label(written, {"pos": "positive", "neg": "negative"}).alias("label"))


@query("SELECT p_partkey AS k, translate(format('{:,.2f}', p_retailprice), ',.', ' ,') AS price FROM part")
def decimal_comma(spark, sf_dir):
    return roles.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), text.decimal_comma(F.col("p_retailprice"), 2).alias("price"))


@query(sql(FEATURES, f"SELECT symbol, count(ret_lag1) AS n, {R('avg(ret_lag1)', 'mean_ret')}, {R('corr(ret_lag1, target)', 'next_corr')} FROM price GROUP BY symbol"))
def return_autocorrelation(spark, sf_dir):
    rows = priced(spark, sf_dir)
    return rounded(rows.groupBy("symbol").agg(F.count("ret_lag1").alias("n"), F.avg("ret_lag1").alias("mean_ret"), F.corr("ret_lag1", "target").alias("next_corr")), "mean_ret", "next_corr")


def hac(y: str, x: str, where: str, name: str = "") -> str:
    """Statements for the Wald statistic of one slope with Newey-West covariance, in closed form, as w{name}(symbol, n, wald)."""
    return f""", d{name} AS (SELECT symbol, open_time, {y} AS y, {x} AS x, count(*) OVER (PARTITION BY symbol) AS n, avg({x}) OVER (PARTITION BY symbol) AS mx, avg({y}) OVER (PARTITION BY symbol) AS my,
  row_number() OVER (PARTITION BY symbol ORDER BY open_time) AS i FROM full_table WHERE {where}),
b{name} AS (SELECT symbol, max(n) AS n, sum((x - mx) * (y - my)) / nullif(sum((x - mx) * (x - mx)), 0) AS b, CASE WHEN sum((x - mx) * (x - mx)) > 1e-9 * sum(x * x) THEN sum((x - mx) * (x - mx)) END AS sxx, CAST(floor(4 * pow(max(n) / 100.0, 2.0 / 9.0)) AS INTEGER) AS lags FROM d{name} GROUP BY symbol HAVING max(n) > 2),
u{name} AS (SELECT d.symbol, d.i, (d.x - d.mx) * (d.y - d.my - b.b * (d.x - d.mx)) AS u FROM d{name} d JOIN b{name} b ON b.symbol = d.symbol),
s{name} AS (SELECT symbol, sum(u * u) AS s0 FROM u{name} GROUP BY symbol),
k{name} AS (SELECT a.symbol, sum(2 * (1 - (a.i - c.i) / (b.lags + 1.0)) * a.u * c.u) AS sk FROM u{name} a JOIN b{name} b ON b.symbol = a.symbol JOIN u{name} c ON c.symbol = a.symbol AND c.i >= a.i - b.lags AND c.i < a.i GROUP BY a.symbol),
w{name} AS (SELECT b.symbol, b.n, b.b * b.b / ((s.s0 + coalesce(k.sk, 0)) / (b.sxx * b.sxx)) AS wald FROM b{name} b JOIN s{name} s ON s.symbol = b.symbol LEFT JOIN k{name} k ON k.symbol = b.symbol)"""


VALID = TABLE + hac("ret_lag1", "all_sent_mean", "valid AND n > 0", "_same") + hac("target", "all_sent_mean", "valid AND n > 0", "_next")
VALID += f", pv AS (SELECT 1 AS family, *, 1 - {erf('sqrt(wald / 2)')} AS p FROM (SELECT 'same' AS kind, * FROM w_same UNION ALL SELECT 'next', * FROM w_next))"


@query(sql(VALID + HOLM.format(family="family", tie="symbol, kind", source="pv"), f"SELECT symbol, kind, n, {R('wald', 'wald')}, {R('p', 'p_value')}, 1 AS df, {R('p_holm', 'p_holm')} FROM h"))
def validity_tests(spark, sf_dir):
    """Wald tests of the score against returns of the same and the next hour, Holm-adjusted over all."""
    rows, out = model_table(spark, sf_dir).filter("valid and all_news_count > 0"), None
    for kind, value in (("same", "ret_lag1"), ("next", "target")):
        part = regression.hac_wald(rows, ["symbol"], value, ["all_sent_mean"], ["all_sent_mean"]).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    got = stats.holm(out.withColumn("family", F.lit(1)), "p_value", ["family"], ["symbol", "kind"]).drop("family")
    return rounded(got, "wald", "p_value", "p_holm")
