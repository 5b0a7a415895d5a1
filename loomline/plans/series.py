"""Queries over candles: grids, gaps, returns, features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, grid, validate
from ..operators.metrics import describe_returns
from ..sources import roles
from .registry import CANDLES, FEATURES, GRID, HOURLY, NEWS, PRICE_COLUMNS, RETURNS, TAGGED, R, T, frame, guarded, query, rounded, sql, timed

SYMBOLS = ["click", "error", "purchase", "signup", "view"]


def full_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.regrid(roles.candles(spark, sf_dir))


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.price_features(full_grid(spark, sf_dir))


@query(sql(CANDLES, f"SELECT symbol, {T('open_time', 'open_time')}, open, high, low, close, {R('volume', 'volume')}, trades FROM candles"))
def candle_ohlcv(spark, sf_dir):
    return timed(rounded(roles.candles(spark, sf_dir), "volume"), "open_time")


@query(sql(GRID, f"SELECT symbol, {T('open_time', 'open_time')}, open, high, low, close, CAST(trades AS DOUBLE) AS trades FROM grid"))
def grid_reindex(spark, sf_dir):
    return timed(full_grid(spark, sf_dir).drop("volume").withColumn("trades", F.col("trades").cast("double")), "open_time")


@query(
    sql(
        GRID + """, marked AS (SELECT symbol, open_time, close IS NULL AS missing, row_number() OVER (PARTITION BY symbol ORDER BY open_time)
          - row_number() OVER (PARTITION BY symbol, close IS NULL ORDER BY open_time) AS island FROM grid)""",
        f"SELECT symbol, {T('min(open_time)', 'gap_start')}, {T('max(open_time)', 'gap_end')}, count(*) AS hours FROM marked WHERE missing GROUP BY symbol, island",
    )
)
def gap_report(spark, sf_dir):
    got = grid.gaps(full_grid(spark, sf_dir))
    return timed(got, "start", "end").withColumnsRenamed({"start": "gap_start", "end": "gap_end"})


@query(
    sql(
        GRID + """, agg AS (SELECT symbol, count(*) FILTER (WHERE least(open, high, low, close) <= 0) AS not_positive, count(*) FILTER (WHERE high < low) AS high_below_low,
          count(*) FILTER (WHERE open < low OR open > high) AS open_outside, count(*) FILTER (WHERE close < low OR close > high) AS close_outside,
          CASE WHEN avg(CASE WHEN close IS NULL THEN 1.0 ELSE 0.0 END) > 0.01 THEN count(*) FILTER (WHERE close IS NULL) ELSE 0 END AS too_many_missing FROM grid GROUP BY symbol)""",
        """SELECT symbol, 'repeated_time' AS check_name, CAST(0 AS BIGINT) AS violations FROM agg UNION ALL SELECT symbol, 'irregular_step', 0 FROM agg
        UNION ALL SELECT symbol, 'not_positive', not_positive FROM agg UNION ALL SELECT symbol, 'high_below_low', high_below_low FROM agg
        UNION ALL SELECT symbol, 'open_outside', open_outside FROM agg UNION ALL SELECT symbol, 'close_outside', close_outside FROM agg
        UNION ALL SELECT symbol, 'too_many_missing', too_many_missing FROM agg""",
    )
)
def candle_violations(spark, sf_dir):
    return validate.candle_violations(full_grid(spark, sf_dir)).withColumnRenamed("check", "check_name")


@query(sql(FEATURES, f"SELECT symbol, {T('open_time', 'open_time')}, " + ", ".join(R(f"ret_lag{k}", f"ret_lag{k}") for k in range(1, 7)) + " FROM price"))
def return_lags(spark, sf_dir):
    names = [f"ret_lag{k}" for k in range(1, 7)]
    return timed(rounded(priced(spark, sf_dir).select("symbol", "open_time", *names), *names), "open_time")


@query(sql(FEATURES, f"SELECT symbol, {T('open_time', 'open_time')}, {R('rv_6', 'rv_6')}, {R('rv_24', 'rv_24')} FROM price"))
def realized_vol(spark, sf_dir):
    return timed(rounded(priced(spark, sf_dir).select("symbol", "open_time", "rv_6", "rv_24"), "rv_6", "rv_24"), "open_time")


@query(sql(FEATURES, f"SELECT symbol, {T('open_time', 'open_time')}, {R('volume_change', 'volume_change')} FROM price"))
def volume_change(spark, sf_dir):
    return timed(rounded(priced(spark, sf_dir).select("symbol", "open_time", "volume_change"), "volume_change"), "open_time")


@query(sql(FEATURES, f"SELECT symbol, {T('open_time', 'open_time')}, {R('target', 'target')} FROM price"))
def next_hour_target(spark, sf_dir):
    return timed(rounded(priced(spark, sf_dir).select("symbol", "open_time", "target"), "target"), "open_time")


@query(sql(HOURLY, f"SELECT {T('hour', 'hour')}, n, {R('sent_mean', 'sent_mean')}, {R('neg_share', 'neg_share')} FROM hourly"))
def news_hourly(spark, sf_dir):
    return timed(rounded(features.hourly_news(roles.headlines(spark, sf_dir)), "sent_mean", "neg_share"), "hour")


ON_GRID = GRID + ", " + HOURLY + """, joined AS (SELECT g.symbol, g.open_time, coalesce(h.n, 0) AS n, coalesce(h.sent_mean, 0.0) AS s, coalesce(h.neg_share, 0.0) AS neg
  FROM grid g LEFT JOIN hourly h ON h.hour = g.open_time)"""


def with_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every symbol's hours with the hourly flow of all headlines."""
    rows = full_grid(spark, sf_dir).select("symbol", "open_time")
    return features.news_features(features.news_on_grid(rows, features.hourly_news(roles.headlines(spark, sf_dir))), "all")


@query(
    sql(
        ON_GRID + f", x AS (SELECT *, avg(n) OVER {frame(168, 1)} AS usual FROM joined)",
        f"SELECT symbol, {T('open_time', 'open_time')}, n AS news_count, {R('ln(1 + n) - ln(1 + coalesce(usual, 0))', 'news_intensity')} FROM x",
    )
)
def news_intensity(spark, sf_dir):
    got = with_news(spark, sf_dir).select("symbol", "open_time", F.col("all_news_count").cast("long").alias("news_count"), F.col("all_news_intensity").alias("news_intensity"))
    return timed(rounded(got, "news_intensity"), "open_time")


@query(
    sql(
        ON_GRID,
        f"SELECT symbol, {T('open_time', 'open_time')}, {R(guarded('s', 'max(s) OVER {w}', 6), 'sent_max6')}, {R(guarded('s', 'min(s) OVER {w}', 6), 'sent_min6')}, {R(guarded('s', 'stddev_samp(s) OVER {w}', 6), 'sent_std6')}, "
        f"{R('lag(s) OVER (PARTITION BY symbol ORDER BY open_time)', 'sent_lag1')} FROM joined",
    )
)
def news_rolling_stats(spark, sf_dir):
    names = ["sent_max6", "sent_min6", "sent_std6", "sent_lag1"]
    got = with_news(spark, sf_dir).select("symbol", "open_time", *[F.col(f"all_{n}").alias(n) for n in names])
    return timed(rounded(got, *names), "open_time")


@query(
    sql(
        ON_GRID,
        f"SELECT symbol, {T('open_time', 'open_time')}, {R(f'CASE WHEN count(s) OVER {frame(5, 3)} = 3 THEN avg(s) OVER {frame(2)} - avg(s) OVER {frame(5, 3)} END', 'sent_trend3')} FROM joined",
    )
)
def news_trend(spark, sf_dir):
    got = with_news(spark, sf_dir).select("symbol", "open_time", F.col("all_sent_trend3").alias("sent_trend3"))
    return timed(rounded(got, "sent_trend3"), "open_time")


TABLE_COLUMNS = [*PRICE_COLUMNS, "all_sent_mean", "all_news_intensity", "all_neg_share", "all_sent_lag1", "all_sent_max6", "all_sent_min6", "all_sent_std6", "all_sent_trend3"]
TABLE = FEATURES + ", " + HOURLY + f""", joined AS (SELECT g.*, coalesce(h.n, 0) AS n, coalesce(h.sent_mean, 0.0) AS s, coalesce(h.neg_share, 0.0) AS neg
  FROM price g LEFT JOIN hourly h ON h.hour = g.open_time),
feat AS (SELECT *, s AS all_sent_mean, ln(1 + n) - ln(1 + coalesce(avg(n) OVER {frame(168, 1)}, 0)) AS all_news_intensity, neg AS all_neg_share,
  lag(s) OVER (PARTITION BY symbol ORDER BY open_time) AS all_sent_lag1, {guarded("s", "max(s) OVER {w}", 6)} AS all_sent_max6, {guarded("s", "min(s) OVER {w}", 6)} AS all_sent_min6,
  {guarded("s", "stddev_samp(s) OVER {w}", 6)} AS all_sent_std6, CASE WHEN count(s) OVER {frame(5, 3)} = 3 THEN avg(s) OVER {frame(2)} - avg(s) OVER {frame(5, 3)} END AS all_sent_trend3 FROM joined),
full_table AS (SELECT *, {" AND ".join(f"{c} IS NOT NULL" for c in [*TABLE_COLUMNS, "target"])} AS valid FROM feat)"""


def model_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price and news features, target and valid for every hour of every symbol."""
    rows = features.news_on_grid(priced(spark, sf_dir), features.hourly_news(roles.headlines(spark, sf_dir)))
    return features.news_features(rows, "all").withColumn("valid", features.valid([*TABLE_COLUMNS, "target"]))


@query(sql(TABLE, f"SELECT symbol, {T('open_time', 'open_time')}, " + ", ".join(R(c, c) for c in [*TABLE_COLUMNS, "target"]) + ", valid FROM full_table"))
def feature_table(spark, sf_dir):
    got = model_table(spark, sf_dir).select("symbol", "open_time", *TABLE_COLUMNS, "target", "valid")
    return timed(rounded(got, *TABLE_COLUMNS, "target"), "open_time")


SUMMARY = ["ret_lag1", "rv_6", "volume_change", "all_sent_mean", "all_news_intensity"]


@query(
    sql(
        TABLE,
        " UNION ALL ".join(
            f"SELECT symbol, '{c}' AS feature, {R(f'avg({c})', 'mean')}, {R(f'stddev_samp({c})', 'std')}, {R(f'min({c})', 'min')}, {R(f'max({c})', 'max')}, {R(f'avg(CASE WHEN {c} = 0 THEN 1.0 ELSE 0.0 END)', 'zero_share')} FROM full_table WHERE valid GROUP BY symbol"
            for c in SUMMARY
        ),
    )
)
def feature_summary(spark, sf_dir):
    rows = model_table(spark, sf_dir).filter("valid").unpivot(["symbol", "open_time"], SUMMARY, "feature", "v")
    got = rows.groupBy("symbol", "feature").agg(
        F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg((F.col("v") == 0).cast("double")).alias("zero_share")
    )
    return rounded(got, "mean", "std", "min", "max", "zero_share")


@query(
    sql(
        GRID + ", " + NEWS + ", c AS (SELECT lang, date_trunc('hour', published) AS hour, count(*) AS n FROM news GROUP BY 1, 2), h AS (SELECT DISTINCT open_time FROM hours), l AS (SELECT DISTINCT lang FROM news)",
        f"SELECT l.lang, strftime(h.open_time, '%Y-%m') AS period, count(*) AS hours, {R('avg(CASE WHEN c.n > 0 THEN 1.0 ELSE 0.0 END)', 'share')} FROM h CROSS JOIN l LEFT JOIN c ON c.lang = l.lang AND c.hour = h.open_time GROUP BY 1, 2",
    )
)
def coverage_by_period(spark, sf_dir):
    news = roles.headlines(spark, sf_dir)
    per = news.groupBy("lang", F.date_trunc("hour", "published").alias("open_time")).agg(F.count(F.lit(1)).alias("n"))
    hours = full_grid(spark, sf_dir).select("open_time").distinct()
    rows = hours.crossJoin(F.broadcast(news.select("lang").distinct())).join(per, ["lang", "open_time"], "left")
    got = rows.groupBy("lang", F.date_format("open_time", "yyyy-MM").alias("period")).agg(F.count(F.lit(1)).alias("hours"), F.avg(F.coalesce(F.col("n") > 0, F.lit(False)).cast("double")).alias("share"))
    return rounded(got, "share")


@query(sql(NEWS, f"SELECT source, {T('''date_trunc('hour', published)''', 'hour')}, count(*) AS n FROM news GROUP BY source, date_trunc('hour', published) ORDER BY n DESC, source, hour LIMIT 5"))
def busiest_hours(spark, sf_dir):
    got = roles.headlines(spark, sf_dir).groupBy("source", F.date_trunc("hour", "published").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return timed(got.orderBy(F.desc("n"), "source", "hour").limit(5), "hour")


@query(
    sql(
        TAGGED,
        """SELECT 'own_or_general' AS rule, count(*) FILTER (WHERE tag_a OR NOT (tag_a OR tag_b)) AS n FROM tagged UNION ALL
        SELECT 'own_only', count(*) FILTER (WHERE tag_a) FROM tagged UNION ALL SELECT 'all', count(*) FROM tagged""",
    )
)
def asset_rule_filter(spark, sf_dir):
    news, out = roles.tagged_headlines(spark, sf_dir).drop("title"), None
    for rule in features.RULES:
        part = features.for_asset(news, "tag_a", ["tag_a", "tag_b"], rule).agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    sql(
        FEATURES + ", s AS (SELECT symbol, open_time, target, lag(ret_lag1, 3) OVER w AS ret_lag1, lag(rv_6, 3) OVER w AS rv_6 FROM price WINDOW w AS (PARTITION BY symbol ORDER BY open_time))",
        f"SELECT symbol, {T('open_time', 'open_time')}, {R('ret_lag1', 'ret_lag1')}, {R('rv_6', 'rv_6')}, ret_lag1 IS NOT NULL AND rv_6 IS NOT NULL AND target IS NOT NULL AS valid FROM s",
    )
)
def shifted_features(spark, sf_dir):
    got = features.shifted(priced(spark, sf_dir), ["ret_lag1", "rv_6"], 3, ["ret_lag1", "rv_6", "target"]).select("symbol", "open_time", "ret_lag1", "rv_6", "valid")
    return timed(rounded(got, "ret_lag1", "rv_6"), "open_time")


@query(
    sql(
        FEATURES + f", v AS (SELECT symbol, open_time, CASE WHEN ret_lag1 IS NOT NULL AND target IS NOT NULL THEN 1 ELSE 0 END AS ok FROM price), c AS (SELECT symbol, open_time, count(ok) OVER {frame(11)} = 12 AND min(ok) OVER {frame(11)} = 1 AS complete FROM v)",
        "SELECT symbol, count(*) AS hours, count(*) FILTER (WHERE complete) AS windows FROM c GROUP BY symbol",
    )
)
def complete_windows(spark, sf_dir):
    ok = F.col("ret_lag1").isNotNull() & F.col("target").isNotNull()
    rows = priced(spark, sf_dir).withColumn("complete", features.complete_windows(ok, 12, features.by_time()))
    return rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("hours"), F.count_if("complete").alias("windows"))


@query(
    sql(
        RETURNS + ", wide AS (SELECT open_time, " + ", ".join(f"max(round_even(exp(ret) - 1, 4)) FILTER (WHERE symbol = '{s}') AS {s}" for s in SYMBOLS) + " FROM ret GROUP BY open_time)",
        f"SELECT {T('open_time', 'open_time')}, " + ", ".join(R(s, s) for s in SYMBOLS) + " FROM wide WHERE greatest(" + ", ".join(f"abs(coalesce({s}, 0))" for s in SYMBOLS) + ") > 20",
    )
)
def large_moves(spark, sf_dir):
    rows = priced(spark, sf_dir).select("symbol", "open_time", F.col("ret_lag1").alias("ret"))
    return timed(rounded(validate.large_moves(rows, 20.0, SYMBOLS), *SYMBOLS), "open_time")


@query(
    sql(
        RETURNS + """, r AS (SELECT symbol, open_time, ret, lag(ret) OVER (PARTITION BY symbol ORDER BY open_time) AS before FROM ret WHERE ret IS NOT NULL)""",
        f"SELECT symbol, count(*) AS n, {R('avg(ret)', 'mean')}, {R('stddev_samp(ret)', 'std')}, {R('min(ret)', 'min')}, {R('max(ret)', 'max')}, {R('skewness(ret)', 'skew')}, {R('kurtosis(ret)', 'kurt')}, "
        f"{R('avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END)', 'share_up')}, {R('avg(CASE WHEN ret = 0 THEN 1.0 ELSE 0.0 END)', 'share_zero')}, {R('corr(ret, before)', 'autocorr')}, {R('stddev_samp(ret) * sqrt(8760)', 'annual_vol')} FROM r GROUP BY symbol",
    )
)
def return_descriptives(spark, sf_dir):
    got = describe_returns(priced(spark, sf_dir).select("symbol", "open_time", F.col("ret_lag1").alias("ret")))
    return rounded(got, *[c for c in got.columns if c not in ("symbol", "n")])


@query(
    sql(
        RETURNS + ", b AS (SELECT symbol, open_time, " + ", ".join(f"lag(ret, {k}) OVER w AS ret_{k}" if k else "ret AS ret_0" for k in range(4)) + " FROM ret WINDOW w AS (PARTITION BY symbol ORDER BY open_time))",
        f"SELECT symbol, {T('open_time', 'open_time')}, " + ", ".join(R(f"ret_{k}", f"ret_{k}") for k in range(4)) + " FROM b",
    )
)
def granger_design(spark, sf_dir):
    rows = priced(spark, sf_dir).select("symbol", "open_time", F.col("ret_lag1").alias("ret"))
    got = features.lag_block(rows, ["ret"], 4).drop("ret")
    return timed(rounded(got, *[f"ret_{k}" for k in range(4)]), "open_time")


@query(
    sql(
        GRID + """, m AS (SELECT date_trunc('month', l_shipdate) AS open_time, l_returnflag AS symbol, sum(l_extendedprice * (1 - l_discount)) AS close FROM lineitem GROUP BY 1, 2)""",
        f"SELECT symbol, {T('open_time', 'open_time')}, {R('close', 'close')}, {R('ln(close) - lag(ln(close)) OVER (PARTITION BY symbol ORDER BY open_time)', 'ret')} FROM m",
    )
)
def monthly_revenue_returns(spark, sf_dir):
    """A long series: monthly revenue by return flag and its log changes."""
    items = roles.table(spark, sf_dir, "lineitem")
    rows = items.groupBy(F.date_trunc("month", F.col("l_shipdate").cast("timestamp")).alias("open_time"), F.col("l_returnflag").alias("symbol")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("close"))
    got = rows.withColumn("ret", features.log_return(F.col("close"), features.by_time()))
    return timed(rounded(got, "close", "ret"), "open_time")
