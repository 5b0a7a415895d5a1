"""Grids and features on hand-made candles."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomline.operators import features, grid, validate

T0 = datetime(2024, 1, 1)
HOUR = timedelta(hours=1)


def candles(spark, closes, symbol="a", start=T0):
    rows = [(symbol, start + i * HOUR, *([float(c)] * 4 if c is not None else [None] * 4), 10.0 + i, 1) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, open_time timestamp, open double, high double, low double, close double, volume double, trades long")


def values(df, column, order="open_time"):
    return [r[column] for r in df.orderBy(order).collect()]


def test_ohlc_order_and_ties(spark):
    rows = [("a", T0 + timedelta(minutes=5), 2, 7.0), ("a", T0 + timedelta(minutes=5), 1, 5.0), ("a", T0 + timedelta(minutes=50), 3, 6.0), ("a", T0 + timedelta(minutes=60), 4, 1.0)]
    got = grid.ohlc(spark.createDataFrame(rows, "symbol string, ts timestamp, event_id long, price double")).orderBy("open_time").collect()
    assert [(r.open, r.high, r.low, r.close, r.trades) for r in got] == [(5.0, 7.0, 5.0, 6.0, 3), (1.0, 1.0, 1.0, 1.0, 1)]


def test_regrid_and_gaps(spark):
    full = candles(spark, range(1, 11))
    some = full.filter(~F.hour("open_time").isin(3, 4, 5, 8))
    whole = grid.regrid(some)
    assert whole.count() == 10
    got = [(r.start, r.end, r.hours) for r in grid.gaps(whole).orderBy("start").collect()]
    assert got == [(T0 + 3 * HOUR, T0 + 5 * HOUR, 3), (T0 + 8 * HOUR, T0 + 8 * HOUR, 1)]
    assert grid.coverage(whole).first().missing_share == 0.4


def test_off_grid_rows_vanish_but_are_counted(spark):
    rows = candles(spark, [1, 2]).unionByName(candles(spark, [9], start=T0 + timedelta(minutes=30)))
    assert grid.off_grid(rows).first().off_grid == 1
    assert grid.regrid(rows).count() == 2


def test_price_features(spark):
    rows = candles(spark, [math.exp(0.01 * i * i) for i in range(30)])
    got = features.price_features(rows).orderBy("open_time").collect()
    ret = [None] + [0.01 * (2 * i - 1) for i in range(1, 30)]
    assert got[0].ret_lag1 is None and got[1].ret_lag1 == pytest.approx(ret[1])
    assert got[10].ret_lag3 == pytest.approx(ret[8]) and got[10].target == pytest.approx(ret[11])
    assert got[5].rv_6 is None and got[6].rv_6 == pytest.approx(math.sqrt(sum(r * r for r in ret[1:7])))
    assert got[23].rv_24 is None and got[24].rv_24 is not None and got[29].target is None
    assert got[1].volume_change == pytest.approx(math.log(12 / 11))


def test_a_gap_empties_every_window_that_holds_it(spark):
    closes = [1.0 + i for i in range(20)]
    closes[10] = None
    got = features.price_features(candles(spark, closes)).orderBy("open_time").collect()
    assert [i for i, r in enumerate(got) if r.ret_lag1 is None] == [0, 10, 11]
    assert all(got[i].rv_6 is None for i in range(10, 17)) and got[17].rv_6 is not None


def test_hour_rule(spark):
    rows = [(T0 + timedelta(hours=10, minutes=59, seconds=59), 1.0, "negative"), (T0 + timedelta(hours=11), 0.0, "positive"), (T0 + timedelta(hours=11, seconds=1), -1.0, "negative")]
    got = {r.hour.hour: r for r in features.hourly_news(spark.createDataFrame(rows, "published timestamp, score double, label string")).collect()}
    assert (got[10].n, got[10].sent_mean, got[10].neg_share) == (1, 1.0, 1.0)
    assert (got[11].n, got[11].sent_mean, got[11].neg_share) == (2, -0.5, 0.5)


def test_asset_rules(spark):
    news = spark.createDataFrame([(1, True, False), (2, False, True), (3, False, False), (4, True, True)], "id int, a boolean, b boolean")
    ids = lambda rule: sorted(r.id for r in features.for_asset(news, "a", ["a", "b"], rule).collect())
    assert (ids("own_or_general"), ids("own_only"), ids("all")) == ([1, 3, 4], [1, 4], [1, 2, 3, 4])
    with pytest.raises(ValueError):
        features.for_asset(news, "a", ["a", "b"], "other")


def hours(spark, counts, sents):
    rows = [("a", T0 + i * HOUR, n, s, None if s is None else 0.0) for i, (n, s) in enumerate(zip(counts, sents))]
    return spark.createDataFrame(rows, "symbol string, open_time timestamp, n long, sent_mean double, neg_share double")


def test_news_features(spark):
    s = [0.1, 0.5, None, -0.2, 0.4, 0.3, 0.9, -0.7]
    got = features.news_features(hours(spark, [1, 3, 0, 1, 1, 2, 5, 1], s), "x").orderBy("open_time").collect()
    assert got[2].x_sent_mean == 0.0 and got[3].x_sent_lag1 == 0.0 and got[0].x_sent_lag1 is None
    assert got[4].x_sent_max6 is None and got[5].x_sent_max6 == 0.5 and got[7].x_sent_min6 == -0.7
    assert got[5].x_sent_trend3 == pytest.approx((-0.2 + 0.4 + 0.3) / 3 - (0.1 + 0.5 + 0.0) / 3) and got[4].x_sent_trend3 is None
    assert got[0].x_news_intensity == pytest.approx(math.log(2)) and got[6].x_news_intensity == pytest.approx(math.log(6) - math.log(1 + 8 / 6))


def test_later_news_leaves_earlier_rows_unchanged(spark):
    base, sents = [i % 4 for i in range(60)], [(i % 7 - 3) / 10 for i in range(60)]
    more = base[:40] + [n + 9 for n in base[40:]]
    a, b = (features.news_features(hours(spark, c, sents), "x").orderBy("open_time").limit(40).collect() for c in (base, more))
    assert a == b


def test_complete_windows_and_shift(spark):
    rows = features.price_features(candles(spark, [1 + i for i in range(12)]))
    got = features.shifted(rows, ["ret_lag1"], 2, ["ret_lag1", "target"])
    assert values(got, "ret_lag1")[3] == values(rows, "ret_lag1")[1] and values(got, "valid")[:3] == [False] * 3
    done = rows.withColumn("w", features.complete_windows(F.col("ret_lag1").isNotNull(), 3, features.by_time()))
    assert values(done, "w") == [False] * 3 + [True] * 9
    assert features.warmup_hours() == 169 and len(features.feature_columns(["en", "ru"])) == 25


def test_earlier_time_is_by_the_clock(spark):
    rows = candles(spark, [1, 2, 4]).filter("close <> 2")
    got = features.at_earlier_time(rows.select("symbol", "open_time"), rows.select("symbol", "open_time", "close"), "close", 2)
    assert values(got, "close_at") == [0.0, 1.0]


def test_violations(spark):
    bad = candles(spark, [1.0, 2.0, 3.0]).withColumn("high", F.when(F.col("close") == 2, 1.0).otherwise(F.col("high"))).withColumn("open", F.when(F.col("close") == 3, -1.0).otherwise(F.col("open")))
    got = {r.check: r.violations for r in validate.candle_violations(bad).collect()}
    assert got == {"repeated_time": 0, "irregular_step": 0, "not_positive": 1, "high_below_low": 1, "open_outside": 2, "close_outside": 1, "too_many_missing": 0}
    with pytest.raises(ValueError, match="high_below_low"):
        validate.require(validate.candle_violations(bad), "candles")
    validate.require(validate.candle_violations(candles(spark, [1.0, 2.0])), "candles")


def test_sample_period(spark):
    news = spark.createDataFrame([(T0 + timedelta(hours=5),)], "published timestamp")
    series = candles(spark, range(1, 97))
    got = grid.sample_period(series, {"en": news})
    assert (got.start, got.end) == (T0 + timedelta(days=1), T0 + timedelta(hours=96))
    with pytest.raises(ValueError):
        grid.sample_period(series, {"en": news}, end=T0)
