"""Splits, metrics, tests, backtests, samples and label quality against hand computations and numpy."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.operators import annotate, backtest, forecast, metrics, regression, resampling, sampling, sequence, splits, stats

T0 = datetime(2024, 1, 1)


def long_table(spark, truth, models):
    rows = [("a", m, T0 + timedelta(hours=i), float(y), float(f)) for m, fs in models.items() for i, (y, f) in enumerate(zip(truth, fs)) if f is not None]
    return spark.createDataFrame(rows, "symbol string, model string, open_time timestamp, y_true double, y_pred double")


def test_walk_forward():
    got = splits.walk_forward(datetime(2017, 8, 18), datetime(2025, 6, 1), 24, 3, 6, 24)
    assert [w.name for w in got] == ["tuning"] + [f"fold_{k:02d}" for k in range(1, 9)]
    assert got[1].test_start == datetime(2023, 6, 1) and got[-1].test_end == datetime(2025, 6, 1) and got[0].test_start == datetime(2022, 12, 1)
    assert all(w.test_start - w.train_end == timedelta(hours=24) for w in got)
    splits.check_windows(got, 24)
    assert splits.from_json(splits.to_json(got)) == got
    with pytest.raises(ValueError):
        splits.walk_forward(datetime(2017, 8, 18), datetime(2025, 6, 1), 24, 5, 6, 24)
    with pytest.raises(ValueError):
        splits.walk_forward(datetime(2023, 1, 1), datetime(2025, 6, 1), 24, 3, 6, 24)
    with pytest.raises(ValueError):
        splits.check_windows(got, 48)


def test_common_rows_and_accuracy(spark):
    y = [0.1, -0.2, 0.0, 0.3]
    table = long_table(spark, y, {"zero": [0, 0, 0, 0], "mean": [0.1, 0.1, 0.1, 0.1], "m": [0.2, -0.1, 0.1, None]})
    assert metrics.common_rows(table).groupBy("model").count().filter("count = 3").count() == 3
    got = {r.model: r for r in metrics.accuracy(table.filter("model <> 'm'")).collect()}
    assert got["zero"].rmse == pytest.approx(math.sqrt(0.14 / 4)) and got["zero"].direction is None and got["mean"].direction == pytest.approx(2 / 3)
    assert got["zero"].r2_oos == pytest.approx(1 - 0.14 / 0.14) and got["mean"].direction_n == 3 and got["mean"].mae == pytest.approx(0.15)
    pair = metrics.pair_change(table.filter("model <> 'm'"), [("q", "zero", "mean")]).first()
    assert pair.change_pct == pytest.approx(0.0)


def test_seed_average(spark):
    rows = [("a", "m", T0, 1.0, p, s) for s, p in enumerate((1.0, 2.0, 6.0))]
    got = metrics.seed_average(spark.createDataFrame(rows, "symbol string, model string, open_time timestamp, y_true double, y_pred double, seed int")).first()
    assert got.y_pred == 3.0


def bartlett(x, lags):
    x = np.asarray(x) - np.mean(x)
    return x @ x / len(x) + sum(2 * (1 - k / (lags + 1)) * (x[k:] @ x[:-k]) / len(x) for k in range(1, lags + 1))


def test_long_run_variance_and_dm(spark):
    rng = np.random.default_rng(3)
    y = rng.normal(size=400)
    table = long_table(spark, y, {"base": np.zeros(400), "good": 0.5 * y + 0.1 * rng.normal(size=400)})
    d = y**2 - (y - np.array([r.y_pred for r in table.filter("model = 'good'").orderBy("open_time").collect()])) ** 2
    lags = stats.most_lags(400)
    diffs = stats.loss_differences(table, [("base", "good")])
    got = stats.with_p_value(stats.diebold_mariano(diffs), "dm").first()
    assert got.hac_lags == lags == 5 and got.dm == pytest.approx(d.mean() / math.sqrt(bartlett(d, lags) / 400)) and got.p_value < 1e-6
    bounds = stats.effect_bounds(diffs).first()
    assert bounds.change_pct == pytest.approx(-d.mean() / (y**2).mean() * 100) and bounds.dm == pytest.approx(got.dm) and bounds.ci_high < 0
    same = stats.diebold_mariano(stats.loss_differences(table, [("base", "base")])).first()
    assert same.dm is None
    assert stats.most_lags(17544) == 12


def test_pesaran_timmermann(spark):
    rng = np.random.default_rng(5)
    y = rng.normal(size=600)
    f = np.where(rng.random(600) < 0.6, y, -y)
    got = {r.model: r for r in stats.pesaran_timmermann(long_table(spark, y, {"m": f, "up": np.ones(600)})).collect()}
    a, b, h = (y > 0).mean(), (f > 0).mean(), ((y > 0) == (f > 0)).mean()
    p = a * b + (1 - a) * (1 - b)
    v = p * (1 - p) / 600 - ((2 * a - 1) ** 2 * b * (1 - b) + (2 * b - 1) ** 2 * a * (1 - a) + 4 * a * b * (1 - a) * (1 - b) / 600) / 600
    assert got["m"].pt == pytest.approx((h - p) / math.sqrt(v)) and got["up"].pt is None


def test_holm(spark):
    rows = [("f", i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.005, None])]
    got = stats.holm(spark.createDataFrame(rows, "family string, i int, p double"), "p", ["family"], ["i"]).orderBy("i").collect()
    assert [r.p_holm for r in got[:4]] == pytest.approx([0.03, 0.06, 0.06, 0.02]) and got[4].p_holm is None


def test_sign_test(spark):
    rows = [("a", float(c)) for c in [-1, -1, -1, -1, -1, -1, -1, 1]]
    got = stats.sign_test(spark.createDataFrame(rows, "symbol string, change double"), "change", ["symbol"]).first()
    assert (got.improved, got.total) == (7, 8) and got.p_value == pytest.approx(9 / 256)


def test_backtest(spark):
    r = [0.01, 0.02, -0.03, -0.01]
    table = long_table(spark, np.log1p(r), {"m": [1, 0, -1, 1]})
    rows = backtest.net_returns(backtest.grid(table, ["long_flat", "long_short", "buy_and_hold"], [10]), ["symbol", "model", "strategy", "cost_bp"])
    net = lambda s: [x.net for x in rows.filter(F.col("strategy") == s).orderBy("open_time").collect()]
    assert net("long_flat") == pytest.approx([0.009, -0.001, 0.0, -0.011])
    assert net("long_short") == pytest.approx([0.009, -0.001, 0.03 - 0.001, -0.01 - 0.002])
    got = {x.strategy: x for x in backtest.summary(rows, ["symbol", "model", "strategy", "cost_bp"]).collect()}
    value = np.cumprod(1 + np.array(net("long_flat")))
    assert got["long_flat"].total_return == pytest.approx(value[-1] - 1) and got["long_flat"].max_drawdown == pytest.approx((value / np.maximum.accumulate(np.maximum(value, 1)) - 1).min())
    assert got["long_flat"].time_in_market == 0.5 and got["buy_and_hold"].breakeven_bp is None
    gross = np.array([0.01, 0, 0, -0.01])
    assert got["long_flat"].breakeven_bp == pytest.approx(gross.mean() / (3 / 4) * 1e4)
    wide = backtest.sharpe_by_cost(backtest.summary(rows, ["symbol", "model", "strategy", "cost_bp"]), [10], ["symbol", "model", "strategy"])
    assert wide.count() == 3
    with pytest.raises(ValueError):
        backtest.position(F.lit(1.0), "what")


def test_selection(spark):
    rows = [("a", "zero", True, 0.5, 9.0), ("a", "m1", True, 0.1, 1.0), ("a", "m2", True, 0.2, 2.0), ("a", "m3", False, 0.3, 5.0), ("a", "m4", True, None, 7.0)]
    got = backtest.select_model(spark.createDataFrame(rows, "symbol string, model string, accurate boolean, ci_low double, sharpe double"), ["zero"]).collect()
    assert [r.model for r in got if r.chosen] == ["m2"] and {r.model for r in got if r.passes} == {"m1", "m2"}


def test_allocation_and_samples(spark):
    strata = spark.createDataFrame([("a", 60), ("b", 30), ("c", 10)], "stratum string, n long")
    assert {r.stratum: r.quota for r in sampling.allocate(strata, 7).collect()} == {"a": 4, "b": 2, "c": 1}
    rows = spark.range(300).selectExpr("id", "element_at(array('a', 'a', 'b'), cast(id % 3 as int) + 1) AS stratum")
    quotas = spark.createDataFrame([("a", 20), ("b", 10)], "stratum string, quota long")
    a, b = ({r.id for r in sampling.stratified(x, quotas, "id", 1).collect()} for x in (rows, rows.orderBy(F.desc("id")).repartition(7)))
    assert a == b and len(a) == 30 and a != {r.id for r in sampling.stratified(rows, quotas, "id", 2).collect()}
    named = sampling.numbered_sample(sampling.stratified(rows, quotas, "id", 1), "EN", "id", 1, nested=5).collect()
    assert sorted(r["id"] for r in named if r.nested) == [f"EN-{k:03d}" for k in range(1, 6)]


def test_label_quality(spark):
    pairs = [(0, 0)] * 40 + [(0, 1)] * 10 + [(1, 0)] * 20 + [(1, 1)] * 30
    frame = spark.createDataFrame(pairs, "a int, b int")
    got = annotate.agreement(frame, "a", "b").first()
    assert got.percent == 0.7 and got.kappa == pytest.approx((0.7 - 0.5) / 0.5)
    f1 = {r["class"]: r.f1 for r in annotate.f1_scores(frame, "a", "b", [0, 1, 2]).collect()}
    assert f1 == pytest.approx({0: 80 / 110, 1: 60 / 90, 2: 0.0})
    assert annotate.macro_f1(frame, "a", "b", [0, 1]).first().accuracy == 0.7
    assert {r.label: r.n for r in annotate.label_shares(frame, "a", [0, 1, 2]).collect()} == {0: 50, 1: 50, 2: 0}
    scores = spark.createDataFrame([("x", 0.5), ("y", 0.7), ("z", 0.7)], "model string, macro_f1 double")
    assert annotate.choose(scores, ["z", "y", "x"]).first().model == "z"


def test_bootstrap(spark):
    index = resampling.stationary_index(5000, 20.0, np.random.default_rng(1))
    assert ((np.diff(index) % 5000 == 1).mean()) == pytest.approx(0.95, abs=0.02)
    rng = np.random.default_rng(2)
    base = rng.normal(0, 0.01, 500)
    series = {"hold": base, "better": base + 0.004, "same": base, "flat": np.zeros(500)}
    rows = [("a", n, T0 + timedelta(hours=i), float(x)) for n, v in series.items() for i, x in enumerate(v)]
    net = spark.createDataFrame(rows, "symbol string, name string, open_time timestamp, net double")
    got = {r.name: r for r in resampling.sharpe_interval(net, "hold", reps=120, chunk=50).collect()}
    assert set(got) == {"better", "same"} and got["better"].ci_low > 0 and got["same"].ci_low == 0 and got["better"].reps == 120
    again = {r.name: r for r in resampling.sharpe_interval(net.repartition(5), "hold", reps=120, chunk=17).collect()}
    assert again["better"].ci_low == pytest.approx(got["better"].ci_low)


def test_draws_from_prefix_sums():
    """A draw's sums over blocks are those over its positions, for blocks longer than the ring too."""
    rng = np.random.default_rng(3)
    for n, mean_block in ((1, 24.0), (2, 5.0), (37, 1.0), (300, 24.0), (50, 500.0)):
        x = rng.normal(size=(2, n)) + 0.1
        got = resampling.drawn_sums(x, range(7, 30), mean_block, 5)
        for i, rep in enumerate(range(7, 30)):
            index = resampling.stationary_index(n, mean_block, np.random.default_rng([5, rep]))
            assert len(index) == n and index.min() >= 0 and index.max() < n
            assert got[:, i] == pytest.approx(x[:, index].sum(axis=1), abs=1e-10)
    x = rng.normal(0.001, 0.01, 400)
    point, got = resampling.drawn_sharpes(x, range(40), 24.0, 1, 8760.0)
    assert point == pytest.approx(x.mean() / x.std(ddof=1) * np.sqrt(8760))
    for rep in range(40):
        drawn = x[resampling.stationary_index(400, 24.0, np.random.default_rng([1, rep]))]
        assert got[rep] == pytest.approx(drawn.mean() / drawn.std(ddof=1) * np.sqrt(8760), rel=1e-9)
    assert np.isnan(resampling.drawn_sharpes(np.full(50, 0.1), range(3), 24.0, 1, 8760.0)[1]).all()


def confidence_set(losses: np.ndarray, alpha: float, reps: int, mean_block: float, seed: int) -> dict[int, tuple[float, bool]]:
    """The definition: all draws by their positions, all pairs of the models left at every step."""
    n, m = losses.shape
    means = np.array([losses[resampling.stationary_index(n, mean_block, np.random.default_rng([seed, r]))].mean(axis=0) for r in range(reps)])
    mean, alive, out, p = losses.mean(axis=0), list(range(m)), {}, 0.0
    while len(alive) > 1:
        d = mean[alive][:, None] - mean[alive][None, :]
        v = (means - mean)[:, alive]
        db = v[:, :, None] - v[:, None, :]
        sd = np.sqrt((db**2).mean(axis=0))
        np.fill_diagonal(sd, 1)
        p = max(p, float((np.abs(db / sd).max(axis=(1, 2)) >= np.abs(d / sd).max()).mean()))
        out[alive.pop(int((d / sd).max(axis=1).argmax()))] = (p, p >= alpha)
    return out | {alive[0]: (1.0, True)}


def test_confidence_set(spark):
    """Spread over chunks it equals the definition; one model alone stays; equal models don't part."""
    rng = np.random.default_rng(0)
    errors = {"many": np.abs(rng.normal(size=(300, 6))) + np.array([0, 0.02, 0.05, 0.1, 0.3, 0]), "twin": np.repeat(np.abs(rng.normal(size=(60, 1))), 2, axis=1), "one": rng.normal(size=(40, 1))}
    rows = [(s, f"m{j}", T0 + timedelta(hours=i), 0.0, float(x[i, j])) for s, x in errors.items() for i in range(len(x)) for j in range(x.shape[1])]
    table = spark.createDataFrame(rows, "symbol string, model string, open_time timestamp, y_true double, y_pred double")
    found = {chunk: {(r.symbol, r.model): (r.p_value, r.kept) for r in resampling.model_confidence_set(table.repartition(3), 0.1, 200, 10.0, 1, chunk=chunk).collect()} for chunk in (30, 200)}
    assert found[30] == found[200] and len(found[30]) == 9
    want = confidence_set(errors["many"] ** 2, 0.1, 200, 10.0, 1)
    assert {int(m[1:]): v for (s, m), v in found[30].items() if s == "many"} == want and not want[4][1]
    assert found[30]["one", "m0"] == (1.0, True) and all(found[30]["twin", m] == (1.0, True) for m in ("m0", "m1"))


def test_confidence_set_wants_equal_hours(spark):
    rows = [("a", m, T0 + timedelta(hours=i), 0.0, float(i)) for m, n in (("x", 5), ("y", 6)) for i in range(n)]
    table = spark.createDataFrame(rows, "symbol string, model string, open_time timestamp, y_true double, y_pred double")
    with pytest.raises(Exception, match="different numbers of hours"):
        resampling.model_confidence_set(table, reps=20).collect()


def test_f1_interval_over_patterns(spark):
    """Two models and two classes give at most 16 patterns, whose weights have the distribution of drawn items."""
    rng = np.random.default_rng(4)
    truth = (rng.random(1500) < 0.3).astype(int)
    guess = {"a": np.where(rng.random(1500) < 0.8, truth, 1 - truth), "b": np.ones(1500, int)}
    rows = [(i, m, int(truth[i]), int(g[i])) for m, g in guess.items() for i in range(1500)]
    pairs = spark.createDataFrame(rows, "item long, model string, truth int, predicted int").repartition(4)
    patterns = resampling.cell_patterns(pairs, "truth", "predicted", "model").collect()
    assert len(patterns) == 4 and sum(r.n for r in patterns) == 1500

    def f1(t, g):
        return np.mean([2 * ((t == c) & (g == c)).sum() / max(1, (t == c).sum() + (g == c).sum()) for c in (0, 1)])

    got = {r.model: r for r in resampling.f1_interval(pairs, "truth", "predicted", "model", [0, 1], reps=600, seed=3).collect()}
    for m, g in guess.items():
        draws = [f1(truth[at], g[at]) for at in rng.integers(0, 1500, (600, 1500))]
        assert got[m].macro_f1 == pytest.approx(f1(truth, g))
        assert [got[m].ci_low, got[m].ci_high] == pytest.approx(np.percentile(draws, [2.5, 97.5]), abs=0.012)


def test_regressions(spark):
    assert regression.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05) and regression.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05) and regression.chi2_sf(0, 3) == 1
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 2))
    y = x[:, 0] + rng.normal(size=500)
    design = np.column_stack([np.ones(500), x])
    beta, cov, e = regression.hac_ols(y, design, 0)
    inv = np.linalg.inv(design.T @ design)
    assert np.allclose(cov, inv @ (design.T * e**2) @ design @ inv) and beta[1] == pytest.approx(1, abs=0.15)
    cause = rng.normal(size=1500)
    own = 0.5 * np.roll(cause, 3) + rng.normal(size=1500)
    rows = [("a", T0 + timedelta(hours=i), float(a), float(b)) for i, (a, b) in enumerate(zip(own, cause))]
    frame = spark.createDataFrame(rows, "symbol string, open_time timestamp, own double, cause double")
    table = frame.selectExpr("*", "lead(own) over (partition by symbol order by open_time) AS target", "true AS valid")
    rows = regression.granger(table, ["symbol"], "own", ["cause"], lags=(3,), most=6, test_start=T0 + timedelta(hours=frame.count() // 2)).collect()
    got = {(r.direction, r.sample, r.rule): r for r in rows}
    assert len(rows) == 8 and got["news to return", "full", "bic"].lags == 3 and got["news to return", "test", "fixed"].p_value < 1e-6
    assert got["return to news", "full", "fixed"].p_value > 0.001 and got["return to news", "full", "fixed"].df == 3
    walk = spark.createDataFrame([("walk", T0 + timedelta(hours=i), float(v)) for i, v in enumerate(np.cumsum(rng.normal(size=800)))] + [("noise", T0 + timedelta(hours=i), float(v)) for i, v in enumerate(rng.normal(size=800))], "s string, open_time timestamp, v double")
    p = {r.s: r.p_value for r in regression.adf(walk, ["s"], "v", most=6).collect()}
    assert p["noise"] < 0.01 < p["walk"]
    assert regression.adf_p_value(-2.86) == pytest.approx(0.05, abs=0.003)


@pytest.mark.parametrize("hours", [4096, 7])
def test_moments_of_blocks_give_the_whole_regression(spark, monkeypatch, hours):
    """Blocks of any length, also shorter than the lags, against one matrix; rows arrive in no order."""
    monkeypatch.setattr(regression, "HOURS", hours)
    rng = np.random.default_rng(7)
    data = rng.normal(size=(300, 3)).cumsum(axis=0) * 0.1 + rng.normal(size=(300, 3))
    late = np.cumsum(rng.choice([1, 1, 1, 30], 300))
    rows = [("a", T0 + timedelta(hours=int(t)), *map(float, v)) for t, v in zip(late, data)] + [("b", T0 + timedelta(hours=i), float(i % 5), 2.0, float(i)) for i in range(40)]
    rows += [("c", T0, 1.0, 2.0, 3.0), ("a", T0 - timedelta(hours=5), None, 1.0, 2.0)]
    frame = spark.createDataFrame(rows, "s string, open_time timestamp, y double, x1 double, x2 double").repartition(7)
    got = {r.s: r for r in regression.hac_wald(frame, ["s"], "y", ["x1", "x2"], ["x1", "x2"]).collect()}
    beta, cov, _ = regression.hac_ols(data[:, 0], np.column_stack((np.ones(300), data[:, 1:])), 5)
    assert set(got) == {"a", "b"} and got["a"].n == 300 and got["a"].wald == pytest.approx(regression.wald(beta, cov, np.array([1, 2]))[0], rel=1e-9)
    assert got["b"].wald is None and got["b"].p_value is None  # a constant column doesn't determine its slope
    one = {r.s: r for r in regression.hac_wald(frame, ["s"], "y", ["x1", "x2"], ["x2"]).collect()}
    assert one["b"].wald is not None and one["b"].df == 1
    assert regression.hac_wald(frame.filter("false"), ["s"], "y", ["x1"], ["x1"]).count() == 0


@pytest.mark.parametrize("hours", [4096, 24])
def test_granger_equals_separate_regressions(spark, monkeypatch, hours):
    monkeypatch.setattr(regression, "HOURS", hours)
    rng = np.random.default_rng(8)
    n = 260
    own, cause = rng.normal(size=n), rng.normal(size=n)
    own[50:53] = np.nan
    rows = [("a", T0 + timedelta(hours=i), None if own[i] != own[i] else float(own[i]), float(cause[i])) for i in range(n)]
    frame = spark.createDataFrame(rows, "symbol string, open_time timestamp, own double, cause double")
    table = frame.selectExpr("*", "lead(own) over (partition by symbol order by open_time) AS target", "own is not null AS valid").repartition(5)
    start = T0 + timedelta(hours=120)
    got = {(r.direction, r.sample, r.rule, r.lags): r for r in regression.granger(table, ["symbol"], "own", ["cause"], lags=(1, 3), most=4, test_start=start).collect()}

    def design(y, series, p, sample):
        lagged = lambda v, k: np.concatenate((np.full(k, np.nan), v[: n - k]))
        x = np.column_stack([np.ones(n), *(lagged(v, k) for v in series for k in range(p))])
        ok = np.isfinite(y) & np.isfinite(x).all(axis=1) & (np.arange(n) >= (120 if sample == "test" else 0))
        return y[ok], x[ok]

    ahead = np.append(own[1:], np.nan)
    for direction, y, series in (("news to return", np.where(np.isfinite(own), ahead, np.nan), (own, cause)), ("return to news", np.append(cause[1:], np.nan), (cause, own))):
        for sample in ("full", "test"):
            for p in (1, 3):
                a, x = design(y, series, p, sample)
                beta, cov, _ = regression.hac_ols(a, x, stats.most_lags(len(a)))
                r = got[direction, sample, "fixed", p]
                assert r.n == len(a) and r.wald == pytest.approx(regression.wald(beta, cov, np.arange(1 + p, 1 + 2 * p))[0], rel=1e-8)
            common = np.isfinite(design(y, series, 4, sample)[1]).all(axis=1)
            full = design(y, series, 4, sample)
            bic = []
            for p in range(1, 5):
                x = full[1][:, [0, *range(1, 1 + p), *range(5, 5 + p)]]
                e = full[0] - x @ np.linalg.lstsq(x, full[0], rcond=None)[0]
                bic.append((len(x) * math.log(e @ e / len(x)) + x.shape[1] * math.log(len(x)), p))
            assert common.all() and (direction, sample, "bic", min(bic)[1]) in got
    assert len(got) == 12


def panel(spark, n=400):
    rng = np.random.default_rng(2)
    x = rng.normal(size=n)
    y = 0.5 * x + 0.1 * rng.normal(size=n)
    rows = [("a", T0 + timedelta(hours=i), float(x[i]), float(x[i]), float(y[i]), True) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, open_time timestamp, x double, ret_lag1 double, target double, valid boolean")


def test_learned_forecasts_keep_to_the_past(spark):
    table = panel(spark)
    window = splits.Window("f", T0 + timedelta(hours=280), T0 + timedelta(hours=300), T0 + timedelta(hours=400))
    for adapter, params in ((forecast.forest, {"trees": 5, "depth": 4, "leaf": 5}), (forecast.boosting, {"rounds": 5})):
        got = adapter(table, ["x"], window, params, 1)
        assert got.count() == 100 and got.agg(F.corr("y_true", "y_pred")).first()[0] > 0.7
        other = table.withColumn("target", F.when(F.col("open_time") >= F.lit(window.train_end), 99.0).otherwise(F.col("target")))
        a, b = ([r.y_pred for r in f.orderBy("open_time").collect()] for f in (got, adapter(other, ["x"], window, params, 1)))
        assert a == b
    done = forecast.run(table, ["x"], [window], forecast.forest, {"trees": 2}, seeds=(1, 2))
    assert {(r.fold, r.seed) for r in done.select("fold", "seed").distinct().collect()} == {(window.name, 1), (window.name, 2)}
    best, tried = forecast.tune(table, ["x"], window, forecast.forest, {"trees": [2], "depth": [1, 5], "leaf": [5]})
    assert best["depth"] == 5 and len(tried) == 2
    got = forecast.arma(table, [window], orders=((0, 0), (1, 0)))
    assert got.count() == 100 and got.filter("y_pred is null").count() == 0
    assert forecast.arma(table, [window], orders=((0, 0),), exog=["x"]).count() == 100


def test_permutation_keeps_values(spark):
    table = panel(spark, 50)
    mixed = resampling.permuted(table, ["x"], ["symbol"], 3)
    xs = lambda t: [r.x for r in t.orderBy("open_time").collect()]
    assert sorted(xs(mixed)) == sorted(xs(table)) and xs(mixed) != xs(table)


def test_describe_returns(spark):
    v = [0.1, -0.2, 0.4, 0.05, 0.0]
    frame = spark.createDataFrame([("a", T0 + timedelta(hours=i), x) for i, x in enumerate(v)], "symbol string, open_time timestamp, ret double")
    got = metrics.describe_returns(frame).first()
    x, n = np.array(v) - np.mean(v), 5
    g1 = (x**3).mean() / (x**2).mean() ** 1.5
    g2 = (x**4).mean() / (x**2).mean() ** 2 - 3
    assert got.skew == pytest.approx(g1 * math.sqrt(n * (n - 1)) / (n - 2)) and got.kurt == pytest.approx(((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3)))


def test_lstm_gradients_and_fit(spark):
    rng = np.random.default_rng(0)
    weights, x, y = sequence.initial(3, 4, rng), rng.normal(size=(5, 6, 3)), rng.normal(size=5)
    loss = lambda: float(((sequence.predict(weights, x) - y) ** 2).mean())
    for w, g in zip(weights, sequence.gradients(weights, x, y)):
        for at in [(0, 0), (w.shape[0] - 1, 0), (w.shape[0] // 2, w.shape[1] - 1)]:
            old, eps = w[at], 1e-6
            w[at] = old + eps
            up = loss()
            w[at] = old - eps
            down = loss()
            w[at] = old
            assert g[at] == pytest.approx((up - down) / (2 * eps), rel=1e-4, abs=1e-8)
    window = splits.Window("f", T0 + timedelta(hours=280), T0 + timedelta(hours=300), T0 + timedelta(hours=400))
    got = sequence.lstm(panel(spark), ["x"], window, {"lookback": 3, "hidden": 8, "epochs": 25, "rate": 0.02}, 1)
    assert got.count() == 100 and got.agg(F.corr("y_true", "y_pred")).first()[0] > 0.8


def test_a_run_goes_on_where_it_stopped(spark, tmp_path):
    table = panel(spark)
    hours = sorted(r.open_time for r in table.select("open_time").distinct().collect())
    cut = [hours[len(hours) * k // 4] for k in (2, 3)] + [hours[-1]]
    windows = [splits.Window(f"fold_{k}", cut[k], cut[k], cut[k + 1]) for k in range(2)]
    asked = []

    def adapter(table, columns, window, params, seed):
        asked.append((window.name, seed))
        if len(asked) == 3:
            raise RuntimeError("lost")
        return forecast.test_rows(table, window).selectExpr("symbol", "open_time", "target AS y_true", "'m' AS model", f"target * {seed} AS y_pred")

    go = lambda **k: forecast.run_stored(table, ["x"], windows, adapter, {}, f"{tmp_path}/m", seeds=(1, 2), **k)
    with pytest.raises(RuntimeError):
        go()
    got = go()
    assert asked == [("fold_0", 1), ("fold_0", 2), ("fold_1", 1), ("fold_1", 1), ("fold_1", 2)]
    assert {(r.fold, r.seed) for r in got.collect()} == {(f"fold_{k}", s) for k in (0, 1) for s in (1, 2)}
    n = got.count()
    assert go(restart=True).count() == n and len(asked) == 9 and len(list(tmp_path.iterdir())) == 2
