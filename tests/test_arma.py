"""ARMA by exact likelihood, against the multivariate normal density and known series."""

from datetime import timedelta

import numpy as np
import pytest

from loomline.operators import arma, forecast, splits

from .test_evaluation import T0


def covariances(ar, ma, n, far=4000):
    """Autocovariances of unit-variance shocks from the moving-average form."""
    psi = np.zeros(far)
    psi[0] = 1
    for k in range(1, far):
        psi[k] = (ma[k - 1] if k <= len(ma) else 0) + sum(ar[i] * psi[k - 1 - i] for i in range(min(len(ar), k)))
    return np.array([psi[: far - k] @ psi[k:] for k in range(n)])


def normal(y, x, ar, ma):
    """(log-likelihood, beta, variance) at their best beta and variance, by the whole covariance matrix."""
    seen = np.isfinite(y)
    gamma = covariances(ar, ma, len(y))
    cov = gamma[np.abs(np.arange(len(y))[:, None] - np.arange(len(y)))][np.ix_(seen, seen)]
    y, x, inverse, n = y[seen], x[seen], np.linalg.inv(cov), seen.sum()
    beta = np.linalg.solve(x.T @ inverse @ x, x.T @ inverse @ y)
    e = y - x @ beta
    variance = e @ inverse @ e / n
    return -0.5 * (n * (np.log(2 * np.pi * variance) + 1) + np.linalg.slogdet(cov)[1]), beta, variance


@pytest.mark.parametrize("p, q", arma.ORDERS)
@pytest.mark.parametrize("gaps", [(), (0, 7, 8, 9, 40), tuple(range(100, 111))])
def test_likelihood_equals_the_normal_density(p, q, gaps):
    rng = np.random.default_rng(10 * p + q)
    y, x = rng.normal(size=220) + 1, np.column_stack((np.ones(220), rng.normal(size=220)))
    y[list(gaps)] = np.nan
    u = rng.normal(size=(3, p + q)) * 0.7
    ar, ma = arma.coefficients(u[:, :p]), -arma.coefficients(u[:, p:])
    loglik, beta, variance = arma.profile(y, x, ar, ma)
    for k in range(3):
        want = normal(y, x, ar[k], ma[k])
        assert loglik[k] == pytest.approx(want[0], abs=1e-6) and beta[k] == pytest.approx(want[1], abs=1e-7) and variance[k] == pytest.approx(want[2], rel=1e-8)


def test_coefficients_are_stable():
    u = np.random.default_rng(0).normal(size=(200, 3)) * 3
    for a in arma.coefficients(u):
        assert np.abs(np.roots(np.concatenate(([1.0], -a)))).max() < 1


def simulated(n=1500, gaps=True, seed=1):
    rng = np.random.default_rng(seed)
    e, y, x = rng.normal(size=n), np.zeros(n), rng.normal(size=n)
    for t in range(2, n):
        y[t] = 0.6 * y[t - 1] - 0.2 * y[t - 2] + e[t] + 0.5 * e[t - 1]
    y = 3 + y + 0.8 * x
    if gaps:
        y[rng.random(n) < 0.05] = np.nan
    return y, x


def test_fit_finds_the_truth_and_no_neighbour_is_better():
    y, x = simulated()
    got = arma.fit(y, 2, 1, x[:, None])
    assert got.ar == pytest.approx([0.6, -0.2], abs=0.12) and got.ma == pytest.approx([0.5], abs=0.12) and got.beta == pytest.approx([3, 0.8], abs=0.2)
    design = np.column_stack((np.ones(len(y)), x))
    rng = np.random.default_rng(2)
    for _ in range(40):
        ar, ma = got.ar + rng.normal(size=2) * 0.01, got.ma + rng.normal(size=1) * 0.01
        assert arma.profile(y, design, ar[None], ma[None])[0][0] <= got.loglik + 1e-6
    assert got.aic == pytest.approx(2 * (3 + 2 + 1) - 2 * got.loglik)
    assert min((arma.fit(y - 0.8 * x, p, q).aic, p, q) for p, q in ((0, 0), (1, 0), (0, 1), (2, 1)))[1:] == (2, 1)


def test_nested_orders_never_lose_and_constant_series_pass():
    y, _ = simulated(400, seed=3)
    best = {(p, q): arma.fit(y, p, q).loglik for p, q in arma.ORDERS}
    for (p, q), v in best.items():
        if p:
            assert v >= best[p - 1, q] - 0.05
    flat = arma.fit(np.full(50, 2.0), 1, 1)
    assert np.isfinite(flat.loglik) and flat.beta[0] == pytest.approx(2)


def test_one_step_equals_the_conditional_mean():
    y, x = simulated(90)
    ar, ma, beta = np.array([0.6, -0.2]), np.array([0.5]), np.array([3, 0.8])
    got = arma.one_step(y, x[:, None], ar, ma, beta)
    mean, gamma = np.column_stack((np.ones(90), x)) @ beta, covariances(ar, ma, 90)
    for t in (1, 5, 30, 60, 89):
        past = np.flatnonzero(np.isfinite(y[:t]))
        cov = gamma[np.abs(past[:, None] - past)]
        assert got[t] == pytest.approx(mean[t] + gamma[t - past] @ np.linalg.solve(cov, (y - mean)[past]), abs=1e-8)


def table(spark, names=("a", "b"), n=420):
    rows = []
    for k, s in enumerate(names):
        y, x = simulated(n, seed=k + 5)
        later = np.append(y[1:], np.nan)
        rows += [(s, T0 + timedelta(hours=i), *(None if v != v else float(v) for v in (y[i], later[i], x[i])), bool(np.isfinite(later[i]))) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, open_time timestamp, ret_lag1 double, target double, x double, valid boolean")


def test_all_orders_of_each_symbol_and_window_and_arimax_takes_the_stored_one(spark):
    windows = [splits.Window(f"f{k}", T0 + timedelta(hours=a), T0 + timedelta(hours=a), T0 + timedelta(hours=a + 50)) for k, a in enumerate((300, 350))]
    grid = table(spark).repartition(3)
    fits = arma.orders(grid, windows, history=200).cache()
    rows = fits.collect()
    assert {(r.symbol, r.fold, r.p, r.q) for r in rows} == {(s, f, p, q) for s in "ab" for f in ("f0", "f1") for p, q in arma.ORDERS}
    y = np.array([np.nan if r.ret_lag1 is None else r.ret_lag1 for r in table(spark, ("a",)).orderBy("open_time").collect()])
    one = next(r for r in rows if (r.symbol, r.fold, r.p, r.q) == ("a", "f1", 1, 2))
    assert one.aic == pytest.approx(arma.fit(y[150:350], 1, 2).aic, abs=1e-6)
    taken = arma.chosen(fits)
    best = {(r.symbol, r.fold): (r.p, r.q) for r in taken.collect()}
    assert all(best[s, f] == min((r.aic, r.i, (r.p, r.q)) for r in rows if (r.symbol, r.fold) == (s, f))[2] for s, f in best) and len(best) == 4
    got = forecast.arma(grid, windows, history=200, taken=taken)
    own = grid.filter("valid").filter(f"open_time >= '{windows[0].test_start}' and open_time < '{windows[1].test_end}'")
    assert got.count() == own.count() and got.filter("y_pred is null or isnan(y_pred)").count() == 0
    lone = {(r.symbol, r.open_time): r.y_pred for r in forecast.arma(grid.filter("symbol = 'a'"), windows, history=200).collect()}
    assert all(lone[r.symbol, r.open_time] == pytest.approx(r.y_pred, abs=1e-9) for r in got.filter("symbol = 'a'").collect())
    with_x = {r.open_time: r.y_pred for r in forecast.arma(grid, windows, history=200, exog=["x"], taken=taken).filter("symbol = 'a' and fold = 'f0'").collect()}
    x = np.array([r.x for r in table(spark, ("a",)).orderBy("open_time").collect()])
    before = np.concatenate(([0.0], x))[:, None]
    f = arma.fit(y[100:300], *best["a", "f0"], before[100:300])
    want = arma.one_step(np.append(y, np.nan)[100:351], before[100:351], f.ar, f.ma, f.beta)
    assert all(v == pytest.approx(want[int((t - T0).total_seconds() // 3600) + 1 - 100], abs=1e-8) for t, v in with_x.items())


def test_short_and_empty_series_give_no_forecast(spark):
    windows = [splits.Window("f", T0 + timedelta(hours=20), T0 + timedelta(hours=20), T0 + timedelta(hours=40))]
    assert forecast.arma(table(spark, n=40), windows).count() == 0
    assert forecast.arma(table(spark, n=40).filter("false"), windows).count() == 0
