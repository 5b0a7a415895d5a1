"""ARMA models, with or without regressors, by exact likelihood.

The likelihood comes from a Kalman filter over a state-space form with a stationary start; hours without a value only
predict. Constant and regressors are profiled out: the filter whitens them together with the series, and generalised
least squares on what it leaves gives their coefficients, so that a search has p + q dimensions. Coefficients are
mapped from partial autocorrelations, which keeps every trial stationary and invertible, and BFGS takes gradients by
central differences. All trials of a step are filtered in one pass over time, and once the filter's covariance has
settled, up to STEADY hours at a time are one matrix product.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import timedelta
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .splits import Window, as_table

#: Hours that a settled filter takes at once; change of the covariance below which it has settled.
STEADY, SETTLED = 64, 1e-10
ORDERS = tuple(product(range(4), repeat=2))
#: Values that a fit needs.
LEAST = 30


def coefficients(u: np.ndarray) -> np.ndarray:
    """Coefficients (k, p) of stationary autoregressions from any real numbers u (k, p), by Durbin and Levinson."""
    r, a = u / np.sqrt(1 + u * u), np.zeros_like(u)
    for k in range(u.shape[1]):
        a[:, :k] -= r[:, k : k + 1] * a[:, :k][:, ::-1]
        a[:, k] = r[:, k]
    return a


class Filter:
    """The filter of k models at once, from autoregressive (k, p) and moving-average (k, q) coefficients."""

    def __init__(self, ar: np.ndarray, ma: np.ndarray):
        k, r = len(ar), max(ar.shape[1], ma.shape[1] + 1)
        self.step = np.zeros((k, r, r))
        self.step[:, : ar.shape[1], 0] = ar
        self.step[:, np.arange(r - 1), np.arange(1, r)] = 1
        shock = np.concatenate((np.ones((k, 1)), ma, np.zeros((k, r - 1 - ma.shape[1]))), axis=1)
        self.noise = shock[:, :, None] * shock[:, None, :]
        pairs = np.einsum("kab,kcd->kacbd", self.step, self.step).reshape(k, r * r, r * r)
        self.start = np.linalg.solve(np.eye(r * r) - pairs, self.noise.reshape(k, r * r, 1)).reshape(k, r, r)
        self.steady = None

    def _settle(self, cov: np.ndarray) -> None:
        """Keeps what a settled filter needs for up to STEADY hours."""
        gain = np.einsum("kab,kb->ka", self.step, cov[:, :, 0] / cov[:, :1, 0])
        loop = self.step.copy()
        loop[:, :, 0] -= gain
        seen, pushed = np.empty((len(gain), STEADY, loop.shape[1])), np.empty((len(gain), STEADY, loop.shape[1]))
        powers = [np.broadcast_to(np.eye(loop.shape[1]), loop.shape)]
        for _ in range(STEADY):
            powers.append(powers[-1] @ loop)
        for i in range(STEADY):
            seen[:, i], pushed[:, i] = powers[i][:, 0], (powers[i] @ gain[:, :, None])[:, :, 0]
        echo = np.zeros((len(gain), STEADY, STEADY))
        for i in range(1, STEADY):
            echo[:, i, :i] = pushed[:, :i, 0][:, ::-1]
        self.steady = seen, echo, pushed, powers

    def run(self, y: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(forecasts (k, hours, series), variances (k, hours)) one hour ahead, for y (hours, series) with equal gaps.

        Single hours are taken with the models along the last axis, and the transition as what it is: a shift and one column.
        """
        n, k = len(y), len(self.step)
        ahead, spread = np.zeros((n, y.shape[1], k)), np.empty((n, k))
        cov, noise, ar = (np.ascontiguousarray(np.moveaxis(v, 0, -1)) for v in (self.start, self.noise, self.step[:, :, 0]))
        state, t = np.zeros((len(ar), y.shape[1], k)), int(np.argmax(np.append(seen, True)))
        spread[:t] = cov[0, 0]  # before the first value the filter stays where it starts
        gaps, settled = np.append(np.flatnonzero(~seen), n), None

        def moved(left: np.ndarray) -> np.ndarray:
            half = ar[:, None] * left[0]
            half[:-1] += left[1:]
            out = half[:, :1] * ar
            out[:, :-1] += half[:, 1:]
            out += noise
            return out

        while t < n:
            if settled is not None and seen[t] and np.abs(cov - settled).max() <= 10 * SETTLED:
                cov, (view, echo, pushed, powers) = settled, self.steady
                stop, whole = gaps[np.searchsorted(gaps, t)], state.transpose(2, 0, 1)
                spread[t:stop] = cov[0, 0]
                while t < stop:
                    m = min(STEADY, stop - t)
                    part = y[t : t + m]
                    ahead[t : t + m] = (view[:, :m] @ whole + echo[:, :m, :m] @ part).transpose(1, 2, 0)
                    whole = powers[m] @ whole + np.einsum("kmr,ms->krs", pushed[:, :m][:, ::-1], part)
                    t += m
                state = np.ascontiguousarray(whole.transpose(1, 2, 0))
                continue
            ahead[t], spread[t] = state[0], cov[0, 0]
            if seen[t]:
                gain = cov[:, 0] / cov[0, 0]
                state = state + gain[:, None] * (y[t][:, None] - state[0])
                after = moved(cov - gain[:, None] * cov[0])
                if settled is None and np.abs(after - cov).max() <= SETTLED:
                    settled = after
                    self._settle(np.moveaxis(after, -1, 0))
            else:
                after = moved(cov)
            next_state = ar[:, None] * state[0]
            next_state[:-1] += state[1:]
            state, cov, t = next_state, after, t + 1
        return ahead.transpose(2, 0, 1), spread.T


@dataclass(frozen=True)
class Fit:
    """ar and ma coefficients, beta of the constant and the regressors, variance, log-likelihood, AIC."""

    ar: np.ndarray
    ma: np.ndarray
    beta: np.ndarray
    variance: float
    loglik: float
    aic: float


def profile(y: np.ndarray, x: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log-likelihoods, betas, variances) of k models of y (with gaps) on the columns of x, beta and variance at their best."""
    seen = np.isfinite(y)
    both = np.column_stack((np.where(seen, y, 0), np.where(seen[:, None], x, 0)))
    ahead, spread = Filter(ar, ma).run(both, seen)
    scale = np.sqrt(spread[:, seen])
    white = (both[seen] - ahead[:, seen]) / scale[:, :, None]
    a, b = white[:, :, 1:], white[:, :, :1]
    turned = a.transpose(0, 2, 1)
    beta = np.linalg.pinv(turned @ a, rcond=1e-12, hermitian=True) @ (turned @ b)
    n = int(seen.sum())
    variance = np.maximum(((b - a @ beta) ** 2).sum(axis=(1, 2)) / n, 1e-300)
    return -0.5 * (n * (np.log(2 * np.pi * variance) + 1)) - np.log(scale).sum(axis=1), beta[:, :, 0], variance


def partial_autocorrelations(y: np.ndarray, most: int) -> np.ndarray:
    """Of the values around their mean, over pairs that both exist."""
    x = y - np.nanmean(y)
    zero = np.nanmean(x * x)
    rho = np.array([1.0, *(np.nanmean(x[k:] * x[:-k]) / zero if zero > 0 and np.isfinite(x[k:] * x[:-k]).any() else 0.0 for k in range(1, most + 1))])
    a, out = np.zeros(most + 1), []
    for k in range(1, most + 1):
        left = 1 - a[1:k] @ rho[1:k]
        r = float(np.clip((rho[k] - a[1:k] @ rho[1:k][::-1]) / left if abs(left) > 1e-9 else 0.0, -0.9, 0.9))
        a[1:k] -= r * a[1:k][::-1]
        a[k] = r
        out.append(r)
    return np.array(out)


def fit(y: np.ndarray, p: int, q: int, x: np.ndarray | None = None, steps: int = 60) -> Fit:
    """The exact-likelihood fit of y, where gaps are nan, on a constant and the columns of x with ARMA(p, q) errors."""
    design = np.column_stack((np.ones(len(y)), *(() if x is None else (x,))))
    m, n = p + q, int(np.isfinite(y).sum())

    def loss(u: np.ndarray) -> np.ndarray:
        return -profile(y, design, coefficients(u[:, :p]), -coefficients(u[:, p:]))[0] / n

    def seen_from(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(losses, gradients) at points (..., m), all in one pass over time."""
        nudge = 1e-5 * np.concatenate((np.zeros((1, m)), np.eye(m), -np.eye(m)))
        got = loss((points[..., None, :] + nudge).reshape(-1, m)).reshape(*points.shape[:-1], 2 * m + 1)
        return got[..., 0], (got[..., 1 : m + 1] - got[..., m + 1 :]) / 2e-5

    def search(at: np.ndarray) -> np.ndarray:
        """The best point that BFGS reaches from the starts `at`, which take their steps together."""
        now, g = seen_from(at)
        h, scale, idle, sizes = np.tile(np.eye(m), (len(at), 1, 1)), np.ones(len(at)), np.zeros(len(at), int), np.array([1.0, 0.25])
        for _ in range(steps):
            on = np.flatnonzero((idle < 3) & (np.abs(g).max(axis=1) >= 1e-6))
            if not len(on):
                break
            way = -np.einsum("sab,sb->sa", h[on], g[on])
            back = (way * g[on]).sum(axis=1) >= 0
            h[on[back]], way[back] = np.eye(m), -g[on[back]]
            way *= np.minimum(1, 2 / np.abs(way).max(axis=1))[:, None]
            values, slopes = seen_from(at[on][:, None] + (scale[on][:, None] * sizes)[:, :, None] * way[:, None])
            for j, i in enumerate(on):
                best = int(np.argmin(values[j]))
                gained = now[i] - values[j, best]
                idle[i] = idle[i] + 1 if not gained > 1e-7 else 0
                if not gained > 1e-13:
                    scale[i] *= 0.05
                    continue
                step, change = scale[i] * sizes[best] * way[j], slopes[j, best] - g[i]
                at[i], now[i], g[i], scale[i] = at[i] + step, values[j, best], slopes[j, best], 1.0
                if (s := step @ change) > 1e-14:
                    keep = np.eye(m) - np.outer(step, change) / s
                    h[i] = keep @ h[i] @ keep.T + np.outer(step, step) / s
        return at[int(np.argmin(now))]

    if m:
        r = partial_autocorrelations(y, max(p, q))
        first = r / np.sqrt(1 - r * r)
        starts = [np.concatenate((first[:p], np.full(q, 0.05)))]
        if p and q:
            starts.append(np.concatenate((np.full(p, 0.05), -first[:q])))
        u = search(np.array(starts))
    else:
        u = np.zeros(0)
    ar, ma = coefficients(u[None, :p]), -coefficients(u[None, p:])
    loglik, beta, variance = profile(y, design, ar, ma)
    return Fit(ar[0], ma[0], beta[0], float(variance[0]), float(loglik[0]), 2 * (m + design.shape[1] + 1) - 2 * float(loglik[0]))


def one_step(y: np.ndarray, x: np.ndarray | None, ar: np.ndarray, ma: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """The forecast of each hour from all hours before it."""
    mean = np.column_stack((np.ones(len(y)), *(() if x is None else (x,)))) @ beta
    seen = np.isfinite(y)
    ahead, _ = Filter(ar[None], ma[None]).run(np.where(seen, y - mean, 0)[:, None], seen)
    return ahead[0, :, 0] + mean


def series(grid: DataFrame, windows: list[Window], history: int, exog: list[str], value: str) -> DataFrame:
    """(symbol, fold, test_start, test_end, hours): each window's hours and `history` before it, as one array."""
    spans = as_table(grid.sparkSession, windows).withColumn("__from", F.col("test_start") - F.make_dt_interval(F.lit(0), F.lit(history + 1)))
    inside = (F.col("open_time") >= F.col("__from")) & (F.col("open_time") < F.col("test_end"))
    rows = grid.select("symbol", "open_time", F.col(value).cast("double").alias("ret"), F.col("target").cast("double").alias("target"), "valid", F.array(*[F.col(c).cast("double") for c in exog]).cast("array<double>").alias("x"))
    rows = rows.join(F.broadcast(spans), inside)  # as many rows as windows
    packed = rows.groupBy("symbol", F.col("name").alias("fold"), "test_start", "test_end")
    return packed.agg(F.sort_array(F.collect_list(F.struct("open_time", "ret", "target", "valid", "x"))).alias("hours"))


def _arrays(row, history: int, columns: int) -> tuple[pd.DatetimeIndex, np.ndarray, np.ndarray | None, pd.DataFrame]:
    """(hours up to the window's end and one more, returns by hour, regressors known an hour before, the window's rows)."""
    start = pd.Timestamp(row.test_start) - timedelta(hours=history)
    index = pd.date_range(start, pd.Timestamp(row.test_end), freq="h")
    frame = pd.DataFrame(list(row.hours), columns=["open_time", "ret", "target", "valid", "x"]) if not isinstance(row.hours[0], dict) else pd.DataFrame(list(row.hours))
    at = pd.DatetimeIndex(frame["open_time"])
    place = index.get_indexer(at)
    y = np.full(len(index), np.nan)
    y[place[place >= 0]] = frame["ret"].to_numpy(float)[place >= 0]
    x = None
    if columns:
        x = np.zeros((len(index), columns))
        after = index.get_indexer(at + timedelta(hours=1))
        known = np.array([[0.0 if c is None or c != c else c for c in v] for v in frame["x"]], float).reshape(len(frame), columns)
        x[after[after >= 0]] = known[after >= 0]
    own = frame[frame["valid"].fillna(False).to_numpy(bool) & (at >= pd.Timestamp(row.test_start))]
    return index, y, x, own


def orders(grid: DataFrame, windows: list[Window], tried: tuple[tuple[int, int], ...] = ORDERS, history: int = 8760, value: str = "ret_lag1") -> DataFrame:
    """(symbol, fold, p, q, aic, loglik, ar, ma, beta) of every order tried on the `history` hours before each window.

    A row, and so a task at most, is one symbol, window and order.
    """
    asked = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("p"), F.lit(q).alias("q")) for i, (p, q) in enumerate(tried)])
    rows = series(grid, windows, history, [], value).withColumn("o", F.explode(asked)).select("*", "o.*").drop("o")
    rows = rows.repartition(max(1, min(1000, len(windows) * len(tried))), "symbol", "fold", "p", "q")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                y = _arrays(row, history, 0)[1][:history]
                if np.isfinite(y).sum() >= LEAST:
                    f = fit(y, row.p, row.q)
                    yield pd.DataFrame([(row.symbol, row.fold, row.i, row.p, row.q, f.aic, f.loglik, f.ar.tolist(), f.ma.tolist(), f.beta.tolist())])

    return rows.mapInPandas(run, "symbol string, fold string, i int, p int, q int, aic double, loglik double, ar array<double>, ma array<double>, beta array<double>")


def chosen(fits: DataFrame) -> DataFrame:
    """The order with the least AIC of each symbol and window; the first tried wins ties."""
    best = fits.filter("not isnan(aic)").groupBy("symbol", "fold").agg(F.min(F.struct("aic", "i", "p", "q", "ar", "ma", "beta")).alias("b"))
    return best.select("symbol", "fold", "b.p", "b.q", "b.ar", "b.ma", "b.beta")


def forecasts(grid: DataFrame, windows: list[Window], taken: DataFrame, history: int = 8760, exog: list[str] | None = None, value: str = "ret_lag1") -> DataFrame:
    """(symbol, fold, open_time, y_true, model, y_pred) of the next hour's return, by the orders of taken(symbol, fold, p, q, ar, ma, beta).

    Without exog the parameters of taken are used as they are. With exog the model is fitted anew at that order on the
    columns as known an hour before. Parameters are frozen within a window, whose hours the filter then runs through.
    """
    exog = exog or []
    rows = series(grid, windows, history, exog, value).join(taken, ["symbol", "fold"])
    rows = rows.repartition(max(1, min(1000, 4 * len(windows))), "symbol", "fold")
    name = "arimax" if exog else "arima"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                index, y, x, own = _arrays(row, history, len(exog))
                if exog:
                    f = fit(y[:history], row.p, row.q, x[:history])
                    ar, ma, beta = f.ar, f.ma, f.beta
                else:
                    ar, ma, beta = (np.array(v, float) for v in (row.ar, row.ma, row.beta))
                ahead = one_step(y, x, ar, ma, beta)
                place = index.get_indexer(pd.DatetimeIndex(own["open_time"]) + timedelta(hours=1))
                yield pd.DataFrame({"symbol": row.symbol, "fold": row.fold, "open_time": own["open_time"].to_numpy(), "y_true": own["target"].to_numpy(float), "model": name, "y_pred": np.where(place >= 0, ahead[place], np.nan)})

    return rows.mapInPandas(run, "symbol string, fold string, open_time timestamp, y_true double, model string, y_pred double")
