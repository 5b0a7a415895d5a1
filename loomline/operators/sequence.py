"""A two-layer LSTM forecaster: windows are built by Spark, one task trains one symbol's model in numpy.

The first layer has `hidden` cells, the second half as many, and a linear output reads the last state. Inputs and target
are standardised by training rows alone; the last tenth of them, in time, stops training early and picks the weights.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import by_time, complete_windows
from .splits import Window


def windows(table: DataFrame, columns: list[str], lookback: int, symbol: str = "symbol", time: str = "open_time") -> DataFrame:
    """Rows whose last `lookback` rows are all valid, with their columns, oldest first, as one array."""
    w = by_time(symbol, time)
    past = F.flatten(F.array(*[F.array(*[F.lag(c, k).over(w) for c in columns]) for k in range(lookback - 1, -1, -1)]))
    rows = table.select(symbol, time, "target", "valid", past.alias("past"), complete_windows(F.col("valid"), lookback, w).alias("__whole"))
    return rows.filter("__whole and valid").drop("__whole", "valid")


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def initial(inputs: int, hidden: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Weights of both layers (one matrix each, bias row last, forget bias one) and of the output."""
    out = []
    for n, h in ((inputs, hidden), (hidden, max(1, hidden // 2))):
        w = rng.normal(0, 1 / np.sqrt(n + h), (n + h + 1, 4 * h))
        w[-1] = 0
        w[-1, h : 2 * h] = 1
        out.append(w)
    last = max(1, hidden // 2)
    return [*out, rng.normal(0, 1 / np.sqrt(last), (last + 1, 1))]


def layer(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, list]:
    """States (batch, steps, h) of one layer, and what its gradient needs."""
    batch, steps, _ = x.shape
    h = w.shape[1] // 4
    state, cell, out, kept = np.zeros((batch, h)), np.zeros((batch, h)), np.empty((batch, steps, h)), []
    for t in range(steps):
        z = np.concatenate((x[:, t], state, np.ones((batch, 1))), axis=1)
        gates = z @ w
        i, f, o, g = _sigmoid(gates[:, :h]), _sigmoid(gates[:, h : 2 * h]), _sigmoid(gates[:, 2 * h : 3 * h]), np.tanh(gates[:, 3 * h :])
        before = cell
        cell = f * cell + i * g
        squashed = np.tanh(cell)
        state = o * squashed
        out[:, t] = state
        kept.append((z, i, f, o, g, before, squashed))
    return out, kept


def layer_gradient(d_out: np.ndarray, w: np.ndarray, kept: list, inputs: int) -> tuple[np.ndarray, np.ndarray]:
    """(gradient of the inputs, gradient of w) from that of the states."""
    h = w.shape[1] // 4
    d_w, d_x = np.zeros_like(w), np.empty((d_out.shape[0], d_out.shape[1], inputs))
    d_state, d_cell = np.zeros((d_out.shape[0], h)), np.zeros((d_out.shape[0], h))
    for t in range(len(kept) - 1, -1, -1):
        z, i, f, o, g, before, squashed = kept[t]
        d = d_out[:, t] + d_state
        d_cell = d_cell + d * o * (1 - squashed**2)
        d_gates = np.concatenate((d_cell * g * i * (1 - i), d_cell * before * f * (1 - f), d * squashed * o * (1 - o), d_cell * i * (1 - g**2)), axis=1)
        d_w += z.T @ d_gates
        d_z = d_gates @ w.T
        d_x[:, t], d_state, d_cell = d_z[:, :inputs], d_z[:, inputs:-1], d_cell * f
    return d_x, d_w


def predict(weights: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    top = layer(layer(x, weights[0])[0], weights[1])[0][:, -1]
    return (top @ weights[2][:-1] + weights[2][-1])[:, 0]


def gradients(weights: list[np.ndarray], x: np.ndarray, y: np.ndarray, keep: np.ndarray | float = 1.0) -> list[np.ndarray]:
    """Gradients of the mean squared error; keep scales the last state (dropout)."""
    low, kept_low = layer(x, weights[0])
    high, kept_high = layer(low, weights[1])
    top = high[:, -1] * keep
    error = (top @ weights[2][:-1] + weights[2][-1])[:, 0] - y
    d = (2 * error / len(y))[:, None]
    d_last = np.concatenate((top.T @ d, d.sum(axis=0, keepdims=True)))
    d_high = np.zeros_like(high)
    d_high[:, -1] = d @ weights[2][:-1].T * keep
    d_low, d_second = layer_gradient(d_high, weights[1], kept_high, low.shape[2])
    _, d_first = layer_gradient(d_low, weights[0], kept_low, x.shape[2])
    return [d_first, d_second, d_last]


def train(x: np.ndarray, y: np.ndarray, hidden: int, seed: int, epochs: int = 30, batch: int = 128, rate: float = 1e-3, dropout: float = 0.0, patience: int = 5) -> list[np.ndarray]:
    """Weights with the least error on the last tenth of the rows."""
    rng = np.random.default_rng(seed)
    cut = max(1, int(len(x) * 0.9))
    weights = initial(x.shape[2], hidden, rng)
    moment, square = ([np.zeros_like(w) for w in weights] for _ in range(2))
    best, least, bad, step = [w.copy() for w in weights], np.inf, 0, 0
    for _ in range(epochs):
        order = rng.permutation(cut)
        for start in range(0, cut, batch):
            at = order[start : start + batch]
            keep = (rng.random((len(at), weights[1].shape[1] // 4)) >= dropout) / (1 - dropout) if dropout else 1.0
            step += 1
            for k, g in enumerate(gradients(weights, x[at], y[at], keep)):
                moment[k], square[k] = 0.9 * moment[k] + 0.1 * g, 0.999 * square[k] + 0.001 * g * g
                weights[k] -= rate * (moment[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
        held = slice(cut, None) if cut < len(x) else slice(None)
        loss = float(((predict(weights, x[held]) - y[held]) ** 2).mean())
        if loss < least:
            best, least, bad = [w.copy() for w in weights], loss, 0
        elif (bad := bad + 1) >= patience:
            break
    return best


def lstm(table: DataFrame, columns: list[str], window: Window, params: dict, seed: int) -> DataFrame:
    """Forecast adapter: (symbol, open_time, y_true, model, y_pred) of the window's test rows."""
    lookback = params.get("lookback", 12)
    rows = windows(table, columns, lookback).filter(F.col("open_time") < F.lit(window.test_end))
    train_end, test_start = pd.Timestamp(window.train_end), pd.Timestamp(window.test_start)
    options = {k: v for k, v in params.items() if k != "lookback"} | {"hidden": params.get("hidden", 32)}
    names = ["symbol", "open_time", "y_true", "model", "y_pred"]

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("open_time")
        teach, test = (frame["open_time"] < train_end).to_numpy(), (frame["open_time"] >= test_start).to_numpy()
        if teach.sum() < 20 or not test.any():
            return pd.DataFrame(columns=names)
        x = np.stack(frame["past"].to_numpy()).astype(float).reshape(len(frame), lookback, len(columns))
        y = frame["target"].to_numpy(float)
        mean, sd = x[teach].mean(axis=(0, 1)), x[teach].std(axis=(0, 1))
        x = (x - mean) / np.where(sd > 0, sd, 1)
        centre, spread = y[teach].mean(), y[teach].std() or 1.0
        weights = train(x[teach], (y[teach] - centre) / spread, seed=seed, **options)
        got = frame.loc[test, ["symbol", "open_time"]]
        return got.assign(y_true=y[test], model="lstm", y_pred=predict(weights, x[test]) * spread + centre)[names]

    return rows.groupBy("symbol").applyInPandas(work, "symbol string, open_time timestamp, y_true double, model string, y_pred double")
