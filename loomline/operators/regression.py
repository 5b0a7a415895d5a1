"""Regressions with HAC covariance, Granger causality and the augmented Dickey-Fuller test, by mergeable moments.

A series is cut into blocks of HOURS hours, each a task's matrix. Blocks send cross-products of their rows; their sum
gives the coefficients. With these the blocks send the weighted lagged cross-products of their scores, and their first and
last scores, by which neighbouring blocks are joined in order: what is left out at a border is added there. So a
series of any length is spread over tasks, and only moments, a matrix a block, meet.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stats import most_lags


def chi2_sf(x: float, k: int) -> float:
    """P(X > x) of a chi-square with k degrees of freedom: regularised upper incomplete gamma."""
    if not x > 0:
        return 1.0
    a, x = k / 2, x / 2
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - front * total)
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def hac_ols(y: np.ndarray, x: np.ndarray, lags: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coefficients, covariance, residuals) with Bartlett weights; lags 0 is the White covariance."""
    inv = np.linalg.pinv(x.T @ x)
    beta = inv @ (x.T @ y)
    e = y - x @ beta
    u = x * e[:, None]
    s = u.T @ u
    for k in range(1, lags + 1):
        g = u[k:].T @ u[:-k]
        s += (1 - k / (lags + 1)) * (g + g.T)
    return beta, inv @ s @ inv, e


def wald(beta: np.ndarray, cov: np.ndarray, which: np.ndarray) -> tuple[float, float, int]:
    """(statistic, p-value, degrees) of the chosen coefficients being zero."""
    b, v = beta[which], cov[np.ix_(which, which)]
    stat = float(b @ np.linalg.pinv(v) @ b)
    return stat, chi2_sf(stat, len(b)), len(b)


#: Hours of a block; scaled eigenvalues below which a direction of the design is not determined.
HOURS, SINGULAR = 4096, 1e-10


def packs(rows: DataFrame, keys: list[str], columns: list[str], time: str = "open_time") -> DataFrame:
    """(keys, block, width, data): each block's rows in time order as one matrix of doubles, nulls as nan."""
    block = F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / F.lit(3600 * HOURS)).alias("block")
    named = rows.select(*keys, block, F.col(time).alias("__t"), *[F.col(c).cast("double").alias(f"__{i}") for i, c in enumerate(columns)])
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("__t", kind="stable")
        data = frame[[f"__{i}" for i in range(len(columns))]].to_numpy(float)
        return pd.DataFrame([(*key, len(columns), data.tobytes())], columns=[*keys, "block", "width", "data"])

    return named.groupBy(*keys, "block").applyInPandas(pack, f"{kinds}, block long, width int, data binary")


@dataclass(frozen=True)
class Regressions:
    """Regressions of one table: design(data, e, p) gives the sound rows (y, x) of equation e with p lags, in order."""

    packed: DataFrame
    keys: list[str]
    design: Callable[[np.ndarray, int, int], tuple[np.ndarray, np.ndarray]]

    def _schema(self, rest: str) -> str:
        return ", ".join([*(f"{k} {self.packed.schema[k].dataType.simpleString()}" for k in self.keys), rest])

    def _over(self, plan: DataFrame, work: Callable[[tuple, np.ndarray], Iterator[tuple]], schema: str) -> DataFrame:
        """work(row of the block and its plan, its matrix) for each block; plan(keys, specs) is joined to the blocks."""
        names = [*self.keys, *(x.split()[0] for x in schema.split(", "))]
        keys = self.keys

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for row in frame.itertuples():
                    data = np.frombuffer(row.data).reshape(-1, row.width)
                    got = [(*(getattr(row, k) for k in keys), *r) for r in work(row, data)]
                    if got:
                        yield pd.DataFrame(got, columns=names)

        return self.packed.join(plan, self.keys).mapInPandas(run, self._schema(schema))

    def moments(self, plan: DataFrame) -> DataFrame:
        """(keys, e, p, rule, n, yy, xy, xx) of plan(keys, specs array<struct<e, p, rule>>), added over blocks in order."""
        design = self.design

        def work(row, data: np.ndarray) -> Iterator[tuple]:
            for spec in row.specs:
                y, x = design(data, spec["e"], spec["p"])
                if len(y):
                    yield spec["e"], spec["p"], spec["rule"], row.block, len(y), float(y @ y), (x.T @ y).tolist(), (x.T @ x).ravel().tolist()

        parts = self._over(plan, work, "e int, p int, rule string, block long, n long, yy double, xy array<double>, xx array<double>")
        names = [*self.keys, "e", "p", "rule"]

        def add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("block")
            total = (int(frame["n"].sum()), float(frame["yy"].sum()), np.sum(np.stack(frame["xy"]), axis=0), np.sum(np.stack(frame["xx"]), axis=0))
            return pd.DataFrame([(*key, *total)], columns=[*names, "n", "yy", "xy", "xx"])

        return parts.groupBy(*names).applyInPandas(add, self._schema("e int, p int, rule string, n long, yy double, xy array<double>, xx array<double>"))

    def hac(self, plan: DataFrame, tested: Callable[[int, int], list[int]]) -> DataFrame:
        """(keys, e, p, rule, n, wald, p_value, df): whether the tested coefficients are all zero, with Newey-West lags by n.

        There is no row for a regression with no more rows than coefficients; the statistic and its p-value are null if
        the rows don't determine the tested coefficients or their covariance.
        """
        design, keys = self.design, self.keys
        sums = self.moments(plan).filter(F.col("n") > F.size("xy"))
        solve = F.udf(lambda xy, xx: Moments(np.array(xy), np.array(xx)).beta.tolist(), "array<double>")
        sums = sums.withColumn("beta", solve("xy", "xx"))  # a row a regression
        specs = sums.groupBy(*keys).agg(F.collect_list(F.struct("e", "p", "rule", "n", "beta")).alias("specs"))

        def work(row, data: np.ndarray) -> Iterator[tuple]:
            for spec in row.specs:
                y, x = design(data, spec["e"], spec["p"])
                if len(y):
                    lags = most_lags(spec["n"])
                    u = x * (y - x @ np.array(spec["beta"]))[:, None]
                    yield spec["e"], spec["p"], spec["rule"], row.block, len(u), lagged_products(u, lags).ravel().tolist(), u[:lags].ravel().tolist(), u[max(0, len(u) - lags) :].ravel().tolist()

        parts = self._over(specs, work, "e int, p int, rule string, block long, in_block long, products array<double>, first_scores array<double>, last_scores array<double>")
        names = [*keys, "e", "p", "rule"]
        parts = parts.join(sums.select(*names, "n", "xy", "xx", "beta"), names)

        def merge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("block")
            one, n = Moments(frame["xy"].iloc[0], frame["xx"].iloc[0]), int(frame["n"].iloc[0])
            width, lags = len(one.beta), most_lags(n)
            cut = lambda v: np.array(v, float).reshape(-1, width)
            total, last = np.zeros((width, width)), np.zeros((0, width))
            for s, m, head, tail in zip(frame["products"], frame["in_block"], frame["first_scores"], frame["last_scores"]):
                total += cut(s) + across(last, cut(head), lags)
                last = cut(tail) if m >= lags else np.concatenate((last, cut(head)))[-lags:]
            which = np.array(tested(*key[len(keys) : len(keys) + 2]))
            stat, p_value, df = one.wald(total, which)
            return pd.DataFrame([(*key, n, stat, p_value, df)], columns=[*names, "n", "wald", "p_value", "df"])

        return parts.groupBy(*names).applyInPandas(merge, self._schema("e int, p int, rule string, n long, wald double, p_value double, df int"))


def lagged_products(u: np.ndarray, lags: int) -> np.ndarray:
    """The Bartlett-weighted sum of u_t u_s' over |t - s| <= lags."""
    s = u.T @ u
    for k in range(1, min(lags, len(u) - 1) + 1):
        g = u[k:].T @ u[:-k]
        s += (1 - k / (lags + 1)) * (g + g.T)
    return s


def across(left: np.ndarray, right: np.ndarray, lags: int) -> np.ndarray:
    """What `lagged_products` of left and right together has beyond those of each; left ends where right begins."""
    s = np.zeros((right.shape[1], right.shape[1]))
    for k in range(1, lags + 1):
        at = np.arange(max(0, k - len(left)), min(k, len(right)))  # rows of right whose row k before is in left
        if len(at):
            g = right[at].T @ left[len(left) + at - k]
            s += (1 - k / (lags + 1)) * (g + g.T)
    return s


class Moments:
    """Least squares from x'y and x'x; directions that the scaled x'x doesn't determine are left at zero."""

    def __init__(self, xy: np.ndarray, xx: np.ndarray):
        xx = np.asarray(xx, float).reshape(len(xy), len(xy))
        size = np.sqrt(np.diag(xx))
        scale = np.where(size > 0, 1 / np.where(size > 0, size, 1), 0)
        values, vectors = np.linalg.eigh(xx * scale[:, None] * scale[None, :])
        good = values > SINGULAR * max(values.max(initial=0), 1e-300)
        half = scale[:, None] * vectors[:, good]
        self.inverse = half / values[good] @ half.T
        self.beta = self.inverse @ np.asarray(xy, float)
        self.determined = (np.abs(vectors[:, ~good]) < 1e-6).all(axis=1) & (size > 0)

    def wald(self, s: np.ndarray, which: np.ndarray) -> tuple[float | None, float | None, int]:
        b, v = self.beta[which], (self.inverse @ s @ self.inverse)[np.ix_(which, which)]
        size = np.sqrt(np.maximum(np.diag(v), 0))
        if not self.determined[which].all() or not (size > 0).all():
            return None, None, len(which)
        scaled = v / size[:, None] / size[None, :]
        if np.linalg.eigvalsh(scaled)[0] <= SINGULAR:
            return None, None, len(which)
        stat = float(b / size @ np.linalg.solve(scaled, b / size))
        return stat, chi2_sf(stat, len(which)), len(which)


def _plan(packed: DataFrame, keys: list[str], specs: list[tuple[int, int, str]]) -> DataFrame:
    listed = F.array(*[F.struct(F.lit(e).alias("e"), F.lit(p).alias("p"), F.lit(rule).alias("rule")) for e, p, rule in specs])
    return packed.select(*keys).distinct().withColumn("specs", listed)


def hac_wald(rows: DataFrame, keys: list[str], y: str, x: list[str], tested: list[str], time: str = "open_time") -> DataFrame:
    """(keys, n, wald, p_value, df): OLS of y on x with a constant, Newey-West lags by n, over rows without nulls in order of time."""

    def design(data: np.ndarray, e: int, p: int) -> tuple[np.ndarray, np.ndarray]:
        got = data[np.isfinite(data).all(axis=1)]
        return got[:, 0], np.column_stack((np.ones(len(got)), got[:, 1:]))

    packed = packs(rows, keys, [y, *x], time)
    at = [1 + x.index(c) for c in tested]
    got = Regressions(packed, keys, design).hac(_plan(packed, keys, [(0, 0, "")]), lambda e, p: at)
    return got.filter(F.col("n") > len(x) + 1).drop("e", "p", "rule")


def granger(
    rows: DataFrame, keys: list[str], ret: str, news: list[str], lags: tuple[int, ...] = (1, 6, 24), most: int = 24, target: str = "target", valid: str = "valid",
    time: str = "open_time", test_start: datetime | None = None,
) -> DataFrame:
    """(keys, direction, dependent, sample, lags, rule, n, wald, p_value, df): whether news lead returns, and returns news.

    Forwards, the next return (of valid rows) is regressed on lags of the return and of all news columns, whose
    coefficients are tested together; backwards, each news column an hour later on lags of itself and of the return.
    Lags 0 .. p-1 are the row's own hour and those before it. Samples are all hours and, if test_start is given, those
    from it on. The entry `bic` has the lag with the least BIC on the rows where `most` lags are complete, read from
    parts of one matrix of moments; every entry is then fitted on all rows where its own lags are.
    """
    sources = [ret, *news]
    equations = [("news to return", "return", list(range(len(sources))))] + [("return to news", c, [1 + i, 0]) for i, c in enumerate(news)]
    samples = ("full", "test")[: 1 + (test_start is not None)]
    asked = [(d, c, s) for d, c, _ in equations for s in samples]
    w = Window.partitionBy(*keys).orderBy(time)
    deep = max(most, *lags)
    late = F.lit(False) if test_start is None else F.col(time) >= F.lit(test_start)
    outcome = [F.when(F.col(valid), F.col(target)), *(F.lead(c).over(w) for c in news)]
    wide = rows.select(*keys, time, late.cast("double").alias("late"), *[y.alias(f"y{i}") for i, y in enumerate(outcome)], *[F.lag(c, k).over(w).alias(f"x{i}_{k}") for i, c in enumerate(sources) for k in range(deep)])
    first = 1 + len(outcome)

    def design(data: np.ndarray, e: int, p: int) -> tuple[np.ndarray, np.ndarray]:
        equation, sample = divmod(e, len(samples))
        y = data[:, 1 + equation]
        x = np.column_stack((np.ones(len(y)), *(data[:, first + i * deep : first + i * deep + p] for i in equations[equation][2])))
        ok = np.isfinite(y) & np.isfinite(x).all(axis=1) & ((data[:, 0] > 0) if sample else True)
        return y[ok], x[ok]

    def least_bic(e: int, n: int, yy: float, xy: list, xx: list) -> int | None:
        number = len(equations[e // len(samples)][2])
        xy, xx = np.array(xy), np.array(xx).reshape(len(xy), len(xy))
        if n <= 1 + most * number:
            return None
        found = []
        for p in range(1, most + 1):
            at = np.array([0, *(1 + i * most + k for i in range(number) for k in range(p))])
            beta = Moments(xy[at], xx[np.ix_(at, at)]).beta
            sse = yy - 2 * beta @ xy[at] + beta @ xx[np.ix_(at, at)] @ beta
            found.append((n * math.log(max(float(sse) / n, 1e-300)) + len(at) * math.log(n), p))
        return min(found)[1]

    packed = packs(wide, keys, wide.columns[len(keys) + 1 :], time)
    all_of = Regressions(packed, keys, design)
    common = all_of.moments(_plan(packed, keys, [(e, most, "bic") for e in range(len(asked))]))
    best = common.withColumn("p", F.udf(least_bic, "int")("e", "n", "yy", "xy", "xx")).filter("p is not null")  # a row a regression
    best = best.groupBy(*keys).agg(F.collect_list(F.struct("e", "p", "rule")).alias("more"))
    fixed = _plan(packed, keys, [(e, p, "fixed") for e in range(len(asked)) for p in lags])
    plan = fixed.join(best, keys, "left").select(*keys, F.concat("specs", F.coalesce("more", F.array().cast(fixed.schema["specs"].dataType))).alias("specs"))
    got = all_of.hac(plan, lambda e, p: list(range(1 + p, 1 + p * len(equations[e // len(samples)][2]))))
    named = F.array(*[F.struct(F.lit(d).alias("direction"), F.lit(c).alias("dependent"), F.lit(s).alias("sample")) for d, c, s in asked])
    return got.withColumn("__a", named[F.col("e")]).select(*keys, "__a.*", F.col("p").alias("lags"), "rule", "n", "wald", "p_value", "df")


#: Response surface for the p-value of the unit-root test with a constant (MacKinnon, 1994): fixed values.
ADF_LOW, ADF_MIN, ADF_MAX = -1.61, -18.83, 2.74
ADF_SMALL = (2.1659, 1.4412, 0.038269)
ADF_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)


def adf_p_value(t: float) -> float:
    if t <= ADF_MIN:
        return 0.0
    if t >= ADF_MAX:
        return 1.0
    z = sum(c * t**k for k, c in enumerate(ADF_SMALL if t <= ADF_LOW else ADF_LARGE))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def adf(rows: DataFrame, keys: list[str], value: str, most: int = 24, time: str = "open_time") -> DataFrame:
    """(keys, n, lags, t, p_value): unit-root test with a constant over the values that are not null, in order of time.

    The lag has the least AIC on the rows where the longest lag is complete, read from parts of one matrix of moments. A
    series of fewer than 12 values has no row; t is null where the rows don't determine it.
    """
    w = Window.partitionBy(*keys).orderBy(time)
    level = rows.filter(F.col(value).isNotNull()).select(*keys, time, F.col(value).cast("double").alias("__v"))
    level = level.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter("__n >= 12")
    steps = level.select(*keys, time, "__n", F.lag("__v").over(w).alias("__before"), (F.col("__v") - F.lag("__v").over(w)).alias("__d"))
    wide = steps.select(*keys, time, "__d", "__before", *[F.lag("__d", k).over(w).alias(f"__d{k}") for k in range(1, most + 1)])
    longest = level.groupBy(*keys).agg(F.least(F.lit(most), F.greatest(F.lit(0), F.floor(F.max("__n") / 2).cast("int") - 3)).alias("__top"))

    def design(data: np.ndarray, e: int, p: int) -> tuple[np.ndarray, np.ndarray]:
        got = data[np.isfinite(data[:, : 2 + p]).all(axis=1)]
        return got[:, 0], np.column_stack((np.ones(len(got)), got[:, 1 : 2 + p]))

    def least_aic(n: int, yy: float, xy: list, xx: list) -> int:
        xy, xx = np.array(xy), np.array(xx).reshape(len(xy), len(xy))
        found = []
        for k in range(2, len(xy) + 1):
            beta = Moments(xy[:k], xx[:k, :k]).beta
            sse = float(yy - 2 * beta @ xy[:k] + beta @ xx[:k, :k] @ beta)
            found.append((n * (math.log(max(sse / n, 1e-300)) + math.log(2 * math.pi) + 1) + 2 * k, k - 2))
        return min(found)[1]

    def t_value(n: int, yy: float, xy: list, xx: list) -> tuple[float | None, float | None]:
        one, xy = Moments(np.array(xy), np.array(xx)), np.array(xy)
        sse = float(yy - one.beta @ xy)
        if n <= len(xy) or not one.determined[1]:
            return None, None
        t = float(one.beta[1] / math.sqrt(max(sse / (n - len(xy)) * one.inverse[1, 1], 1e-300)))
        return t, adf_p_value(t)

    packed = packs(wide, keys, wide.columns[len(keys) + 1 :], time)
    all_of = Regressions(packed, keys, design)
    spec = lambda p: F.array(F.struct(F.lit(0).alias("e"), F.col(p).alias("p"), F.lit("").alias("rule"))).alias("specs")
    common = all_of.moments(longest.select(*keys, spec("__top")))
    best = common.withColumn("lags", F.udf(least_aic, "int")("n", "yy", "xy", "xx"))
    final = all_of.moments(best.select(*keys, spec("lags")))
    got = final.withColumn("__t", F.udf(t_value, "t double, p_value double")("n", "yy", "xy", "xx"))
    return got.select(*keys, "n", F.col("p").alias("lags"), "__t.t", "__t.p_value")
