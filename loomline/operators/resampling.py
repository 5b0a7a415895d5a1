"""Bootstrap intervals and the model confidence set.

A draw of the stationary bootstrap is a list of blocks, and a series is kept as circular prefix sums of its values and
squares: the sums over a draw are two look-ups a block, so a draw costs its number of blocks, not the series' length. A
task has one series of one name, as long as its hours, and gives its draws in chunks; names meet chunk by chunk, so that
none has all names' draws. A replicate's random numbers come from (seed, replicate) and the length alone: names of one
length are drawn alike, and results depend neither on chunks nor on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def stationary_blocks(n: int, mean_block: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of blocks on a ring of n: geometric lengths with the given mean, the last cut so that they sum to n."""
    drawn, total = [], 0
    while total < n:
        drawn.append(rng.geometric(1 / mean_block, int((n - total) / mean_block * 1.2) + 8))
        total += int(drawn[-1].sum())
    lengths = np.concatenate(drawn)
    upto = np.cumsum(lengths)
    last = int(np.searchsorted(upto, n))
    lengths = lengths[: last + 1]
    lengths[last] -= upto[last] - n
    return rng.integers(0, n, last + 1), lengths


def stationary_index(n: int, mean_block: float, rng: np.random.Generator) -> np.ndarray:
    """The n positions of stationary_blocks, one by one."""
    starts, lengths = stationary_blocks(n, mean_block, rng)
    return (np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(n)) % n


def ring_sums(x: np.ndarray) -> np.ndarray:
    """Prefix sums of twice x, along the last axis, from 0: the block (start, length) sums to [start + length] less [start]."""
    return np.concatenate([np.zeros((*x.shape[:-1], 1)), np.cumsum(np.concatenate([x, x], axis=-1), axis=-1)], axis=-1)


def drawn_sums(x: np.ndarray, reps: range, mean_block: float, seed: int) -> np.ndarray:
    """(rows of x, replicates): each row's sum over each replicate's draw."""
    ring, n = ring_sums(x), x.shape[-1]
    out = np.empty((len(x), len(reps)))
    for i, rep in enumerate(reps):
        starts, lengths = stationary_blocks(n, mean_block, np.random.default_rng([seed, rep]))
        out[:, i] = (ring[:, starts + lengths] - ring[:, starts]).sum(axis=-1)
    return out


def sharpe(n: int, mean: np.ndarray, squares: np.ndarray, per_year: float, least: float = 0.0) -> np.ndarray:
    """Annual Sharpe ratios from means and sums of squares about them; nan where these aren't above least."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(squares > least, mean / np.sqrt(np.maximum(squares, 0) / (n - 1)) * np.sqrt(per_year), np.nan)


def drawn_sharpes(x: np.ndarray, reps: range, mean_block: float, seed: int, per_year: float) -> tuple[float, np.ndarray]:
    """The Sharpe ratio of x and those of its draws; nan without variation.

    x is centred before it is summed. A draw whose squares are below 1e-12 of the series' own has no variation: that is
    what rounding leaves of equal values.
    """
    n, mean = len(x), x.mean()
    if n < 2 or x.min() == x.max():
        return np.nan, np.full(len(reps), np.nan)
    c = x - mean
    one, two = drawn_sums(np.stack([c, c * c]), reps, mean_block, seed)
    all_squares = (c * c).sum()
    return float(sharpe(n, mean, all_squares, per_year)), sharpe(n, mean + one / n, two - one * one / n, per_year, 1e-12 * all_squares)


def _series(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """(keys, v): each name's values in order; in partitions that aren't joined together, as the draws are the work."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.select(*keys, order, value).repartition(parts, *keys)
    one = spread.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("s"))
    return one.select(*keys, F.col(f"s.{value}").alias("v"))


def _chunks(reps: int, chunk: int) -> Iterator[tuple[int, range]]:
    for at in range(0, reps, chunk):
        yield at // chunk, range(at, min(reps, at + chunk))


def sharpe_interval(net: DataFrame, benchmark: str, reps: int = 2000, mean_block: float = 24.0, seed: int = 1, per_year: float = 8760.0, level: float = 0.95, chunk: int = 100) -> DataFrame:
    """(symbol, name, diff, ci_low, ci_high, share_below, reps) of net(symbol, name, open_time, net).

    diff is the Sharpe ratio less the benchmark's; the interval is by percentiles of a paired stationary bootstrap in
    which all names of a symbol are drawn with the same indices. A name without variation, with a null value, or with
    other than the benchmark's number of hours has no rows.
    """
    series = _series(net, ["symbol", "name"], "net", "open_time")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                x = np.array(row.v, float)
                for number, part in _chunks(reps, chunk):
                    point, got = drawn_sharpes(x, part, mean_block, seed, per_year)
                    yield pd.DataFrame({"symbol": [row.symbol], "name": [row.name], "n": [len(x)], "chunk": [number], "point": [point], "got": [got]})

    # a symbol's name has one row a chunk; the benchmark's are met by symbol, length and chunk
    drawn = cut(series.mapInPandas(run, "symbol string, name string, n long, chunk long, point double, got array<double>"))
    base = drawn.filter(F.col("name") == benchmark).select("symbol", "n", "chunk", F.col("point").alias("point_b"), F.col("got").alias("got_b"))
    both = drawn.filter(F.col("name") != benchmark).join(base, ["symbol", "n", "chunk"])
    apart: Column = F.zip_with("got", "got_b", lambda a, b: a - b)
    draws = both.select("symbol", "name", (F.col("point") - F.col("point_b")).alias("point"), F.explode(apart).alias("diff")).filter("diff is not null and point is not null and not isnan(diff) and not isnan(point)")
    tail = (1 - level) / 2
    return draws.groupBy("symbol", "name").agg(
        F.first("point").alias("diff"), F.percentile("diff", F.lit(tail)).alias("ci_low"), F.percentile("diff", F.lit(1 - tail)).alias("ci_high"),
        F.avg((F.col("diff") <= 0).cast("double")).alias("share_below"), F.count(F.lit(1)).alias("reps"),
    )


def elimination(d: np.ndarray, sd: np.ndarray) -> tuple[list[int], list[float]]:
    """The order in which models leave, and the range statistic before each leaves: both follow from the pairs alone.

    d: differences of mean losses; sd: their bootstrap deviations, of which a zero is taken as 1e-300 and the diagonal as 1.
    """
    sd = np.where(sd == 0, 1e-300, sd)
    np.fill_diagonal(sd, 1)
    t, alive, order, limits = d / sd, list(range(len(d))), [], []
    while len(alive) > 1:
        live = t[np.ix_(alive, alive)]
        limits.append(float(np.abs(live).max()))
        order.append(alive.pop(int(live.max(axis=1).argmax())))
    return [*order, alive[0]], limits


def range_statistics(v: np.ndarray, order: list[int], sd: np.ndarray) -> np.ndarray:
    """(steps, draws): the range statistic of each draw among the models left at each step, built from the last two up."""
    sd = np.where(sd == 0, 1e-300, sd)
    out = np.zeros((len(order) - 1, v.shape[1]))
    best = np.zeros(v.shape[1])
    for step in range(len(order) - 2, -1, -1):
        i, rest = order[step], order[step + 1 :]
        best = np.maximum(best, (np.abs(v[i] - v[rest]) / sd[i, rest][:, None]).max(axis=0))
        out[step] = best
    return out


def model_confidence_set(predictions: DataFrame, alpha: float = 0.1, reps: int = 1000, mean_block: float = 24.0, seed: int = 1, chunk: int = 100) -> DataFrame:
    """(symbol, model, p_value, kept) with the range statistic (Hansen, Lunde and Nason, 2011).

    Models of a symbol need the same hours without nulls, as metrics.common_rows leaves them; other lengths are an error.
    A chunk of draws holds all models of a symbol, and sends each pair's squared differences. The sums give the order in
    which models leave, so that every chunk then counts, for each step, its draws at or above the statistic.
    """
    loss = predictions.withColumn("loss", F.pow(F.col("y_true") - F.col("y_pred"), 2))
    series = _series(loss, ["symbol", "model"], "loss", "open_time")

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                x = np.array(row.v, float)
                centred = (x - x.mean())[None, :]
                for number, part in _chunks(reps, chunk):
                    v = drawn_sums(centred, part, mean_block, seed)[0] / len(x)
                    yield pd.DataFrame({"symbol": [row.symbol], "model": [row.model], "n": [len(x)], "chunk": [number], "mean": [x.mean()], "v": [v]})

    drawn = series.mapInPandas(draw, "symbol string, model string, n long, chunk long, mean double, v array<double>")
    panels = cut(drawn.groupBy("symbol", "chunk").agg(F.sort_array(F.collect_list(F.struct("model", "n", "mean", "v"))).alias("s")))

    def pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                if len({x["n"] for x in row.s}) > 1:
                    raise ValueError(f"models of {row.symbol} have different numbers of hours")
                v, mean, names = np.array([x["v"] for x in row.s]), np.array([x["mean"] for x in row.s]), [x["model"] for x in row.s]
                for i, name in enumerate(names):
                    j = np.arange(len(names))
                    yield pd.DataFrame({"symbol": row.symbol, "chunk": row.chunk, "model": name, "i": i, "j": j, "d": mean[i] - mean, "s": ((v[i] - v) ** 2).sum(axis=1)})

    sums = panels.mapInPandas(pairs, "symbol string, chunk long, model string, i int, j int, d double, s double")
    in_order = F.aggregate(F.sort_array(F.collect_list(F.struct("chunk", "s"))), F.lit(0.0), lambda a, x: a + x["s"])  # equal sums in every run
    sums = sums.groupBy("symbol", "i", "j").agg(F.first("model").alias("model"), F.first("d").alias("d"), F.sqrt(in_order / reps).alias("sd"))
    square = sums.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("i", "j", "model", "d", "sd"))).alias("s"))

    def leave(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                m = int(np.sqrt(len(row.s)))
                d, sd = (np.array([x[c] for x in row.s]).reshape(m, m) for c in ("d", "sd"))
                order, limits = elimination(d, sd)
                names = [row.s[i * m]["model"] for i in order]
                yield pd.DataFrame({"symbol": [row.symbol], "leavers": [names], "turns": [order], "limits": [limits], "sd": [sd.ravel()]})

    turns = cut(square.mapInPandas(leave, "symbol string, leavers array<string>, turns array<int>, limits array<double>, sd array<double>"))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                order = list(row.turns)
                sd = np.array(row.sd).reshape(len(order), len(order))
                got = range_statistics(np.array([x["v"] for x in row.s]), order, sd) >= np.array(row.limits)[:, None]
                yield pd.DataFrame({"symbol": row.symbol, "step": np.arange(len(order) - 1), "n": got.sum(axis=1)})

    counts = panels.join(turns.select("symbol", "turns", "limits", "sd"), "symbol").mapInPandas(count, "symbol string, step int, n long")
    counts = counts.groupBy("symbol", "step").agg((F.sum("n") / reps).alias("p"))
    steps = turns.select("symbol", F.posexplode("leavers").alias("step", "model")).join(counts, ["symbol", "step"], "left")
    upto = F.max(F.coalesce("p", F.lit(1.0))).over(Window.partitionBy("symbol").orderBy("step"))  # a row a model; the last one has 1
    return steps.withColumn("p_value", upto).select("symbol", "model", "p_value", (F.col("p_value") >= alpha).alias("kept"))


def cell_patterns(pairs: DataFrame, truth: str, predicted: str, model: str) -> DataFrame:
    """(c, n): the sets of cells that items have, with how often, and the items of each."""
    cells = pairs.groupBy("item", model, truth, predicted).agg(F.count(F.lit(1)).alias("times"))
    items = cells.groupBy("item").agg(F.sort_array(F.collect_list(F.struct(model, truth, predicted, "times"))).alias("c"))
    return items.groupBy("c").agg(F.count(F.lit(1)).alias("n"))


def f1_interval(pairs: DataFrame, truth: str, predicted: str, model: str, classes: list, reps: int = 1000, seed: int = 1, level: float = 0.95, chunk: int = 100) -> DataFrame:
    """(model, macro_f1, ci_low, ci_high): percentile interval of macro F1; rows are weighted alike for all models.

    pairs(item, model, truth, predicted): items with equal cells (model, truth, predicted) are one pattern, and a
    replicate draws multinomial weights over the counts of patterns, which has the distribution of drawing items. A task
    holds the patterns, of which two models and two classes have at most 16, however many items there are.
    """
    tasks = pairs.sparkSession.range(-(-reps // chunk)).select(F.col("id").alias("chunk"))
    packed = cell_patterns(pairs, truth, predicted, model).agg(F.sort_array(F.collect_list(F.struct("c", "n"))).alias("patterns"))
    kind = pairs.schema[model].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                names = sorted({c[model] for x in row.patterns for c in x["c"]})
                count = np.array([x["n"] for x in row.patterns], np.int64)
                cell = np.zeros((len(count), len(names), len(classes), len(classes)))
                for i, x in enumerate(row.patterns):
                    for c in x["c"]:
                        cell[i, names.index(c[model]), classes.index(c[truth]), classes.index(c[predicted])] += c["times"]
                for rep in range(row.chunk * chunk - (row.chunk == 0), min(reps, (row.chunk + 1) * chunk)):
                    n = int(count.sum())
                    w = count if rep < 0 else np.random.default_rng([seed, rep]).multinomial(n, count / n)
                    total = np.tensordot(w, cell, 1)
                    both = total.sum(axis=1) + total.sum(axis=2)
                    f1 = np.where(both > 0, 2 * np.diagonal(total, axis1=1, axis2=2) / np.maximum(both, 1e-300), 0).mean(axis=1)
                    yield pd.DataFrame({"model": names, "rep": rep, "f1": f1})

    draws = tasks.crossJoin(packed).repartition("chunk").mapInPandas(run, f"model {kind}, rep long, f1 double")
    tail = (1 - level) / 2
    sampled = F.when(F.col("rep") >= 0, F.col("f1"))
    return draws.groupBy("model").agg(
        F.max(F.when(F.col("rep") < 0, F.col("f1"))).alias("macro_f1"), F.percentile(sampled, F.lit(tail)).alias("ci_low"), F.percentile(sampled, F.lit(1 - tail)).alias("ci_high")
    )


def permuted(table: DataFrame, columns: list[str], keys: list[str], seed: int, time: str = "open_time") -> DataFrame:
    """table with columns taken from a random other row of the same keys: two row numbers, one by a seeded hash."""
    order = Window.partitionBy(*keys).orderBy(time)
    mixed = Window.partitionBy(*keys).orderBy(F.xxhash64(F.lit(seed), time), time)
    left = table.drop(*columns).withColumn("__r", F.row_number().over(order))
    right = table.select(*keys, *columns, F.row_number().over(mixed).alias("__r"))
    return left.join(right, [*keys, "__r"]).drop("__r")
