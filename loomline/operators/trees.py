"""Forests and gradient boosting by symbol, from histograms that Spark adds up.

Rows are binned once by quantiles of each symbol's and window's training rows and packed a block of hours to a row. To
grow trees, tasks send the sums of gradients and the counts of each open node, feature and bin of their blocks; an
aggregate adds them, a window runs over the bins, and the best split of every node comes back: one job a level for all
symbols, windows, seeds and trees at once. Only splits reach the driver, never rows. Splits maximise G_l^2 / (n_l +
penalty) + G_r^2 / (n_r + penalty); a leaf's value is -G / (n + penalty).

A tree without a depth bound may have at most `leaves` leaves. It is grown by levels, and then the splits that best-first
growth would have made, the one with the greatest gain among those open each time, are kept.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as Frame
from pyspark.sql import functions as F

from .splits import Window, as_table

#: Bins of a feature; hours of a block; trees of each model that are grown together; rounds between writing margins.
BINS, HOURS, TOGETHER, FRESH = 64, 4096, 100, 16
#: Histograms that a task holds before it sends them.
HELD = 4000
UNIT = ["symbol", "fold"]
NODE = [*UNIT, "seed", "tree", "node"]


class Tree:
    """Nodes by number: feature (-1 for a leaf) and bin of the split (up to it goes left), children, value."""

    def __init__(self, value: float = 0.0):
        self.feature, self.bin, self.left, self.right, self.value, self.gain = [-1], [0], [0], [0], [value], [0.0]
        self.arrays = None

    def split(self, node: int, feature: int, edge: int, gain: float, left: float, right: float) -> tuple[int, int]:
        for value in (left, right):
            for own, v in ((self.feature, -1), (self.bin, 0), (self.left, 0), (self.right, 0), (self.value, value), (self.gain, 0.0)):
                own.append(v)
        a, b = len(self.value) - 2, len(self.value) - 1
        self.feature[node], self.bin[node], self.left[node], self.right[node], self.gain[node] = feature, edge, a, b, gain
        self.arrays = None
        return a, b

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins (n, features)."""
        if self.arrays is None:
            self.arrays = [np.array(v, np.int64) for v in (self.feature, self.bin, self.left, self.right)]
        feature, edge, left, right = self.arrays
        at, row = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while len(row):
            row = row[feature[at[row]] >= 0]
            now = at[row]
            at[row] = np.where(bins[row, feature[now]] <= edge[now], left[now], right[now])
        return at

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(bins)]

    def best_first(self, leaves: int) -> None:
        """Keeps the leaves - 1 splits that best-first growth makes."""
        open_, kept = [(-self.gain[0], 0)] if self.feature[0] >= 0 else [], set()
        while open_ and len(kept) < leaves - 1:
            _, node = heapq.heappop(open_)
            kept.add(node)
            for child in (self.left[node], self.right[node]):
                if self.feature[child] >= 0:
                    heapq.heappush(open_, (-self.gain[child], child))
        self.feature, self.arrays = [f if k in kept else -1 for k, f in enumerate(self.feature)], None


@dataclass(frozen=True)
class Growth:
    """What a tree may do: rows of a split's sides, depth (None: no bound) and leaves, the penalty, shares of rows and columns."""

    leaf: int
    depth: int | None
    leaves: int
    penalty: float
    rows: float
    columns: float | str
    by_node: bool

    def count(self, features: int) -> int:
        """Columns of a draw: the root of their number, or a share of it, rounded down."""
        return max(1, int(math.sqrt(features)) if self.columns == "sqrt" else int(float(self.columns) * features + 1e-9))

    def drawn(self, features: int, seed: int, tree: int, node: int) -> np.ndarray:
        key = [seed, tree, node] if self.by_node else [seed, tree]
        return np.sort(np.random.default_rng(key).permutation(features)[: self.count(features)])


def uniform(t: np.ndarray, *salt: int) -> np.ndarray:
    """Numbers from 0 to 1 that depend on the hours t and the salt alone."""
    h = t.astype(np.uint64)
    for s in (*salt, 0x5BD1):
        h = (h ^ np.uint64(s + 0x9E37)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(11)).astype(np.float64) / 2.0**53


def packed(table: DataFrame, columns: list[str], windows: list[Window], held: float) -> DataFrame:
    """(symbol, fold, block, mean, t, role, y, bins, margin): blocks of valid rows; role 0 teaches, 1 is held out, 2 is forecast.

    Held out are the last `held` of a unit's training rows, one at least. Bins and the mean come from the rows that teach.
    """
    spans = as_table(table.sparkSession, windows).withColumnRenamed("name", "fold")
    rows = table.filter("valid").select("symbol", "open_time", F.col("target").cast("double").alias("y"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    rows = rows.join(F.broadcast(spans), (F.col("open_time") < F.col("train_end")) | (F.col("open_time") >= F.col("test_start")) & (F.col("open_time") < F.col("test_end")))
    rows = rows.withColumn("teaches", F.col("open_time") < F.col("train_end"))
    late = F.row_number().over(Frame.partitionBy(*UNIT, "teaches").orderBy(F.desc("open_time")))
    many = F.count(F.lit(1)).over(Frame.partitionBy(*UNIT, "teaches"))
    out = F.greatest(F.lit(1), F.bround(many * F.lit(held)).cast("int")) if held else F.lit(0)
    rows = rows.withColumn("role", F.when(~F.col("teaches"), 2).when(late <= out, 1).otherwise(0))
    teach = rows.filter("role = 0").groupBy(*UNIT)
    shares = F.array(*[F.lit((k + 1) / BINS) for k in range(BINS - 1)])
    edges = F.array(*[F.percentile_approx(f"x{i}", shares, F.lit(10_000)) for i in range(len(columns))])
    rows = rows.join(teach.agg(F.avg("y").alias("mean"), edges.alias("edges")), UNIT)
    hour = F.floor(F.unix_seconds("open_time") / 3600)
    rows = rows.select(*UNIT, F.floor(hour / HOURS).alias("block"), "mean", "edges", hour.alias("t"), "role", "y", *[f"x{i}" for i in range(len(columns))])

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t")
        x = frame[[f"x{i}" for i in range(len(columns))]].to_numpy(float)
        cuts = frame["edges"].iloc[0]
        bins = np.stack([np.searchsorted(np.unique(np.asarray(e, float)), x[:, i], side="left") for i, e in enumerate(cuts)], axis=1).astype(np.uint8)
        own = [frame["t"].to_numpy(np.int64), frame["role"].to_numpy(np.int8), frame["y"].to_numpy(float), bins]
        return pd.DataFrame([(*key, float(frame["mean"].iloc[0]), *(v.tobytes() for v in own), b"")], columns=[*UNIT, "block", "mean", "t", "role", "y", "bins", "margin"])

    return rows.groupBy(*UNIT, "block").applyInPandas(pack, "symbol string, fold string, block long, mean double, t binary, role binary, y binary, bins binary, margin binary")


def _read(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    t, role, y = np.frombuffer(row.t, np.int64), np.frombuffer(row.role, np.int8), np.frombuffer(row.y)
    return t, role, y, np.frombuffer(row.bins, np.uint8).reshape(len(t), -1)


@dataclass
class Ensemble:
    """A unit's and a seed's trees: those whose sum the blocks' margins hold, and those that came after."""

    done: list[Tree] = field(default_factory=list)
    fresh: list[Tree] = field(default_factory=list)


Key = tuple[str, str, int]
#: The trees in growth of each model, and their nodes that may be split.
Open = dict[Key, dict[int, tuple[Tree, list[int]]]]


def histograms(row, trees: Open, grown: dict[Key, Ensemble] | None, growth: Growth, features: int, seeds: tuple[int, ...], held: dict[tuple, np.ndarray]) -> None:
    """Adds the sums of gradients and the counts of a block, by drawn feature and bin of each open node, to held."""
    t, role, y, bins = _read(row)
    drawn = growth.count(features)
    for number, seed in enumerate(seeds):
        asked = trees.get((row.symbol, row.fold, seed))
        if asked is None:
            continue
        gradient = -y
        if grown is not None:
            gradient = margins(row, bins, number, grown[row.symbol, row.fold, seed].fresh) - y
            out = gradient[role == 1]
            held.setdefault((row.symbol, row.fold, seed, -1, 0), np.zeros((2, drawn, BINS)))[:, 0, 0] += out @ out, len(out)
        for number_of, (tree, nodes) in asked.items():
            on = np.flatnonzero((role == 0) & (uniform(t, seed, number_of) < growth.rows))
            place = np.full(len(tree.value), -1)
            place[nodes] = np.arange(len(nodes))
            at = place[tree.nodes(bins[on])]
            on, at = on[at >= 0], at[at >= 0]
            columns = np.stack([growth.drawn(features, seed, number_of, k) for k in nodes])[at]
            cell = ((at[:, None] * drawn + np.arange(drawn)) * BINS + bins[on[:, None], columns]).ravel()
            n = np.bincount(cell, minlength=len(nodes) * drawn * BINS).reshape(len(nodes), drawn, BINS)
            g = np.bincount(cell, np.repeat(gradient[on], drawn), n.size).reshape(n.shape)
            for k in np.flatnonzero(n[:, 0].any(axis=1)).tolist():
                own = held.setdefault((row.symbol, row.fold, seed, number_of, nodes[k]), np.zeros((2, drawn, BINS)))
                own[0] += g[k]
                own[1] += n[k]


def best_splits(names: list[tuple], sums: np.ndarray, growth: Growth, features: int) -> pd.DataFrame:
    """The best split of each node by its whole histogram; of splits as good that with the smallest feature and bin."""
    g, n = sums[:, 0], sums[:, 1]
    gl, nl, all_g, all_n = g.cumsum(axis=2), n.cumsum(axis=2), g[:, 0].sum(axis=1), n[:, 0].sum(axis=1)
    gr, nr = all_g[:, None, None] - gl, all_n[:, None, None] - nl
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = gl**2 / (nl + growth.penalty) + gr**2 / (nr + growth.penalty) - (all_g**2 / (all_n + growth.penalty))[:, None, None]
    gain[~((nl >= growth.leaf) & (nr >= growth.leaf))] = -np.inf
    at = gain.reshape(len(names), -1).argmax(axis=1)
    pick = lambda v: v.reshape(len(names), -1)[np.arange(len(names)), at]
    feature = [int(growth.drawn(features, *name[2:])[k]) if name[3] >= 0 else 0 for name, k in zip(names, at // BINS)]
    out = pd.DataFrame(names, columns=NODE)
    return out.assign(g=all_g, n=all_n, gain=np.where(np.isfinite(pick(gain)), pick(gain), np.nan), feature=feature, bin=at % BINS, gl=pick(gl), nl=pick(nl))


class Grower:
    """Grows trees of many models (symbol, fold, seed) together over packed blocks."""

    def __init__(self, packs: DataFrame, features: int, seeds: tuple[int, ...], growth: Growth):
        self.packs, self.features, self.seeds, self.growth = packs, features, seeds, growth

    def splits(self, open_: Open, ensembles: dict[Key, Ensemble] | None) -> pd.DataFrame:
        """(symbol, fold, seed, tree, node, g, n, gain, feature, bin, gl, nl): sums and the best split of open nodes.

        gain is nan where no split is allowed. For boosting g and n of tree -1 are the squared errors and the number of held-out rows.
        """
        growth, features, seeds = self.growth, self.features, self.seeds
        shared = self.packs.sparkSession.sparkContext.broadcast((open_, ensembles))
        shape, kinds = (2, growth.count(features), BINS), "symbol string, fold string, seed int, tree int, node int"

        def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[tuple, np.ndarray] = {}
            for frame in frames:
                for row in frame.itertuples():
                    histograms(row, *shared.value, growth, features, seeds, held)
                    if len(held) >= HELD:
                        yield table(held)
                        held = {}
            if held:
                yield table(held)

        def table(held: dict[tuple, np.ndarray]) -> pd.DataFrame:
            return pd.DataFrame(list(held), columns=NODE).assign(sums=[v.tobytes() for v in held.values()])

        def added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            last = None
            for frame in frames:
                now = np.frombuffer(b"".join(frame["sums"])).reshape(-1, *shape)
                names = list(frame[NODE].itertuples(index=False, name=None))
                if last is not None:
                    names, now = [last[0], *names], np.concatenate((last[1][None], now))
                first = [k for k, name in enumerate(names) if not k or name != names[k - 1]]
                total = np.add.reduceat(now, first, axis=0)
                names = [names[k] for k in first]
                last = names[-1], total[-1]
                if len(names) > 1:
                    yield best_splits(names[:-1], total[:-1], growth, features)
            if last is not None:
                yield best_splits([last[0]], last[1][None], growth, features)

        sent = self.packs.mapInPandas(send, f"{kinds}, sums binary").repartition(*NODE).sortWithinPartitions(*NODE)
        return sent.mapInPandas(added, f"{kinds}, g double, n double, gain double, feature int, bin int, gl double, nl double").toPandas()

    def grow(self, models: list[Key], trees: range, rate: float, ensembles: dict[Key, Ensemble] | None = None) -> tuple[dict[Key, dict[int, Tree]], dict[Key, tuple[float, int]]]:
        """({model: {number: tree}}, {model: (squared error, rows) of the held-out rows before these trees})."""
        growth = self.growth
        grown = {m: {k: Tree() for k in trees} for m in models}
        if growth.depth == 0:
            raise ValueError("a tree needs a depth of one at least")
        open_, errors, level, value = {m: {k: (t, [0]) for k, t in own.items()} for m, own in grown.items()}, {}, 0, lambda g, n: -rate * g / (n + growth.penalty)
        while open_:
            after: dict = defaultdict(dict)
            for r in self.splits(open_, ensembles).sort_values(NODE).itertuples(index=False):
                model = (r.symbol, r.fold, r.seed)
                if r.tree < 0:
                    errors.setdefault(model, (r.g, r.n))
                    continue
                tree = grown[model][r.tree]
                if level == 0:
                    tree.value[0] = value(r.g, r.n)
                if not r.gain > 1e-12 * max(1e-300, r.g * r.g / (r.n + growth.penalty)):  # none allowed is nan
                    continue
                children = tree.split(int(r.node), int(r.feature), int(r.bin), float(r.gain), value(r.gl, r.nl), value(r.g - r.gl, r.n - r.nl))
                big = [c for c, n in zip(children, (r.nl, r.n - r.nl)) if n >= 2 * growth.leaf]
                if big and (growth.depth is None or level + 1 < growth.depth):
                    after[model].setdefault(r.tree, (tree, []))[1].extend(big)
            open_, level = dict(after), level + 1
        for own in grown.values():
            for tree in own.values():
                if len(tree.value) // 2 + 1 > growth.leaves:
                    tree.best_first(growth.leaves)
        return grown, errors


class OneBlock(Grower):
    """Grows the trees of a unit that lies in one block, whose histograms are whole as they are, inside its task."""

    def __init__(self, row, features: int, seeds: tuple[int, ...], growth: Growth):
        super().__init__(row, features, seeds, growth)

    def splits(self, open_: Open, ensembles: dict[Key, Ensemble] | None) -> pd.DataFrame:
        held: dict[tuple, np.ndarray] = {}
        histograms(self.packs, open_, ensembles, self.growth, self.features, self.seeds, held)
        return best_splits(list(held), np.stack(list(held.values())), self.growth, self.features) if held else pd.DataFrame(columns=[*NODE, "gain"])


def in_one_block(packs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units that lie in one block, the others): the first need no sums over tasks."""
    size = packs.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("__n"))
    marked = packs.join(F.broadcast(size), UNIT)  # a row a unit
    return marked.filter("__n = 1").drop("__n"), marked.filter("__n > 1").drop("__n")


def in_tasks(packs: DataFrame, seeds: tuple[int, ...], growth: Growth, features: int, name: str, say: Callable) -> DataFrame:
    """Forecasts of units of one block each, by say(grower, row, models)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                t, role, y, bins = _read(row)
                ahead, models = role == 2, [(row.symbol, row.fold, s) for s in seeds]
                if ahead.any() and (role == 0).any():
                    for (_, _, seed), said in say(OneBlock(row, features, seeds, growth), row, models).items():
                        yield pd.DataFrame({"symbol": row.symbol, "fold": row.fold, "seed": seed, "open_time": pd.to_datetime(t[ahead] * 3600, unit="s"), "y_true": y[ahead], "model": name, "y_pred": said[ahead]})

    spread = packs.repartition(max(1, packs.sparkSession.sparkContext.defaultParallelism), *UNIT)
    return spread.mapInPandas(run, "symbol string, fold string, seed int, open_time timestamp, y_true double, model string, y_pred double")


def margins(row, bins: np.ndarray, number: int, fresh: list[Tree]) -> np.ndarray:
    """What the trees so far say of a block's rows: its stored margins and trees that came after."""
    out = np.full(len(bins), row.mean) if not row.margin else np.frombuffer(row.margin).reshape(-1, len(bins))[number].copy()
    for tree in fresh:
        out += tree.predict(bins)
    return out


def _predicted(packs: DataFrame, seeds: tuple[int, ...], say: Callable, shared, name: str) -> DataFrame:
    """Forecasts of the rows of role 2; say(trees of the model, block, bins, the seed's number) gives them or None."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = shared.value
        for frame in frames:
            for row in frame.itertuples():
                t, role, y, bins = _read(row)
                ahead = role == 2
                for number, seed in enumerate(seeds):
                    if ahead.any() and (own := models.get((row.symbol, row.fold, seed))) is not None:
                        yield pd.DataFrame({"symbol": row.symbol, "fold": row.fold, "seed": seed, "open_time": pd.to_datetime(t[ahead] * 3600, unit="s"), "y_true": y[ahead], "model": name, "y_pred": say(own, row, bins, number)[ahead]})

    return packs.mapInPandas(run, "symbol string, fold string, seed int, open_time timestamp, y_true double, model string, y_pred double")


def _models(packs: DataFrame, seeds: tuple[int, ...]) -> list[Key]:
    return sorted((r.symbol, r.fold, s) for r in packs.select(*UNIT).distinct().collect() for s in seeds)


def forest(table: DataFrame, columns: list[str], windows: list[Window], params: dict, seeds: tuple[int, ...]) -> DataFrame:
    """(symbol, fold, seed, open_time, y_true, model, y_pred): means of trees on .632 of a symbol's rows, columns drawn at each node.

    params: trees (300), depth (10; None for no bound), leaf (50), leaves (4096), columns ("sqrt" or a share).
    """
    growth = Growth(params.get("leaf", 50), params.get("depth", 10), params.get("leaves", 4096), 0.0, 0.632, params.get("columns", "sqrt"), True)
    many = params.get("trees", 300)
    parts = [range(first, min(many, first + TOGETHER)) for first in range(0, many, TOGETHER)]

    def alone(grower: OneBlock, row, models: list[Key]) -> dict[Key, np.ndarray]:
        bins, out = _read(row)[3], dict.fromkeys(models, 0.0)
        for part in parts:
            for m, own in grower.grow(models, part, 1.0)[0].items():
                out[m] = out[m] + np.sum([t.predict(bins) for t in own.values()], axis=0) / many
        return out

    single, several = in_one_block(packed(table, columns, windows, 0.0).cache())
    done = in_tasks(single, seeds, growth, len(columns), "forest", alone)
    models, grower, out = _models(several, seeds), Grower(several, len(columns), seeds, growth), None
    for part in parts if models else ():
        grown, _ = grower.grow(models, part, 1.0)
        shared = table.sparkSession.sparkContext.broadcast({m: list(own.values()) for m, own in grown.items()})
        part = _predicted(several, seeds, lambda own, row, bins, number: np.sum([t.predict(bins) for t in own], axis=0), shared, "forest")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return done
    return done.unionByName(out.groupBy("symbol", "fold", "seed", "open_time", "model").agg(F.first("y_true").alias("y_true"), (F.sum("y_pred") / F.lit(many)).alias("y_pred")))


def boosting(table: DataFrame, columns: list[str], windows: list[Window], params: dict, seeds: tuple[int, ...]) -> DataFrame:
    """(symbol, fold, seed, open_time, y_true, model, y_pred): boosted trees, stopped early on the last tenth of the training rows.

    params: rounds (100), patience (50), depth (3), rate (0.05), leaf (20), rows (0.8) and columns (0.8) of each tree,
    penalty (1.0) on leaf values. A model keeps the trees up to its least held-out error.
    """
    growth = Growth(params.get("leaf", 20), params.get("depth", 3), 1 << 30, params.get("penalty", 1.0), params.get("rows", 0.8), params.get("columns", 0.8), False)
    rate, rounds, patience = params.get("rate", 0.05), params.get("rounds", 100), params.get("patience", 50)

    def rounds_of(grower_of: Callable[[], Grower], models: list[Key], each: Callable[[int, dict[Key, Ensemble]], None]) -> dict[Key, list[Tree]]:
        """The trees of each model up to its least held-out error."""
        ensembles, best, active = {m: Ensemble() for m in models}, {m: (math.inf, 0) for m in models}, list(models)
        for k in range(rounds + 1):
            grown, errors = grower_of().grow(active, range(k, k + 1), rate, ensembles)
            for m in active:
                best[m] = min(best[m], (errors[m][0] / max(1, errors[m][1]) if m in errors else math.inf, k))
            active = [m for m in active if k - best[m][1] < patience] if k < rounds else []
            if not active:
                break
            for m in active:
                ensembles[m].fresh.append(grown[m][k])
            each(k, ensembles)
        return {m: (e.done + e.fresh)[: best[m][1]] for m, e in ensembles.items()}

    def alone(grower: OneBlock, row, models: list[Key]) -> dict[Key, np.ndarray]:
        bins, now = _read(row)[3], [grower]

        def stored(k: int, ensembles: dict[Key, Ensemble]) -> None:
            if (k + 1) % FRESH == 0:
                block = now[0].packs
                kept = np.stack([margins(block, bins, i, ensembles[m].fresh) for i, m in enumerate(models)])
                now[0] = OneBlock(block._replace(margin=kept.tobytes()), len(columns), seeds, growth)
                for e in ensembles.values():
                    e.done, e.fresh = e.done + e.fresh, []

        made = rounds_of(lambda: now[0], models, stored)
        return {m: np.full(len(bins), row.mean) + sum(t.predict(bins) for t in own) for m, own in made.items()}

    single, several = in_one_block(packed(table, columns, windows, 0.1).cache())
    done = in_tasks(single, seeds, growth, len(columns), "boosting", alone)
    models, now = _models(several, seeds), [several]
    if not models:
        return done

    def each(k: int, ensembles: dict[Key, Ensemble]) -> None:
        if (k + 1) % FRESH == 0:
            now[0] = _refreshed(now[0], seeds, ensembles, now[0] is not several)

    made = rounds_of(lambda: Grower(now[0], len(columns), seeds, growth), models, each)
    shared = table.sparkSession.sparkContext.broadcast(made)
    say = lambda own, row, bins, number: np.full(len(bins), row.mean) + (np.sum([t.predict(bins) for t in own], axis=0) if own else 0.0)
    return done.unionByName(_predicted(several, seeds, say, shared, "boosting"))


def _refreshed(packs: DataFrame, seeds: tuple[int, ...], ensembles: dict[Key, Ensemble], drop: bool) -> DataFrame:
    """The blocks with margins that hold all trees so far."""
    shared = packs.sparkSession.sparkContext.broadcast({m: e.fresh for m, e in ensembles.items()})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.copy()
            frame["margin"] = [np.stack([margins(row, _read(row)[3], i, shared.value[row.symbol, row.fold, s]) for i, s in enumerate(seeds)]).tobytes() for row in frame.itertuples()]
            yield frame

    after = packs.mapInPandas(run, packs.schema).cache()
    after.count()
    if drop:
        packs.unpersist()
    for e in ensembles.values():
        e.done, e.fresh = e.done + e.fresh, []
    return after
