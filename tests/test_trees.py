"""Trees from added histograms, against plain recursive and best-first growth."""

import heapq
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.operators import forecast, splits, trees

from .test_evaluation import T0

COLUMNS = ["a", "b", "c"]


def table(spark, symbols=("x", "y"), n=260, seed=0):
    rows = []
    for k, s in enumerate(symbols):
        rng = np.random.default_rng(seed + k)
        v = rng.normal(size=(n, 3))
        y = np.where(v[:, 0] > 0, 1.0, -0.5) + 0.7 * v[:, 1] * (v[:, 2] > 0.3) + 0.2 * rng.normal(size=n)
        rows += [(s, T0 + timedelta(hours=i), *map(float, v[i]), float(y[i]), i % 29 != 5) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, open_time timestamp, a double, b double, c double, target double, valid boolean")


WINDOWS = [splits.Window(f"f{k}", T0 + timedelta(hours=a - 3), T0 + timedelta(hours=a), T0 + timedelta(hours=a + 30)) for k, a in enumerate((200, 230))]


def units(spark, monkeypatch, hours, held):
    """{(symbol, fold): (hours, role, y, bins, mean)} of the packed table, blocks in order."""
    monkeypatch.setattr(trees, "HOURS", hours)
    out = {}
    for r in sorted(trees.packed(table(spark).repartition(5), COLUMNS, WINDOWS, held).collect(), key=lambda r: r.block):
        t, role, y, bins = trees._read(r)
        out.setdefault((r.symbol, r.fold), []).append((t, role, y, bins, np.full(len(t), r["mean"])))
    return {k: tuple(np.concatenate(v) for v in zip(*parts)) for k, parts in out.items()}


def plain_split(bins, g, growth, columns):
    """(gain, feature, bin) by trying every split, or None."""
    best, score = None, lambda v: v.sum() ** 2 / (len(v) + growth.penalty)
    for f in columns:
        for b in np.unique(bins[:, f]):
            left = bins[:, f] <= b
            if min(left.sum(), (~left).sum()) >= growth.leaf:
                gain = score(g[left]) + score(g[~left]) - score(g)
                if best is None or gain > best[0] + 1e-9:
                    best = (gain, f, b)
    return best if best and best[0] > 1e-9 else None


def plain_tree(bins, g, growth, draw, rate, number, all_bins):
    """Predictions for all_bins of the tree that grows by levels; nodes are numbered as they are split."""
    out, count = np.zeros(len(all_bins)), 1
    level = [(0, np.arange(len(bins)), np.arange(len(all_bins)))]
    depth = 0
    while level:
        after = []
        for node, rows, where in level:
            out[where] = -rate * g[rows].sum() / (len(rows) + growth.penalty)
            if growth.depth is not None and depth >= growth.depth or len(rows) < 2 * growth.leaf:
                continue
            if found := plain_split(bins[rows], g[rows], growth, draw(node)):
                _, f, b = found
                for go in (lambda v: v <= b, lambda v: v > b):
                    after.append((count, rows[go(bins[rows, f])], where[go(all_bins[where, f])]))
                    count += 1
        level, depth = after, depth + 1
    return out


@pytest.mark.parametrize("hours", [4096, 50])
def test_packing_and_roles(spark, monkeypatch, hours):
    got = units(spark, monkeypatch, hours, 0.1)
    assert set(got) == {(s, f"f{k}") for s in "xy" for k in (0, 1)}
    for (s, fold), (t, role, y, bins, mean) in got.items():
        a, start = (200, 230)[int(fold[1])], int(T0.timestamp() // 3600) if T0.tzinfo else int((T0 - T0.__class__(1970, 1, 1)).total_seconds() // 3600)
        train = [i for i in range(a - 3) if i % 29 != 5]
        assert (t[role < 2] - start).tolist() == train and (role == 1).sum() == round(0.1 * len(train)) and (role[: len(train) - (role == 1).sum()] == 0).all()
        assert (t[role == 2] - start).tolist() == [i for i in range(a, min(260, a + 30)) if i % 29 != 5]
        assert mean[0] == pytest.approx(y[role == 0].mean()) and bins.max() < trees.BINS


@pytest.mark.parametrize("hours", [4096, 50])
def test_forest_equals_plain_growth(spark, monkeypatch, hours):
    params = {"trees": 3, "depth": 3, "leaf": 12, "columns": 0.7}
    got = {(r.symbol, r.fold, r.seed, r.open_time): r.y_pred for r in trees.forest(table(spark), COLUMNS, WINDOWS, params, (1, 2)).collect()}
    monkeypatch.setattr(trees, "HOURS", hours)
    again = {(r.symbol, r.fold, r.seed, r.open_time): r.y_pred for r in trees.forest(table(spark), COLUMNS, WINDOWS, params, (1, 2)).collect()}
    assert got.keys() == again.keys() and all(got[k] == pytest.approx(again[k]) for k in got)
    growth = trees.Growth(12, 3, 4096, 0.0, 0.632, 0.7, True)
    assert growth.count(3) == 2
    for (s, fold), (t, role, y, bins, _) in units(spark, monkeypatch, hours, 0.0).items():
        for seed in (1, 2):
            want = np.zeros(len(t))
            for k in range(3):
                on = (role == 0) & (trees.uniform(t, seed, k) < 0.632)
                want += plain_tree(bins[on], -y[on], growth, lambda node: growth.drawn(3, seed, k, node), 1.0, k, bins) / 3  # noqa: B023
            mine = [v for key, v in sorted(got.items()) if key[:3] == (s, fold, seed)]
            assert mine == pytest.approx(want[role == 2].tolist())


@pytest.mark.parametrize("hours, fresh", [(4096, 16), (4096, 2), (90, 16), (90, 2)])
def test_boosting_equals_plain_rounds(spark, monkeypatch, hours, fresh):
    """A unit in one block, and in several blocks with and without stored margins."""
    monkeypatch.setattr(trees, "HOURS", hours)
    monkeypatch.setattr(trees, "FRESH", fresh)
    params = {"rounds": 6, "depth": 2, "leaf": 10, "rate": 0.3, "penalty": 2.0, "patience": 2}
    got = {(r.symbol, r.fold, r.open_time): r.y_pred for r in trees.boosting(table(spark), COLUMNS, WINDOWS, params, (4,)).collect()}
    growth = trees.Growth(10, 2, 1 << 30, 2.0, 0.8, 0.8, False)
    for (s, fold), (t, role, y, bins, mean) in units(spark, monkeypatch, 4096, 0.1).items():
        said = mean.copy()
        errors, all_said = [((y - said)[role == 1] ** 2).mean()], [said.copy()]
        for k in range(6):
            on = (role == 0) & (trees.uniform(t, 4, k) < 0.8)
            said = said + plain_tree(bins[on], (said - y)[on], growth, lambda node: growth.drawn(3, 4, k, node), 0.3, k, bins)  # noqa: B023
            errors.append(((y - said)[role == 1] ** 2).mean())
            all_said.append(said.copy())
        stop = next((k for k in range(7) if k - int(np.argmin(errors[: k + 1])) >= 2), 6)
        want = all_said[int(np.argmin(errors[: stop + 1]))]
        mine = [v for key, v in sorted(got.items()) if key[:2] == (s, fold)]
        assert mine == pytest.approx(want[role == 2].tolist())


def test_best_first_keeps_the_greatest_gains():
    rng = np.random.default_rng(3)
    tree, open_ = trees.Tree(), [0]
    for _ in range(60):
        node = open_.pop(int(rng.integers(len(open_))))
        open_ += tree.split(node, int(rng.integers(3)), int(rng.integers(9)), float(rng.random()), 0.0, 0.0)
    for leaves in (1, 2, 9, 40, 61, 99):
        copy = trees.Tree()
        for name in ("feature", "bin", "left", "right", "value", "gain"):
            setattr(copy, name, list(getattr(tree, name)))
        copy.best_first(leaves)
        heap, kept = [(-tree.gain[0], 0)], set()
        while heap and len(kept) < leaves - 1:
            _, k = heapq.heappop(heap)
            kept.add(k)
            for c in (tree.left[k], tree.right[k]):
                if tree.feature[c] >= 0:
                    heapq.heappush(heap, (-tree.gain[c], c))
        assert {k for k, f in enumerate(copy.feature) if f >= 0} == kept and len(kept) == min(leaves - 1, 60)


def test_a_tree_without_depth_bound_has_at_most_so_many_leaves(spark):
    params = {"trees": 1, "depth": None, "leaf": 3, "leaves": 5}
    got = trees.forest(table(spark, ("x",)), COLUMNS, WINDOWS[:1], params, (1,))
    assert 2 <= got.select("y_pred").distinct().count() <= 5
    assert trees.forest(table(spark, ("x",)), COLUMNS, WINDOWS[:1], params | {"leaves": 4096}, (1,)).select("y_pred").distinct().count() > 5


@pytest.mark.parametrize("adapter, params", [(forecast.forest, {"trees": 4, "leaf": 5}), (forecast.boosting, {"rounds": 8})])
def test_other_symbols_change_nothing(spark, adapter, params):
    both, one = table(spark), table(spark).filter("symbol = 'y'")
    a = forecast.run(both, COLUMNS, WINDOWS, adapter, params, (1, 2)).filter("symbol = 'y'")
    b = forecast.run(one, COLUMNS, WINDOWS, adapter, params, (1, 2))
    key = lambda df: {(r.fold, r.seed, r.open_time): r.y_pred for r in df.collect()}
    assert key(a) == pytest.approx(key(b)) and len(key(b)) > 100
    assert b.agg(F.corr("y_true", "y_pred")).first()[0] > 0.5
    assert adapter(both.filter("false"), COLUMNS, WINDOWS[0], params, 1).count() == 0
