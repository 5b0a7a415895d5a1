import numpy as np
import pytest

from loomline.llm import embeddings as E

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.98):
    """{vec_id: (links, component)} by all pairs; rows have distinct ids."""
    unit = {}
    for i, v, label in rows:
        if v and label is not None and None not in v and np.isfinite(v).all() and np.linalg.norm(v) > 0:
            unit[i] = (np.array(v, np.float32).astype(float), label)
    links, near = {i: 0 for i, _, _ in rows}, {i: {i} for i, _, _ in rows}
    for a in unit:
        for b in unit:
            if a != b and unit[a][1] == unit[b][1] and len(unit[a][0]) == len(unit[b][0]):
                x, y = unit[a][0], unit[b][0]
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    links[a] += 1
                    near[a].add(b)
    comp = {}
    for i in near:
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        comp[i] = min(seen)
    return {i: (links[i], comp[i]) for i in links}


def planted(seed, n=250, dims=64):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(12):
        centre = rng.normal(size=dims)
        for _ in range(int(rng.integers(1, 25))):
            rows.append((centre + rng.normal(size=dims) * rng.choice([0.0, 0.05, 0.1, 0.14]), int(c % 3)))
    rows += [(rng.normal(size=dims), int(rng.integers(0, 3))) for _ in range(n)]
    return [(i, [float(np.float32(x)) for x in v], label) for i, (v, label) in enumerate(rows)]


@pytest.mark.parametrize("tile", [256, 8])
def test_recall_and_precision_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(E, "TILE", tile)
    rows = planted(3)
    want = brute(rows)
    got = {r.vec_id: r for r in E.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    assert all(got[i].n_links <= n for i, (n, _) in want.items())
    assert sum(r.n_links for r in got.values()) >= 0.97 * sum(n for n, _ in want.values())
    assert np.mean([got[i].component_id == c for i, (_, c) in want.items()]) > 0.97
    assert all(r.kept == (r.component_id == r.vec_id) for r in got.values())


def test_unsound_vectors_and_copies(spark):
    v, nan, inf = [1.0] * 8, float("nan"), float("inf")
    rows = [
        (1, v, 0), (2, v, 0), (3, [2.0] * 8, 0), (4, v, 1), (5, v, None), (6, None, 0), (7, [], 0), (8, [0.0] * 8, 0), (9, [nan] + v[1:], 0), (10, [inf] + v[1:], 0),
        (11, [None] + v[1:], 0), (12, v[:4], 0), (13, v[:4], 0), (14, [-1.0] * 8, 0),
    ]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'clash' AS key", "1 AS cid", "2 AS n_links")
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_duplicates(frame).collect()}
    assert got == brute(rows)
    assert got[1] == (2, 1) and got[12] == (1, 12)


def test_repeated_rows_and_missing_ids(spark):
    v, w = [1.0, 2.0, 3.0], [3.0, -2.0, 1.0]
    rows = [(1, v, 0), (1, v, 0), (None, v, 0), (None, w, 0), (None, None, 0)]
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in E.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (None, 0, None), (None, 0, None)], key=str)
    assert E.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_lattice():
    assert E.ROOTS.shape == (240, 8) and np.allclose((E.ROOTS**2).sum(axis=1), 2)
    y = np.random.default_rng(0).normal(size=(500, 8)) * 3
    x = E.nearest_e8(y)
    assert np.allclose(2 * x, np.rint(2 * x)) and np.allclose(x.sum(axis=1) % 2, 0)
    assert (((y - x) ** 2).sum(axis=1)[:, None] <= ((y[:, None] - x[:, None] - E.ROOTS[None]) ** 2).sum(axis=2) + 1e-9).all()
