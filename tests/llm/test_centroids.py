import hashlib

import numpy as np
import pytest

from loomline.llm import centroids as C
from loomline.llm.queries import ORACLE_SQL, QUERIES

from ..test_queries import SF, cells, duck  # noqa: F401

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, dims, k, rounds):
    """The rows of the operator in whole numbers of any size, by all distances."""
    kept = [(i, [int(np.floor(64 * np.float64(c))) for c in v]) for i, v in rows if v is not None and len(v) == dims and None not in v and np.isfinite(v).all()]
    order = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [x for _, x in order[:k]]
    for r in range(rounds + 1):
        far = [[sum((a - b) ** 2 for a, b in zip(x, c)) for c in centres] for _, x in kept]
        best = [min(range(len(centres)), key=lambda j: (f[j], j)) for f in far]
        if r < rounds:
            for j in range(len(centres)):
                mine = [x for (_, x), b in zip(kept, best) if b == j]
                centres[j] = [sum(c) // len(mine) for c in zip(*mine)] if mine else centres[j]
    d = [f[b] for f, b in zip(far, best)]
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, b, x, sum(y for y, z in zip(d, best) if z == b), sum(d), name[b]) for (i, _), b, x in zip(kept, best, d)), key=str)


def told(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def test_equals_brute_force_with_copies_ties_and_unsound_rows(spark):
    rng = np.random.default_rng(5)
    hot = [0.25] * 8
    rows = [(i, (rng.integers(-3, 3, 8) / 8).tolist()) for i in range(300)] + [(1000 + i, hot) for i in range(150)]
    rows += [(7, rows[7][1]), (None, hot), (None, None), (501, None), (502, []), (503, [1.0] * 7), (504, [None] + hot[1:]), (505, [float("nan")] + hot[1:]), (506, [float("inf")] + hot[1:])]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'clash' AS place", "1 AS x", "2 AS cluster").repartition(5)
    assert told(C.cluster(frame, dims=8, k=5)) == brute(rows, 8, 5, 3)


def test_large_numbers_stay_exact(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=4) * 1e6).tolist()) for i in range(60)]
    assert told(C.cluster(spark.createDataFrame(rows, SCHEMA), dims=4, k=3)) == brute(rows, 4, 3, 3)


def test_fewer_vectors_than_centroids_and_empty_tables(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [0.0, -1.0])]
    assert told(C.cluster(spark.createDataFrame(rows, SCHEMA), dims=2)) == brute(rows, 2, 16, 3)
    for rows in ([], [(1, None)], [(1, [1.0])]):
        got = C.cluster(spark.createDataFrame(rows, SCHEMA), dims=2)
        assert got.count() == 0 and got.columns[0] == "vec_id"


def test_hilbert_order_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3), (5, 2)):
        side = 1 << bits
        grid = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        places = C.hilbert(grid, bits)
        assert len(set(places)) == len(grid)
        walk = grid[sorted(range(len(grid)), key=places.__getitem__)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("seed", range(5))
def test_candidates_hold_every_nearest_centroid_and_far_ones_go(seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-200, 200, (12, 6))
    for _ in range(30):
        x = rng.integers(-200, 200, 6) + rng.integers(-9, 10, (40, 6))
        kept = C.candidates(x.min(axis=0), x.max(axis=0), centres)
        best = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert kept[best].all()
        assert (C.nearest(x, x.min(axis=0), x.max(axis=0), centres)[0] == best).all()
    tight = C.candidates(centres[3], centres[3] + 1, centres)
    assert tight[3] and tight.sum() < 4


def test_query_equals_sql(spark, duck):  # noqa: F811
    got, want = QUERIES["op11_centroids"](spark, SF).toPandas(), duck.execute(ORACLE_SQL["op11_centroids"]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and cells(got) == cells(want)
