import numpy as np
import pytest

from loomline.llm import whitening as W
from loomline.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>"


def brute(x):
    """(eigenvalues, images, deviations, trace) from the whole covariance."""
    n, centred = len(x), x - x.mean(axis=0)
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    whole = x.astype(np.int64).astype(object)
    return e, centred @ u, ((n * whole - whole.sum(axis=0)) ** 2).sum(axis=1), float((centred**2).sum() / n)


def held(df, k):
    frame = df.toPandas().sort_values(["vec_id", "component"])
    return frame, frame.whitened.to_numpy(float).reshape(-1, k)


def test_whole_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = sorted(spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect())
    x = np.floor(64 * np.array([r.embedding for r in rows], float))
    e, images, far, trace = brute(x)
    frame, got = held(QUERIES["op12_whitening"](spark, sf), 32)
    want = images[:, :32] / np.sqrt(e[:32])
    assert np.abs(got - want * np.sign((got * want).sum(axis=0))).max() < 1e-8
    assert frame.deviation.to_numpy().reshape(-1, 32)[:, 0].tolist() == far.tolist()
    assert np.allclose(frame.explained.to_numpy().reshape(-1, 32)[0], e[:32] / trace, rtol=1e-10)
    assert frame.identity_error.nunique() == 1 and frame.identity_error.max() < 1e-10 and (frame.n == len(rows)).all()


@pytest.mark.parametrize("dims, k, decay", [(90, 12, 0.99), (70, 8, 0.9), (40, 32, 1.0)])
def test_spectra_with_small_gaps_and_fast_decay(spark, dims, k, decay):
    rng = np.random.default_rng(dims)
    x = rng.normal(size=(400, dims)) * decay ** np.arange(dims) @ np.linalg.qr(rng.normal(size=(dims, dims)))[0] * 30 + 5000
    e, images, far, _ = brute(np.floor(64 * x))
    _, got = held(W.whiten(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], SCHEMA).repartition(4), k), k)
    want = images[:, :k] / np.sqrt(e[:k])
    assert np.abs(got - want * np.sign((got * want).sum(axis=0))).max() < 1e-6


def test_unsound_rows_lengths_repeats_and_clashes(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 6))
    rows = list(enumerate(x.tolist())) + [(3, x[3].tolist()), (None, x[0].tolist()), (90, None), (91, []), (92, [1.0, 2.0]), (93, [None] * 6), (94, [float("nan")] * 6), (95, [float("inf")] * 6)]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'clash' AS ids", "1 AS x", "2 AS n", "3 AS i").repartition(3)
    got = W.whiten(frame).toPandas()
    assert len(got) == 52 * 6 and set(got.n) == {52} and got.vec_id.isna().sum() == 6
    e, images, far, _ = brute(np.floor(64 * np.concatenate((x, x[[3, 0]]))))
    one = got[got.vec_id == 3].sort_values("component").whitened.abs().to_numpy().reshape(6, 2)
    assert np.allclose(one[:, 0], one[:, 1]) and np.allclose(one[:, 0], np.abs(images[3] / np.sqrt(e)), atol=1e-8)


def test_components_without_variance_and_empty_tables(spark):
    rows = [(i, [float(i), 2.0 * i, 7.0]) for i in range(20)]
    got = W.whiten(spark.createDataFrame(rows, SCHEMA)).toPandas()
    first, rest = got[got.component == 1], got[got.component > 1]
    assert np.isclose(first.explained, 1).all() and rest.whitened.isna().all() and (rest.explained == 0).all() and got.identity_error.max() < 1e-12
    flat = W.whiten(spark.createDataFrame([(1, [1.0, 1.0]), (2, [1.0, 1.0])], SCHEMA)).toPandas()
    assert len(flat) == 4 and flat.explained.isna().all() and flat.identity_error.isna().all() and flat.whitened.isna().all()
    assert W.whiten(spark.createDataFrame([], SCHEMA)).count() == 0 and W.whiten(spark.createDataFrame([(1, None)], SCHEMA)).count() == 0


def test_exact_square_sums():
    rng = np.random.default_rng(1)
    for n, most in ((10, 50), (200_000, 4000), (1 << 40, 1 << 30), (3, 1 << 60)):
        x = rng.integers(-most, most, (5, 7))
        shift = [int(s) for s in rng.integers(0, n, 7)]
        assert W.square_sums(x, n, shift) == [sum((n * int(v) - s) ** 2 for v, s in zip(r, shift)) for r in x]
