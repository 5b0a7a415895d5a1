"""Embedding whitening by Chebyshev-filtered subspace iteration.

Vectors become whole numbers, BLOCK to a row, once. Each step multiplies the covariance V of the fit list with a
narrow matrix Q in one pass over the blocks: a task adds up A'(A Q) for its centred rows A and sends one row a dimension
to an aggregate, so only matrices of dimensions times columns reach the driver. The covariance itself is never formed.

A block of `k` wanted and some more columns starts from a seeded random basis. Each round damps the unwanted part of the
spectrum, from a lower bound by a few Lanczos steps up to the smallest Ritz value, with a scaled Chebyshev recurrence
(Zhou, Saad, Tiago and Chelikowsky 2006), then takes QR and Rayleigh-Ritz. It ends when the residual norm of each wanted pair is
below TOLERANCE times the largest eigenvalue, or cannot fall any more and is below ACCEPTED; else it is an error.
The covariance of the whitened rows is measured in a pass of its own.

Centring subtracts whole numbers first (the floor of the mean) and then the mean's rest, so that a large common offset
costs no digits. The sign of a component makes its entry of largest size positive.

Defined results: vectors that are null, empty, or with null or non-finite components are left out; the space is the
commonest of the lengths of the others (the greater one if two are as common) and vectors of other lengths have no place
in it and are left out too; repeated rows count as rows; rows without an id are kept; there are no more components than
dimensions; a component without variance (an eigenvalue within rounding of zero) has null whitened values, counts as
explained 0 and is not part of identity_error; without any variance explained and identity_error are null; an empty table
gives an empty result; other columns are not read; a component whose product with `scale` exceeds 64 bits is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .vectors import packed, scaled, unpacked

COMPONENTS, SCALE, OFFSET, SEED, BLOCK = 32, 64, 1_000_000, 12, 512
#: Residual norm over the largest eigenvalue at which a pair is certified; at which it is accepted if it stands still.
TOLERANCE, ACCEPTED = 2e-14, 1e-11
#: Growth of the wanted part in one filter, its highest degree, and rounds before giving up.
GAIN, DEGREE, MOST_ROUNDS = 1e5, 40, 60


def blocks(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(ids, dims, x): up to BLOCK sound vectors of one length, as floor(scale * component)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, np.ndarray]] = {}
        for batch in batches:
            for at, x in scaled(batch.column(1), scale):
                ids = batch.column(0).take(pa.array(at)).to_pylist()
                if (n := x.shape[1]) in held:
                    ids, x = held[n][0] + ids, np.concatenate((held[n][1], x))
                full = len(ids) // BLOCK * BLOCK
                for k in range(0, full, BLOCK):
                    yield block(ids[k : k + BLOCK], x[k : k + BLOCK])
                held[n] = ids[full:], x[full:]
        for ids, x in held.values():
            if ids:
                yield block(ids, x)

    def block(ids: list, x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([x.shape[1]], pa.int32()), pa.array([packed(x)], pa.binary())], names=["ids", "dims", "x"])

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "ids array<long>, dims int, x binary")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for k in range(batch.num_rows):
            ids, dims = batch.column(0)[k].values, batch.column(1)[k].as_py()
            yield ids, unpacked(batch.column(2)[k].as_py(), len(ids) * dims).reshape(len(ids), dims)


@dataclass(frozen=True)
class Space:
    """Blocks of the fit list with its number of rows and its exact sums by dimension."""

    packs: DataFrame
    n: int
    sums: list[int]

    @property
    def floor(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([s % self.n / self.n for s in self.sums])

    def summed(self, make, columns: int) -> np.ndarray:
        """The sum over all blocks of make(centred rows), a matrix of as many columns: a row a dimension and task is shuffled."""
        low, rest = self.floor, self.rest

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for _, x in _rows(batches):
                part = make((x - low) - rest)
                total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "v"])

        parts = self.packs.mapInArrow(run, "i int, v array<double>")
        got = parts.groupBy("i").agg(*[F.sum(F.col("v")[j]).alias(f"v{j}") for j in range(columns)]).collect()  # a row a dimension
        return np.array([tuple(r)[1:] for r in sorted(got)], np.float64)

    def times(self, q: np.ndarray) -> np.ndarray:
        """V q."""
        return self.summed(lambda a: a.T @ (a @ q), q.shape[1]) / self.n

    def covariance(self, q: np.ndarray) -> np.ndarray:
        """The covariance of the rows' images under q."""

        def images(a: np.ndarray) -> np.ndarray:
            z = a @ q
            return np.concatenate((z.T @ z, z.sum(axis=0)[None, :]))

        got = self.summed(images, q.shape[1])
        mean = got[-1] / self.n
        return got[:-1] / self.n - np.outer(mean, mean)

    def trace(self) -> float:
        return float(self.summed(lambda a: (a * a).sum(axis=0)[None, :].T, 1).sum() / self.n)


def space(vectors: DataFrame, scale: int = SCALE) -> Space | None:
    """The fit list of vectors, or None if it is empty."""
    packs = cut(blocks(vectors, scale))
    common = packs.groupBy("dims").agg(F.sum(F.size("ids")).alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if common is None:
        return None
    packs = packs.filter(F.col("dims") == common.dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for _, x in _rows(batches):
            total = total + x.sum(axis=0)
        if not isinstance(total, int):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "s"])

    sums = packs.mapInArrow(run, "i int, s long").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    return Space(packs, common.n, [int(r.s) for r in sorted(sums)])


def lower_bound(of: Space, steps: int = 6) -> float:
    """A bound from below of V's spectrum by Lanczos: the least Ritz value less its residual."""
    d = len(of.sums)
    q, before, beta = np.random.default_rng(SEED).standard_normal(d), np.zeros(d), 0.0
    q /= np.linalg.norm(q)
    alphas, betas = [], []
    for _ in range(min(steps, d)):
        w = of.times(q[:, None])[:, 0] - beta * before
        alphas.append(w @ q)
        w -= alphas[-1] * q
        beta = float(np.linalg.norm(w))
        if beta <= 1e-12 * max(abs(alphas[-1]), 1e-300):
            break
        betas.append(beta)
        before, q = q, w / beta
    m = len(alphas)
    t = np.diag(alphas) + np.diag(betas[: m - 1], 1) + np.diag(betas[: m - 1], -1)
    return max(0.0, float(np.linalg.eigvalsh(t)[0]) - beta)


def filtered(of: Space, q: np.ndarray, vq: np.ndarray, low: float, high: float, top: float, degree: int) -> np.ndarray:
    """p(V) q for the Chebyshev polynomial that is small on [low, high] and 1 at top; vq is V q."""
    half, middle = (high - low) / 2, (high + low) / 2
    sigma = first = half / (top - middle)
    y = (vq - middle * q) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        q, y = y, (of.times(y) - middle * y) * (2 * after / half) - sigma * after * q
        sigma = after
    return y


def principal(of: Space, k: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of the k largest eigenvalues of V, certified."""
    d = len(of.sums)
    wide = min(d, k + max(8, k // 2))
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, wide)))[0]
    low, last, still = None, np.inf, 0
    for _ in range(MOST_ROUNDS):
        vq = of.times(q)
        h = q.T @ vq
        e, w = np.linalg.eigh((h + h.T) / 2)
        e, w = e[::-1], w[:, ::-1]
        q, vq = q @ w, vq @ w
        worst = float(np.linalg.norm(vq[:, :k] - q[:, :k] * e[:k], axis=0).max())
        still = still + 1 if worst > last / 2 else 0
        if e[0] <= 0 or worst <= TOLERANCE * e[0] or wide == d or (still >= 2 and worst <= ACCEPTED * e[0]):
            vectors = q[:, :k]
            return np.maximum(e[:k], 0), vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)] < 0, -1, 1)
        last = min(last, worst)
        low = lower_bound(of) if low is None else low
        high = max(float(e[-1]), low * (1 + 1e-9), 1e-12 * e[0])
        at = 1 + 2 * max(float(e[k - 1]) - high, 0) / max(high - low, 1e-300)
        degree = int(np.clip(np.ceil(np.arccosh(GAIN) / max(np.arccosh(at), 1e-3)), 4, DEGREE))
        q = np.linalg.qr(filtered(of, q, vq, min(low, high * 0.99), high, max(float(e[0]), high * 1.01), degree))[0]
    raise RuntimeError(f"eigenvectors are not certified after {MOST_ROUNDS} rounds: residual {worst / e[0]:.1e}")


def square_sums(x: np.ndarray, n: int, shift: list[int]) -> list[int]:
    """The exact sum over columns of (n x - shift)^2 for each row."""
    bound = n * (int(np.abs(x).max(initial=0)) + 1)
    if bound >= 1 << 49:
        return ((n * x.astype(object) - np.array(shift, object)) ** 2).sum(axis=1).tolist()
    far = n * x - np.array(shift, np.int64)
    high, low = far >> 24, far & 0xFFFFFF  # squares of halves stay within 64 bits
    halves = ((high * high).sum(axis=1), (high * low).sum(axis=1), (low * low).sum(axis=1))
    return [(a << 48) + (b << 25) + c for a, b, c in zip(*(h.tolist() for h in halves))]


SCHEMA = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, k: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of vectors(vec_id, embedding).

    The numbers are x = floor(scale * component) + OFFSET; deviation is the sum over dimensions of (n x - sum of x)^2. An
    offset moves every x and the mean alike, so that it is left out of all differences.
    """
    of = space(vectors, scale)
    if of is None:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    k = min(k, len(of.sums))
    values, basis = principal(of, k)
    trace = of.trace()
    real = values > len(of.sums) * np.finfo(float).eps * max(trace, 0)
    turn = np.where(real, basis / np.sqrt(np.where(real, values, 1)), np.nan)
    whole = of.covariance(turn[:, real]) if real.any() else np.zeros((0, 0))
    error = float(np.abs(whole - np.eye(len(whole))).max()) if real.any() else None
    explained = [None if trace == 0 else float(v / trace) if r else 0.0 for v, r in zip(values, real)]
    n, low, rest, number = of.n, of.floor, of.rest, np.arange(1, k + 1, dtype=np.int32)
    shift = [s - n * m for s, m in zip(of.sums, low.tolist())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _rows(batches):
            m = len(ids)
            z = ((x - low) - rest) @ np.where(real, turn, 0)
            far = pa.array([Decimal(v) for v in square_sums(x - low, n, shift)], pa.decimal128(38, 0))
            repeat = pa.array(np.repeat(np.arange(m), k))
            shown = pa.array(z.ravel(), mask=np.tile(~real, m))
            yield pa.RecordBatch.from_arrays(
                [ids.take(repeat), pa.array(np.tile(number, m)), pa.array(np.full(m * k, n)), far.take(repeat), shown, pa.array(explained * m, pa.float64()), pa.array([error] * (m * k), pa.float64())],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return of.packs.mapInArrow(run, SCHEMA)
