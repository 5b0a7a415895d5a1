"""Clusters by nearest centroid over blocks of vectors in the order of a space-filling curve.

Vectors become whole numbers, are put in Hilbert order by a range partitioning, and are packed BLOCK to a row with the
least and the greatest value of each component: the block's box. How much nearer one centroid is than another is linear
in the vector, so its bounds over a box are exact; a centroid that another one beats everywhere in the box is none of
the block's candidates. Only candidates are compared, in exact whole numbers, and a block with one candidate adds its
stored sum. A round sends one row a task and cluster to a small aggregate; only centroids reach the driver.

Equal vectors are spread over range partitions by a hash of their id, so that a group of copies is no hot range.

Defined results: vectors that are null, of another length than `dims`, or with null or non-finite components are left
out; repeated rows count as rows; rows without an id are clustered but are the last to start a centroid; equal ids start
centroids in the order of their vectors; with fewer vectors than `k` there are as many centroids; ties go to the
smaller number; an empty cluster keeps its centroid; an empty table gives an empty result; other columns are not read; a
component whose product with `scale` exceeds 64 bits is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .vectors import exact, packed, scaled, unpacked

DIMS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 16, 3, 64, 1
#: Bits of each component in the order of vectors; vectors in a block.
BITS, BLOCK = 4, 128


def hilbert(cells: np.ndarray, bits: int) -> list[bytes]:
    """Places on the Hilbert curve of the rows of cells (n, dims), 0 <= cell < 2**bits, as byte strings that sort alike.

    Gray-code steps from the highest bit down, as published by Skilling (2004), on all rows at once.
    """
    x, dims = cells.astype(np.int64).T.copy(), cells.shape[1]
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(dims):
            flip = (x[i] >> level & 1).astype(bool)
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> level & 1, (1 << level) - 1, 0)
    x ^= turn
    planes = np.stack([x >> level & 1 for level in range(bits - 1, -1, -1)])  # (bits, dims, n)
    rows = np.packbits(planes.transpose(2, 0, 1).reshape(x.shape[1], -1).astype(np.uint8), axis=1)
    return [r.tobytes() for r in rows]


def whole(vectors: DataFrame, dims: int, scale: int, low: int | None = None, high: int = 0) -> DataFrame:
    """(vec_id, x) of the vectors that are kept, x packed; with low and high also their place on the curve."""
    schema = "vec_id long, x binary" + ("" if low is None else ", place binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in scaled(batch.column(1), scale):
                if x.shape[1] == dims and len(at):
                    out = [batch.column(0).take(pa.array(at)), pa.array([packed(r) for r in x], pa.binary())]
                    if low is not None:
                        share = (x.astype(np.float64) - low) / max(1, high - low)
                        cells = np.clip((share * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
                        out.append(pa.array(hilbert(cells, BITS), pa.binary()))
                    yield pa.RecordBatch.from_arrays(out, names=["vec_id", "x", "place"][: len(out)])

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, schema)


def starts(vectors: DataFrame, dims: int, k: int, scale: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest hashes of seed and id, in that order."""
    named = whole(vectors, dims, scale).withColumn("__h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    first = named.orderBy(F.col("__h").asc_nulls_last(), "x").limit(k).collect()
    rows = sorted(((r["__h"] is None, r["__h"] or "", unpacked(r.x, dims).tolist()) for r in first))
    return np.array([x for _, _, x in rows], np.int64).reshape(-1, dims)


def blocks(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """(ids, x, low, high, total): up to BLOCK neighbours on the curve, with their box and their sum."""
    sound = F.filter(F.col("embedding"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    ends = vectors.select(F.array_min(sound).alias("a"), F.array_max(sound).alias("b")).agg(F.min("a"), F.max("b")).first()
    low, high = (int(np.floor(scale * float(e or 0))) for e in ends)
    placed = whole(vectors, dims, scale, low, high)
    # by range over the place, then over a hash of the id, so that copies of one vector fill several ranges
    dealt = placed.repartitionByRange("place", F.xxhash64("vec_id")).sortWithinPartitions("place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, data = [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            data += batch.column(1).to_pylist()
            while len(ids) >= BLOCK:
                yield block(ids[:BLOCK], data[:BLOCK])
                ids, data = ids[BLOCK:], data[BLOCK:]
        if ids:
            yield block(ids, data)

    def block(ids: list, data: list) -> pa.RecordBatch:
        x = np.stack([unpacked(d, dims) for d in data])
        box = [packed(a) for a in (x, x.min(axis=0), x.max(axis=0))]
        return pa.RecordBatch.from_arrays(
            [pa.array([ids], pa.list_(pa.int64())), *(pa.array([b], pa.binary()) for b in box), pa.array([x.sum(axis=0).tolist()], pa.list_(pa.int64()))],
            names=["ids", "x", "low", "high", "total"],
        )

    return dealt.select("vec_id", "x").mapInArrow(run, "ids array<long>, x binary, low binary, high binary, total array<long>")


def candidates(low: np.ndarray, high: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """(centroids) true where no other centroid is nearer, or as near with a smaller number, in the whole box.

    With f(x) = |x - a|^2 - |x - b|^2 = |a|^2 - |b|^2 + 2 x (b - a), centroid b goes if the box's greatest f is below 0.
    """
    lo, hi, c = exact(low, high, centres)
    gap = c[None, :, :] - c[:, None, :]  # [a, b] = b - a
    most = (np.where(gap > 0, gap * hi, gap * lo)).sum(axis=2) * 2 + (c * c).sum(axis=1)[:, None] - (c * c).sum(axis=1)[None, :]
    number = np.arange(len(c))
    beaten = (most < 0) | ((most == 0) & (number[:, None] < number[None, :]))
    return ~beaten.any(axis=0)


def nearest(x: np.ndarray, low: np.ndarray, high: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each row of x, exact; only the box's candidates are compared."""
    who = np.flatnonzero(candidates(low, high, centres))
    v, c = exact(x, centres[who])
    far = (v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)[None, :]
    best = far.argmin(axis=1)
    return who[best], far[np.arange(len(x)), best].astype(np.int64)


def _boxes(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.ListScalar, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for k in range(batch.num_rows):
        ids, x, low, high, total = (batch.column(c)[k] for c in range(5))
        n = len(ids.values)
        yield ids.values, unpacked(x.as_py(), n * dims).reshape(n, dims), unpacked(low.as_py(), dims), unpacked(high.as_py(), dims), total.values.to_numpy()


def moved(packs: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    k, dims = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(k, np.int64), np.zeros((k, dims), object)
        for batch in batches:
            for ids, x, low, high, total in _boxes(batch, dims):
                who = np.flatnonzero(candidates(low, high, centres))
                if len(who) == 1:
                    count[who[0]] += len(ids)
                    sums[who[0]] += total
                else:
                    best, _ = nearest(x, low, high, centres)
                    for j in np.unique(best).tolist():
                        here = x[best == j]
                        count[j] += len(here)
                        sums[j] += here.sum(axis=0)
        some = np.flatnonzero(count)
        if len(some):
            yield pa.RecordBatch.from_arrays(
                [pa.array(some), pa.array(count[some]), pa.array([sums[j].tolist() for j in some], pa.list_(pa.int64()))], names=["cluster", "n", "sums"]
            )

    parts = packs.mapInArrow(run, "cluster long, n long, sums array<long>")
    added = [F.sum(F.col("sums")[d].cast("decimal(38,0)")).alias(f"s{d}") for d in range(dims)]
    out = centres.copy()
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *added).collect():  # at most k rows
        out[row.cluster] = [int(row[f"s{d}"]) // row.n for d in range(dims)]
    return out


def assigned(packs: DataFrame, centres: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    dims = centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x, low, high, _ in _boxes(batch, dims):
                best, far = nearest(x, low, high, centres)
                yield pa.RecordBatch.from_arrays([ids, pa.array(best.astype(np.int32)), pa.array(far)], names=["vec_id", "cluster", "distance"])

    return packs.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, dims: int = DIMS, k: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of vectors(vec_id, embedding)."""
    spark = vectors.sparkSession
    centres = starts(vectors, dims, k, scale, seed)
    if not len(centres):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    packs = cut(blocks(vectors, dims, scale))
    for _ in range(rounds):
        centres = moved(packs, centres)
    placed = cut(assigned(packs, centres))
    by_cluster = {r.cluster: int(r.s) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    rows = [(j, s, sum(by_cluster.values()), names[j]) for j, s in by_cluster.items()]
    told = spark.createDataFrame(rows, "__c int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows at most
    return placed.join(F.broadcast(told), F.col("cluster") == F.col("__c")).drop("__c")
