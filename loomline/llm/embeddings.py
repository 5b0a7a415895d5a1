"""Embedding near-duplicates by lattice hashing.

A vector of length one is projected by TABLES random maps to eight dimensions, and each image is decoded to the nearest
point of the E8 lattice: its home cell. It also probes the PROBES cells around each home that lie nearest to the image.
Two vectors of a label are candidates where one's home is the other's home or probe; candidates are linked if their
cosine, in double precision, reaches the threshold. Measured recall is in the README.

Equal vectors of a label are one class, so copies never meet as pairs. Only cells with a home and one more row fetch
their vectors, large cells are split into tiles, and a pair that meets in several cells is counted in the first of
them alone, so that links are counted and never listed; each tile passes on the links that connect its vectors.

Defined results: null, empty and zero vectors, those with null or non-finite components, and rows without a label
link with nothing and are components of their own; vectors of different lengths never link; repeated rows link like any
two rows; rows without an id count as links, and a component's id is its smallest id that is not null; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, tiles
from .graph import components

THRESHOLD, TABLES, PROBES, SCALE, SEED = 0.98, 6, 4, 1.5, 20240
#: Rows that are compared at once; a cell with more is split.
TILE = 512


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (-1, 1):
                for b in (-1, 1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for bits in range(256):
        v = np.array([0.5 if bits >> k & 1 else -0.5 for k in range(8)])
        if (v < 0).sum() % 2 == 0:
            out.append(v)
    return np.array(out)


ROOTS = roots()


def _nearest_d8(y: np.ndarray) -> np.ndarray:
    """The nearest points with integer coordinates and an even sum."""
    x = np.rint(y)
    odd = np.flatnonzero(x.sum(axis=1).astype(np.int64) & 1)
    gap = y[odd] - x[odd]
    worst = np.abs(gap).argmax(axis=1)
    at = np.arange(len(odd))
    x[odd, worst] += np.where(gap[at, worst] >= 0, 1, -1)
    return x


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """The nearest lattice point of each row of y (n, 8)."""
    a, b = _nearest_d8(y), _nearest_d8(y - 0.5) + 0.5
    near = ((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1)
    return np.where(near[:, None], a, b)


def _mix(points: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """64-bit keys of lattice points (..., 8), with a salt that broadcasts."""
    h = np.broadcast_to(salt, points.shape[:-1]).astype(np.uint64)
    for k in range(8):
        h = (h ^ (2 * points[..., k]).astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))).view(np.int64)


@cache
def projection(seed: int, table: int, dims: int) -> np.ndarray:
    return np.random.default_rng([seed, table, dims]).standard_normal((dims, 8))


def cell_keys(unit: np.ndarray, label: np.ndarray, number: int = TABLES, probes: int = PROBES, scale: float = SCALE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """home keys (n, tables) and probe keys (n, tables, probes) of unit vectors."""
    n, dims = unit.shape
    home, probe = np.empty((n, number), np.int64), np.empty((n, number, probes), np.int64)
    for t in range(number):
        y = unit @ projection(seed, t, dims) * scale
        x = nearest_e8(y)
        salt = (label.astype(np.int64) * 1_000_003 + dims * 8191 + t).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        home[:, t] = _mix(x, salt)
        gain = (y - x) @ ROOTS.T
        best = np.argpartition(-gain, probes - 1, axis=1)[:, :probes] if probes else np.zeros((n, 0), int)
        probe[:, t] = _mix(x[:, None, :] + ROOTS[best], salt[:, None])
    return home, probe


def unit_rows(column: pa.ListArray | pa.ChunkedArray) -> np.ndarray:
    """(n, dims) in double precision, each of length one; all rows have the same length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])  # squares of very large or small numbers stay finite
    return x / np.linalg.norm(x, axis=1)[:, None]


def _by_dims(batch: pa.RecordBatch, name: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) for each vector length in batch."""
    column = batch.column(batch.schema.get_field_index(name))
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield at, unit_rows(column.take(pa.array(at)))


def classes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): every row with its class key or null; each distinct vector of a label that can link."""
    v = F.col("embedding")
    sound = F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0)
    sound &= F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    key = [F.when(sound, F.xxhash64(F.lit(k), "label", v)).alias(f"h{k}") for k in (1, 2)]
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), *key, F.when(sound, v).alias("embedding"))
    classes = rows.filter("h1 is not null").groupBy("label", "h1", "h2")
    classes = classes.agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding"))
    return rows.drop("embedding"), cut(classes.withColumn("cid", F.monotonically_increasing_id()))


def cells(classes: DataFrame) -> DataFrame:
    """(key, cid, home): a row for each home and each probed cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid, label = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for at, unit in _by_dims(batch, "embedding"):
                home, probe = cell_keys(unit, label[at])
                key = np.concatenate((home.ravel(), probe.ravel()))
                who = np.concatenate((np.repeat(cid[at], home.shape[1]), np.repeat(cid[at], probe.shape[1] * probe.shape[2])))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(who), pa.array(np.arange(len(key)) < home.size)], names=["key", "cid", "home"])

    return classes.select("cid", "label", "embedding").mapInArrow(run, "key long, cid long, home boolean")


def first_meeting(i: np.ndarray, j: np.ndarray, home: np.ndarray, probe: np.ndarray) -> np.ndarray:
    """The key of the first cell in which rows i and j (i's class before j's) are candidates."""
    found, key = np.zeros(len(i), bool), np.zeros(len(i), np.int64)
    for t in range(home.shape[1]):
        hi, hj = home[i, t], home[j, t]
        for hit, where in ((hi == hj, hi), ((probe[j, t] == hi[:, None]).any(axis=1), hi), ((probe[i, t] == hj[:, None]).any(axis=1), hj)):
            new = hit & ~found
            key[new] = where[new]
            found |= new
    return key


def compare(cid: np.ndarray, size: np.ndarray, label: np.ndarray, home: np.ndarray, side: np.ndarray, group: np.ndarray, key: np.ndarray, unit: np.ndarray, threshold: float) -> list[tuple]:
    """(a, b, links) inside equal groups: links that connect, and counts with b null.

    side is the row's chunk in a tile of two chunks, where only rows of different sides are compared, else -1.
    """
    order = np.argsort(cid, kind="stable")
    cid, size, label, home, side, group, key, unit = (x[order] for x in (cid, size, label, home, side, group, key, unit))
    left, right = [], []
    for r in range(0, len(cid), 512):
        i, j = np.nonzero(unit[r : r + 512] @ unit.T >= threshold)
        i = i + r
        keep = (cid[i] < cid[j]) & (group[i] == group[j]) & (home[i] | home[j]) & ((side[i] < 0) | (side[i] != side[j]))
        left.append(i[keep])
        right.append(j[keep])
    i, j = np.concatenate(left), np.concatenate(right)
    if not len(i):
        return []
    rows, at = np.unique(np.concatenate((i, j)), return_inverse=True)
    homes, probes = cell_keys(unit[rows], label[rows])
    a, b, step = at[: len(i)], at[len(i) :], 65536
    here = np.concatenate([first_meeting(a[k : k + step], b[k : k + step], homes, probes) for k in range(0, len(i), step)]) == key[i]
    i, j = i[here], j[here]
    links = np.bincount(i, size[j], len(cid)) + np.bincount(j, size[i], len(cid))
    out = [(int(cid[k]), None, int(links[k])) for k in np.flatnonzero(links)]
    root, by = np.arange(len(cid)), np.argsort(j, kind="stable")
    i, j = i[by], j[by]
    for one, others in zip(np.unique(j).tolist(), np.split(i, np.flatnonzero(np.diff(j)) + 1)):
        for r in np.unique(root[others]).tolist():
            if r != root[one]:
                out.append((int(cid[one]), int(cid[r]), 0))
                low, high = min(r, root[one]), max(r, root[one])
                root[root == high] = low
    return out


def found_links(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, links): a linked with b, or with b null the links of a found in one tile, copies counted."""
    dealt = tiles(cells(classes), "key", "cid", TILE, also=F.max("home"))
    full = dealt.join(classes.select("cid", "label", "n", "embedding"), "cid")
    order, pack = ["key", "tile_i", "tile_j"], TILE
    full = full.repartitionByRange(*order).sortWithinPartitions(*order)  # by range: many tiles of one cell are spread evenly

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if batch.num_rows:
                held = pa.concat_tables([t for t in (held, pa.Table.from_batches([batch])) if t is not None])
                starts = borders(held)
                if len(starts) > 1 and starts[-1] >= pack:
                    yield from packs(held, starts)
                    held = held.slice(starts[-1])
        if held is not None:
            yield from packs(held, np.append(borders(held), held.num_rows))

    def borders(rows: pa.Table) -> np.ndarray:
        """Where a tile's rows begin."""
        cols = np.stack([rows.column(k).to_numpy() for k in order])
        return np.concatenate(([0], np.flatnonzero((cols[:, 1:] != cols[:, :-1]).any(axis=0)) + 1))

    def packs(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The whole tiles between starts, small ones together."""
        first = 0
        for k in range(1, len(starts)):
            if k + 1 == len(starts) or starts[k + 1] - starts[first] > pack:
                got = rows.slice(starts[first], starts[k] - starts[first]).combine_chunks().to_batches()[0]
                yield from done(got, np.repeat(np.arange(k - first), np.diff(starts[first : k + 1])))
                first = k

    def done(rows: pa.RecordBatch, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        get = lambda c: rows.column(rows.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
        cid, size, label, home, key = (get(c) for c in ("cid", "n", "label", "home", "key"))
        side = np.where(get("tile_i") == get("tile_j"), -1, get("chunk"))
        out = []
        for at, unit in _by_dims(rows, "embedding"):
            out += compare(cid[at], size[at], label[at], home[at].astype(bool), side[at], group[at], key[at], unit, threshold)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b", "links"])

    return full.mapInArrow(run, "a long, b long, links long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors(vec_id, label, embedding)."""
    rows, classes = classes_of(vectors)
    found = cut(found_links(classes, threshold))
    links = found.filter("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    labels = components(found.filter("b is not null").select("a", "b"))
    classes = classes.withColumnRenamed("label", "__label").drop("embedding").join(links, F.col("cid") == F.col("a"), "left").join(labels, F.col("cid") == F.col("node"), "left")
    classes = cut(classes.select(F.col("__label").alias("label"), "h1", "h2", "first", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce(F.col("label"), F.col("cid")).alias("root")))
    least = cut(classes.groupBy("root").agg(F.min("first").alias("component_id")))  # a large component is then a skewed key that can be split
    member = classes.join(least, "root").select(F.col("label").alias("__l"), F.col("h1").alias("__h1"), F.col("h2").alias("__h2"), "n_links", "component_id")
    got = rows.join(member, (F.col("label") == F.col("__l")) & (F.col("h1") == F.col("__h1")) & (F.col("h2") == F.col("__h2")), "left")
    component = F.when(F.col("h1").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return got.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
