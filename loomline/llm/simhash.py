"""SimHash near-duplicates: word-shingle fingerprints compared in vertical bit planes.

Fingerprints within `radius` bits are linked and every document gets its connected component. Equal fingerprints
are one class, so exact copies never meet as pairs. Of five blocks of the 64 bits, two fingerprints that differ in
at most three bits agree on at least two; each class is filed under its ten pairs of blocks, and inside such a
bucket all distances are counted at once: bit b of 64 fingerprints is one machine word (a plane), a query's
difference from all of them is one XOR per plane, carry-save counters add the planes up, and a block of lanes is
abandoned once each of its counters has exceeded the radius. Buckets beyond TILE rows are split into tiles in
which each pair still meets.

Defined results: null and empty texts have no shingles and fingerprint zero, and are linked like any other; texts of
fewer words than a shingle hash their whole word sequence; repeated rows and ties fall into one class; rows without
an id take part, and a component's id is its smallest id that is not null; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import re

from .common import cut, map_rows, tiles
from .graph import components

SEED = 42
#: (first bit, bits) of the five blocks.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Rows of a bucket that are compared in one task at once.
TILE = 8192
LANES = 64
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of text's lower-cased (A-Z) word shingles."""
    words = _WORDS.findall((text or "").encode().lower())
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    parts = [joined[a:b] for a, b in zip(starts[:n].tolist(), last.tolist())]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, n)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the 64-bit hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i : i + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, text_hash, fp) of every row; text_hash tells rows of one id with different texts apart."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("text_hash"), F.col(text_col).alias("text"))

    def make():
        def work(batch):
            out = []
            for i, h, text in batch:
                fp = fingerprint(text, shingle)
                out.append((i, h, fp - (1 << 64) if fp >> 63 else fp))
            return out

        return work

    return map_rows(rows, make, "id long, text_hash long, fp long")


def block_keys(fp: Column) -> list[Column]:
    """One key for each two blocks: their bits beside the pair's number."""
    value = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << n) - 1).cast("long")) for a, n in BLOCKS]
    return [
        F.shiftleft(F.lit(k).cast("long"), 26) + F.shiftleft(value[i], 13) + value[j]
        for k, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))
    ]


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """(64, words): bit i of word w of plane b is bit b of fingerprint 64 * w + i."""
    n = -(-len(fps) // 64) * 64
    padded = np.zeros(n, "<u8")
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def close(queries: np.ndarray, planes: np.ndarray, radius: int = 3) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, lane) index arrays of all pairs within radius, lanes as in bit_planes."""
    depth = (radius + 1).bit_length() if radius & (radius + 1) else radius.bit_length()
    start = (1 << depth) - 1 - radius  # counters overflow just beyond the radius
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for q0 in range(0, len(queries), 256):
        own = queries[q0 : q0 + 256]
        for w0 in range(0, planes.shape[1], 64):
            block = planes[:, w0 : w0 + 64]
            rows = np.arange(len(own))
            shape = (len(own), block.shape[1])
            count = [np.full(shape, full if start >> k & 1 else 0, np.uint64) for k in range(depth)]
            over = np.zeros(shape, np.uint64)
            for b in range(64):
                bit = own[rows] >> np.uint64(b) & np.uint64(1)
                carry = block[b][None, :] ^ (np.uint64(0) - bit)[:, None]
                for k in range(depth):
                    count[k], carry = count[k] ^ carry, count[k] & carry
                over |= carry
                if b % 8 == 7:
                    alive = (over != full).any(axis=1)
                    if not alive.all():
                        if not alive.any():
                            rows = rows[:0]
                            break
                        rows, over, count = rows[alive], over[alive], [c[alive] for c in count]
            if len(rows):
                bits = np.unpackbits(np.ascontiguousarray(~over).view(np.uint8), axis=1, bitorder="little")
                i, j = np.nonzero(bits)
                yield rows[i] + q0, j + 64 * w0


def spanning(fps: np.ndarray, bucket: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links inside equal bucket numbers, as few as connect all that are within radius."""
    planes, label, links = bit_planes(fps), np.arange(len(fps)), []
    for i, j in close(fps, planes, radius):
        keep = j < i
        i, j = i[keep], j[keep]
        keep = bucket[i] == bucket[j]
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        cuts = np.flatnonzero(np.diff(i)) + 1
        for one, others in zip(i[np.concatenate(([0], cuts))].tolist(), np.split(j, cuts)):
            roots, at = np.unique(label[others], return_index=True)
            for root, other in zip(roots.tolist(), others[at].tolist()):
                if root != label[one]:
                    links.append((int(fps[one]), int(fps[other])))
                    low, high = min(root, label[one]), max(root, label[one])
                    label[label == high] = low
    return links


def links(classes: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b): links that connect all fingerprints of classes(fp), distinct, within radius bits."""
    if not 0 <= radius <= 3:
        raise ValueError("two of five blocks agree up to 3 differing bits only")
    keyed = classes.select("fp", F.explode(F.array(*block_keys(F.col("fp")))).alias("key"))
    dealt = tiles(keyed, "key", "fp", TILE).repartition("key", "tile_i", "tile_j").sortWithinPartitions("key", "tile_i", "tile_j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_fp, held_run, last, number = np.zeros(0, np.uint64), np.zeros(0, np.int64), None, 0
        for batch in batches:
            cols = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("key", "tile_i", "tile_j")])
            fp = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            if not len(fp):
                continue
            new = np.ones(len(fp), bool)
            new[1:] = (cols[:, 1:] != cols[:, :-1]).any(axis=0)
            new[0] = last is None or bool((cols[:, 0] != last).any())
            runs = np.cumsum(new) + number
            number, last = int(runs[-1]), cols[:, -1].copy()
            fp, runs = np.concatenate((held_fp, fp)), np.concatenate((held_run, runs))
            done = int(np.searchsorted(runs, number))
            if done:
                yield from packed(fp[:done], runs[:done])
            held_fp, held_run = fp[done:], runs[done:]
        if len(held_fp):
            yield from packed(held_fp, held_run)

    def packed(fp: np.ndarray, runs: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Small runs share a block of LANES; a larger one has its own."""
        edges = np.flatnonzero(np.diff(runs)) + 1
        starts, ends = np.concatenate(([0], edges)).tolist(), np.concatenate((edges, [len(fp)])).tolist()
        out, first = [], 0
        for k, end in enumerate(ends):
            if k + 1 == len(ends) or ends[k + 1] - starts[first] > LANES:
                out += spanning(fp[starts[first] : end], runs[starts[first] : end], radius)
                first = k + 1
        if out:
            pairs = np.array(out, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return dealt.select("fp", "key", "tile_i", "tile_j").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, shingle: int = 3) -> DataFrame:
    """(id, text_hash, fp, component_id, kept): kept marks one (id, text_hash) of each component."""
    rows = cut(fingerprints(docs, id_col, text_col, shingle))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("first")
    classes = rows.groupBy("fp").agg(first)
    labels = components(links(classes.select("fp"), radius))
    classes = classes.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("label", "fp").alias("root"))
    classes = cut(classes)  # a component of very many classes is then an ordinary skewed key of the next join
    roots = cut(classes.groupBy("root").agg(F.min("first").alias("least")))
    member = classes.join(roots, "root").select("fp", "least")
    return rows.join(member, "fp").select(
        "id",
        "text_hash",
        "fp",
        F.col("least.id").alias("component_id"),
        (F.col("id").eqNullSafe(F.col("least.id")) & (F.col("text_hash") == F.col("least.text_hash"))).alias("kept"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """docs with one row of each component of texts whose word shingles have at least the similarity (see `shingles`).

    Texts are shuffled once, to meet the decisions; only rows that repeat an id and a text are moved again.
    """
    from . import shingles  # it takes its candidates from this module

    kept = shingles.near_duplicates(docs, id_col, text_col, similarity, shingle).filter("kept")
    kept = cut(kept.groupBy(F.col("id").alias("__kid"), F.col("text_hash").alias("__kh")).agg(F.count(F.lit(1)).alias("__n")))
    hashed = docs.withColumn("__h", F.xxhash64(F.coalesce(text_col, F.lit("")))).withColumn("__i", F.col(id_col).cast("long"))
    joined = hashed.join(kept, F.col("__i").eqNullSafe(F.col("__kid")) & (F.col("__h") == F.col("__kh")))
    once, again = joined.filter("__n = 1"), joined.filter("__n > 1").dropDuplicates(["__i", "__h"])
    return once.select(*docs.columns).unionByName(again.select(*docs.columns))
