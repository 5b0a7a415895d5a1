"""Near-duplicates by the Jaccard similarity of word shingles.

Texts whose sets of five-word shingles have a similarity of at least 0.8 are linked, and of each connected component
one row stays. Rows of equal sets are one class. Candidates come from two sources. The SimHash fingerprints of the sets
are linked within three bits by `simhash.links`, which misses no such pair. Sets of similarity 0.8 differ in some ten
bits, too many for blocks of bits, so 16 bands of four MinHash values stand beside: two sets of similarity 0.8 share a
band with probability 0.9998, and more similar ones are missed less often. Classes that share a fingerprint or a band or
have near fingerprints, directly or by others, form a candidate group; inside a group every pair is compared exactly, by
counts of common shingles, so what is linked is never an estimate. Groups beyond TILE classes are split into tiles in which each pair
still meets; their comparisons grow with the square of the group, unless its members are near-duplicates themselves.

Defined results: null and empty texts have no shingles and are one class; texts of fewer words than a shingle have their
whole word sequence as their only shingle; words are lower-cased (A-Z); rows without an id take part; the row that stays
is the one with the smallest id, then text hash, null ids last, and rows repeated in id and text stay or go together in
`near_duplicates`, while `simhash.keep_one` keeps one; an empty table gives an empty result; other columns are not read,
whatever their names.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import WORD, cut, map_rows, tiles
from .graph import components

SEED = 42
BANDS, BAND_ROWS = 16, 4
#: Classes of a group that are compared in one task at once.
TILE = 512
#: Candidate rows up to which they are broadcast to the documents instead of shuffling those.
FEW = 250_000
_WORDS = re.compile(WORD.encode())
_RNG = np.random.default_rng(SEED)
_FACTORS = _RNG.integers(0, 2**64, BANDS * BAND_ROWS, dtype=np.uint64) | np.uint64(1)
_SHIFTS = _RNG.integers(0, 2**64, BANDS * BAND_ROWS, dtype=np.uint64)


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes of text's word shingles."""
    words = _WORDS.findall((text or "").encode().lower())
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    parts = [joined[a:b] for a, b in zip(starts[:n].tolist(), last.tolist())]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, n))


def band_keys(hashes: np.ndarray) -> list[int]:
    """One signed 64-bit key a band; none for an empty set."""
    if not len(hashes):
        return []
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 4096):
        np.minimum(least, (hashes[i : i + 4096, None] * _FACTORS + _SHIFTS).min(axis=0), out=least)
    return [_signed(xxhash.xxh64_intdigest(band.tobytes(), k)) for k, band in enumerate(least.reshape(BANDS, BAND_ROWS))]


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, text_hash, class, fp, bands) of every row; fp, the set's SimHash fingerprint, is null for an empty set."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("text_hash"), F.col(text_col).alias("text"))

    def make():
        def work(batch):
            out = []
            for i, h, text in batch:
                own = shingle_set(text, shingle)
                fp = _signed(simhash.majority(own)) if len(own) else None
                out.append((i, h, _signed(xxhash.xxh64_intdigest(own.tobytes(), SEED)), fp, band_keys(own)))
            return out

        return work

    return map_rows(rows, make, "id long, text_hash long, class long, fp long, bands array<long>")


def spanning(names: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links (places in names) that connect all pairs of sets of at least the similarity."""
    size = np.array(list(map(len, sets)), np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    _, word = np.unique(np.concatenate(sets), return_inverse=True)
    posting = owner[np.argsort(word, kind="stable")]
    first = np.concatenate(([0], np.cumsum(np.bincount(word))))
    at, label, links = np.concatenate(([0], np.cumsum(size))), np.arange(len(sets)), []
    for i in range(len(sets)):
        if (label == label[0]).all():
            break
        mine = word[at[i] : at[i + 1]]
        count = first[mine + 1] - first[mine]
        places = np.repeat(first[mine] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        common = np.bincount(posting[places], minlength=len(sets))
        for j in np.flatnonzero(common >= similarity * (size + size[i] - common)).tolist():
            if label[j] != label[i]:
                links.append((int(names[i]), int(names[j])))
                label[label == label[j]] = label[i]
    return links


def candidates(classes: DataFrame) -> DataFrame:
    """(a, b): classes(class, fp, bands) that share a band or a fingerprint or have fingerprints within three bits."""
    keyed = classes.select("class", F.explode("bands").alias("key"))
    least = keyed.groupBy("key").agg(F.min("class").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "b")
    banded = keyed.join(least, "key").select(F.col("class").alias("a"), "b")
    heads = cut(classes.filter("fp is not null").groupBy("fp").agg(F.min("class").alias("head")))
    alike = classes.join(heads, "fp").select(F.col("class").alias("a"), F.col("head").alias("b")).filter("a <> b")
    near = simhash.links(heads.select("fp"))
    for side in ("a", "b"):
        near = near.join(heads.select(F.col("fp").alias(side), F.col("head").alias(f"__{side}")), side)
    return banded.unionByName(alike).unionByName(near.select(F.col("__a").alias("a"), F.col("__b").alias("b")))


def links(classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, similarity: float, shingle: int) -> DataFrame:
    """(a, b): links that connect all similar classes(class, id, text_hash, fp, bands); id and text_hash name one row of each.

    Only that row meets its class and is shingled, so that copies of a text cost nothing more and are no hot key.
    """
    groups = cut(components(candidates(classes)))
    wanted = cut(classes.join(groups, F.col("class") == F.col("node")).select("class", "label", F.col("id").alias("__id"), F.col("text_hash").alias("__hash")))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("text_hash"), F.col(text_col).alias("text"))
    named = F.col("id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))
    texts = texts.join(F.broadcast(wanted) if wanted.count() <= FEW else wanted, named).select("class", "label", "text")

    def make():
        return lambda batch: [(c, label, shingle_set(text, shingle).view(np.int64).tolist()) for c, label, text in batch]

    sets = map_rows(texts, make, "class long, label long, hashes array<long>", 256).dropDuplicates(["class"])
    dealt = tiles(cut(sets), "label", "class", TILE).repartition("label", "tile_i", "tile_j")  # else the tiles of a label stay together

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        names = table.column("class").to_numpy()
        flat = table.column("hashes").combine_chunks()
        own = [flat[i].values.to_numpy().view(np.uint64) for i in range(len(names))]
        found = np.array(spanning(names, own, similarity), np.int64).reshape(-1, 2)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    return dealt.groupBy("label", "tile_i", "tile_j").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """(id, text_hash, kept): kept marks one (id, text_hash) of each component."""
    rows = cut(signatures(docs, id_col, text_col, shingle))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("first")
    classes = cut(rows.groupBy("class").agg(first, F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    labels = components(links(classes.select("class", "first.id", "first.text_hash", "fp", "bands"), docs, id_col, text_col, similarity, shingle))
    classes = classes.join(labels, F.col("class") == F.col("node"), "left").select("class", "first", F.coalesce("label", "class").alias("root"))
    classes = cut(classes)  # a component of very many classes is then an ordinary skewed key of the next join
    roots = cut(classes.groupBy("root").agg(F.min("first").alias("least")))
    member = classes.join(roots, "root").select("class", "least")
    return rows.join(member, "class").select(
        "id", "text_hash", (F.col("id").eqNullSafe(F.col("least.id")) & (F.col("text_hash") == F.col("least.text_hash"))).alias("kept")
    )
