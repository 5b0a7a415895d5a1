import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomline.llm import simhash
from loomline.llm.graph import components


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("text", [None, "", " \n", "One", "ONE two", "one Two THREE", "Ä b ß c Ä b ß c 😀 x\ty\x0bz", "a " * 5000, "w1 w2 w3 w4 " * 17 + " x"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_bit_planes_find_all_pairs(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    fps = np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(5)]])
    got = {(int(i), int(j)) for a, b in simhash.close(fps, simhash.bit_planes(fps), radius) for i, j in zip(a, b) if j < len(fps)}
    distance = np.bitwise_count(fps[:, None] ^ fps[None, :])
    assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(distance <= radius))))


@pytest.mark.parametrize("tile", [8192, 16])
def test_components_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(500):
        fp = rng.choice(fps)
        for _ in range(rng.randint(0, 4)):
            fp ^= 1 << rng.randrange(64)
        fps.append(fp)
    fps = sorted({fp - 2**64 if fp >> 63 else fp for fp in fps})
    frame = spark.createDataFrame([(fp,) for fp in fps], "fp long").repartition(5)
    got = {r.node: r.label for r in components(simhash.links(frame)).collect()}
    linked = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if bin((a ^ b) & (2**64 - 1)).count("1") <= 3]
    want = plain_components(fps, linked)
    assert {n: got.get(n, n) for n in fps} == want


def test_near_duplicates(spark, docs):
    rows = simhash.near_duplicates(docs).collect()
    given = docs.collect()
    assert len(rows) == len(given)
    fps = {plain_fingerprint(r.text) for r in given}
    want = plain_components(fps, [(a, b) for a in fps for b in fps if a != b and bin(a ^ b).count("1") <= 3])
    least = defaultdict(set)
    for r in given:
        if r.doc_id is not None:
            least[want[plain_fingerprint(r.text)]].add(r.doc_id)
    for r in rows:
        ids = least[want[r.fp & (2**64 - 1)]]
        assert r.component_id == (min(ids) if ids else None)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(want.values()))


def test_empty(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.keep_one(no_docs).count() == 0


def test_chain_components(spark):
    """A long path and a star, in shuffled order, with nulls, self links and repeats."""
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5), (None, 3), (7, 6), (6, 7)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(200)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert spark.range(1).select(F.lit(1)).count() == 1
