import random
import re

import pytest

from loomline.llm import shingles, simhash

COLUMNS = "doc_id long, text string, lang string"


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(texts):
    """Smallest id of each component of texts whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    sets, root = {i: plain_set(t) for i, t in texts.items()}, {i: i for i in texts}
    for a in texts:
        for b in texts:
            x, y = sets[a], sets[b]
            if b < a and (x == y or len(x & y) >= 0.8 * len(x | y)):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    return set(root.values())


def edited(rng, words, changes):
    words = list(words)
    for at in rng.sample(range(len(words)), changes):
        words[at] = f"new{rng.randrange(10**9)}"
    return words


@pytest.mark.parametrize("tile", [512, 4])
def test_keep_one_against_brute_force(spark, monkeypatch, tile):
    """Copies with up to five changed words, most of them far beyond three bits of a fingerprint."""
    monkeypatch.setattr(shingles, "TILE", tile)
    rng, texts = random.Random(3), {}
    for _ in range(30):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 160))]
        for changes in (0, 0, 1, 1, 2, 3, 5, 20):
            texts[len(texts)] = " ".join(edited(rng, base, changes))
    order = list(texts.items())
    rng.shuffle(order)
    docs = spark.createDataFrame([(i, t, "en") for i, t in order], COLUMNS).repartition(5)
    want = plain_kept(texts)
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == want and len(want) < 200


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == plain_kept(texts)


def test_near_fingerprints_are_candidates_without_bands(spark):
    """Every pair within three bits that is similar enough is linked by its SimHash fingerprints alone."""
    from pyspark.sql import functions as F

    from loomline.llm.graph import components

    rng, texts = random.Random(5), {}
    for _ in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(300)]
        for changes in (0, 1, 1, 2, 40):
            texts[len(texts)] = " ".join(edited(rng, base, changes))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    rows = shingles.signatures(docs, "doc_id", "text", 5).localCheckpoint()
    fp = {r.id: r.fp & (1 << 64) - 1 for r in rows.collect()}
    sets = {i: plain_set(t) for i, t in texts.items()}
    want = [(a, b) for a in texts for b in texts if b < a and bin(fp[a] ^ fp[b]).count("1") <= 3 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    bare = rows.withColumn("bands", F.array().cast("array<long>"))
    label = {r.node: r.label for r in components(shingles.links(bare, docs, "doc_id", "text", 0.8, 5)).collect()}
    own = {r.id: r["class"] for r in rows.collect()}
    assert len(want) > 10 and all(label[own[a]] == label[own[b]] for a, b in want)


def test_bands_find_the_least_similar_pairs():
    """Sets of similarity 0.8 share a band nearly always."""
    import numpy as np

    rng, missed = np.random.default_rng(1), 0
    for _ in range(2000):
        pool = rng.integers(0, 2**64, 110, dtype=np.uint64)
        a, b = np.sort(pool[:99]), np.sort(pool[11:])
        missed += not set(shingles.band_keys(a)) & set(shingles.band_keys(b))
    assert missed <= 5
