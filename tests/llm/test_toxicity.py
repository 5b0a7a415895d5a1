import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from loomline.llm import toxicity, unlabelled

MILD = ["plain" + "abcdefghijklmnopqrst"[i // 20] + "abcdefghijklmnopqrst"[i % 20] for i in range(400)]
RUDE = ["grobian", "grobianisch", "schuft", "schuftig", "lumpenkerl"]


def corpus(spark, n=800):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        toxic = i % 6 == 0
        words = rng.choices(MILD, k=rng.randint(30, 120))
        if toxic:
            for w in rng.choices(RUDE, k=rng.randint(2, 5)):
                words.insert(rng.randrange(len(words)), w + rng.choice(["", "e", "en"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    got = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").filter(toxicity.held_out()).collect()
    assert len(got) > 100
    assert np.mean([(r.score >= 0.3) == (r.toxic == 1) for r in got]) > 0.97


def test_held_out_labels_are_not_used(spark):
    docs, labels = corpus(spark, 300)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, flipped)
    assert a.weights == b.weights and a.bias == b.bias


def test_held_out_texts_are_not_used(spark):
    docs, labels = corpus(spark, 300)
    other = docs.withColumn("text", F.when(toxicity.held_out(), F.lit("grobian plain1 plain2")).otherwise(F.col("text")))
    a, b = toxicity.train(docs, labels), toxicity.train(other, labels)
    assert a.weights == b.weights and a.bias == b.bias


def test_documents_without_a_label_are_used(spark):
    docs, labels = corpus(spark, 400)
    more = spark.range(10_000, 10_400).selectExpr("id AS doc_id", "concat('plainaa plainab grobian ', id) AS text")
    a, b = toxicity.train(docs, labels), toxicity.train(docs.unionByName(more), labels)
    slot = toxicity.word_features("grobian")
    assert set(a.weights) == set(b.weights)
    assert sum(b.weights.get(f, 0) for f in slot) < sum(a.weights.get(f, 0) for f in slot)


def counts(x: np.ndarray) -> toxicity.Counts:
    """The table x, its features being the slots 10, 20, ..."""
    slots = [np.repeat(np.arange(1, x.shape[1] + 1) * 10, row) for row in x]
    return toxicity.Counts(np.array([len(own) for own in slots]), np.concatenate([*slots, np.zeros(0, np.int64)]).astype(np.int64), np.arange(1, x.shape[1] + 1) * 10)


def plain_risk(plus, unlabelled, prior, w, bias, decay):
    zp, zu = plus @ w + bias, unlabelled @ w + bias
    loss = lambda z: np.log(1 + np.exp(-z))
    return prior * loss(zp).mean() + decay / 2 * (w**2).sum(), loss(-zu).mean() - prior * loss(-zp).mean()


def test_risk_and_gradient():
    """Against plain arithmetic and finite differences, where the negative part is above zero and where it is below."""
    rng = np.random.default_rng(1)
    plus, unlabelled = rng.poisson(1.0, (40, 6)), rng.poisson(0.6, (90, 6))
    signs = set()
    for prior, scale, bias in ((0.2, 0.3, 0.1), (0.9, 1.5, -4.0), (0.5, 1.0, 0.0), (0.95, 0.1, 2.0)):
        w = rng.standard_normal(6) * scale
        at = lambda v: plain_risk(plus, unlabelled, prior, v[:-1], v[-1], 0.01)  # noqa: E731, B023
        positive, negative, grad, rest = toxicity.risk(counts(plus), counts(unlabelled), prior, w, bias, 0.01)
        here = np.append(w, bias)
        assert np.allclose((positive, negative), at(here))
        signs.add(negative >= 0)
        for k in range(7):
            step = np.zeros(7)
            step[k] = 1e-5
            slope = (np.array(at(here + step)) - np.array(at(here - step))) / 2e-5
            assert np.allclose((grad[k], rest[k]), slope, atol=1e-6)
        want = grad + rest if negative >= 0 else -rest
        assert np.array_equal(toxicity.direction(negative, grad, rest), want)
    assert signs == {True, False}


def test_the_step_back_raises_a_negative_part_below_zero():
    rng = np.random.default_rng(2)
    plus, unlabelled = counts(rng.poisson(2.0, (50, 4))), counts(rng.poisson(0.1, (50, 4)))
    w, bias = np.full(4, 1.0), -3.0
    _, negative, grad, rest = toxicity.risk(plus, unlabelled, 0.9, w, bias, 0.0)
    assert negative < 0
    back = toxicity.direction(negative, grad, rest)
    _, after, _, _ = toxicity.risk(plus, unlabelled, 0.9, w - 0.01 * back[:-1], bias - 0.01 * back[-1], 0.0)
    assert after > negative


def test_shift():
    rng = np.random.default_rng(5)
    toxic, clean = rng.normal(3, 1, 50), rng.normal(1, 1, 500)
    by = toxicity.shift(toxic, clean, 0.1)
    mean = 0.1 * toxicity.sigmoid(toxic + by).mean() + 0.9 * toxicity.sigmoid(clean + by).mean()
    assert abs(mean - 0.1) < 1e-9


def test_estimated_prior():
    """Scores that overlap: the prior is found within a few hundredths, with few toxic documents too."""
    rng = np.random.default_rng(6)
    for n, share in ((60, 0.1), (600, 0.1), (600, 0.4)):
        y = rng.random(4000) < share
        got = unlabelled.estimated_prior(rng.normal(3, 1, n), np.where(y, rng.normal(3, 1, 4000), rng.normal(0, 1, 4000)))
        assert abs(got - share) < 0.05
    assert unlabelled.estimated_prior(np.zeros(0), np.zeros(3)) == unlabelled.FIRST_PRIOR


def test_without_clean_labels(spark):
    """Toxic labels alone: still learned, and near the truth on held-out documents."""
    docs, labels = corpus(spark)
    toxic = labels.filter("toxic = 1")
    a, b = toxicity.train(docs, toxic), unlabelled.train(docs, labels)
    assert a.weights == b.weights and a.bias == b.bias and a.weights
    got = toxicity.score(docs, a).join(labels, "doc_id").filter(toxicity.held_out()).collect()
    assert np.mean([(r.score >= 0.3) == (r.toxic == 1) for r in got]) > 0.97
    assert unlabelled.train(docs, toxic, prior=0.5).bias > b.bias
    z = np.random.default_rng(5).normal(1, 2, 500)
    assert abs(toxicity.sigmoid(z + unlabelled.shift(z, 0.1)).mean() - 0.1) < 1e-9


def test_scores_by_plain_arithmetic(spark):
    docs, labels = corpus(spark, 200)
    model = toxicity.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.score(docs, model).collect():
        z = model.bias
        for word in set(texts[r.doc_id].split()):
            word = "".join(c for c in word if c.isalpha())
            names = {"=" + word, *(word[:n] for n in (4, 5, 6) if len(word) >= n)}
            z += sum(model.weights.get(zlib.crc32(n.encode()) % toxicity.SPACE, 0.0) for n in names) if word else 0.0
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9


def test_unlabelled_positives_do_not_spoil_the_fit():
    """Half of the toxic rows are among the unlabelled ones; the corrected risk still ranks them first."""
    rng = np.random.default_rng(0)
    y = rng.random(2000) < 0.3
    x = np.where(y[:, None], rng.poisson(1.5, (2000, 5)), rng.poisson(0.2, (2000, 5)))
    positive = np.zeros(2000, bool)
    positive[np.flatnonzero(y)[: y.sum() // 2]] = True
    w, b = toxicity.fit_nnpu(counts(x[positive]), counts(x[~positive]), 0.3 * 0.5 / (1 - 0.3 * 0.5))
    z = x @ w + b
    hidden, clean = z[y & ~positive], z[~y]
    assert (hidden[:, None] > clean[None, :]).mean() > 0.95


def test_edge_cases(spark, docs, no_docs):
    none = spark.createDataFrame([(1, None), (None, 1), (999, 1)], "doc_id long, toxic int")
    empty = none.filter("false")
    for labels in (none, empty):
        rows = toxicity.score(docs, toxicity.train(docs, labels)).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(no_docs, toxicity.Model({}, 0.0)).count() == 0
    kept = toxicity.keep_clean(docs, toxicity.Model({}, -5.0))
    assert kept.columns == docs.columns and kept.count() == docs.count()
