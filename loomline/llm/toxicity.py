"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words and word beginnings is trained in numpy from confirmed toxic documents and
unlabelled text: a sample of all documents outside the held-out fold, whether anybody has labelled them or not. With
class prior p and logistic loss l, the risk is p E+[l(+)] + max(0, Eu[l(-)] - p E+[l(-)]); when the second part falls
below zero, the step climbs back along it, so that the fit can't explain unlabelled toxic documents away. As labelled
documents may hold another share of toxic ones than all do, the intercept is then moved so that the scores of the
labelled training documents add up to the number of toxic ones among them. Scores are estimates of P(toxic) and never
see labels, ids, language or source.

The fit uses at most POSITIVES toxic, CLEAN clean and UNLABELLED unlabelled documents, the first by a hash of their
ids; the prior is a share of all training labels. Spark counts the features of these rows; those that tell toxic from
clean documents by more than LEAST_Z standard errors, in LEAST_DOCS documents or more, reach the driver, all of them.

Defined results: null and empty texts score like a text without words; without any toxic training row all scores are
zero; without any clean one, features, prior and intercept come from toxic and unlabelled text alone (see `unlabelled`);
labels of unknown documents and null labels are ignored, and a document labelled twice is toxic if any label is; repeated
rows get the same score; documents without an id are scored but not learned from, and in op1_toxicity their held_out
is null; other columns are not read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, keep_rows, map_rows

#: Bounds of the fit: documents of each kind.
POSITIVES, CLEAN, UNLABELLED = 3000, 6000, 6000
#: Features: their hash space, and what those that count have at least.
SPACE, LEAST_DOCS, LEAST_Z = 1 << 22, 4, 2.5
PREFIXES = (4, 5, 6)
#: Words whose weight a task keeps at hand.
KNOWN = 100_000
_LETTERS = re.compile(r"[^\W\d_]+")


def held_out():
    """True for ids of the fold that is kept from training."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def word_features(word: str) -> list[int]:
    """Slots of a word: itself and its beginnings."""
    names = {"=" + word} | {word[:n] for n in PREFIXES if len(word) >= n}
    return [zlib.crc32(name.encode()) & (SPACE - 1) for name in sorted(names)]


def words_of(text: str | None) -> set[str]:
    return set(_LETTERS.findall((text or "").lower()))


class Counts:
    """A sparse table of small numbers: documents by features."""

    def __init__(self, size: np.ndarray, slots: np.ndarray, features: np.ndarray):
        """slots: of one document after the other, with repeats, size of them each; features: the sorted slots that count."""
        at = np.minimum(np.searchsorted(features, slots), max(0, len(features) - 1))
        there = features[at] == slots if len(features) else np.zeros(len(slots), bool)
        self.shape = (len(size), len(features))
        cell, self.value = np.unique(np.repeat(np.arange(len(size)), size)[there] * max(1, len(features)) + at[there], return_counts=True)
        self.row, self.column = cell // max(1, len(features)), cell % max(1, len(features))

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.shape[0])

    def transposed(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * g[self.row], self.shape[1])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk(plus: Counts, unlabelled: Counts, prior: float, w: np.ndarray, bias: float, decay: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The positive part of the risk, what is left for the negative part, and the gradients of both (bias last)."""
    zp, zu = plus.times(w) + bias, unlabelled.times(w) + bias
    up, down, all_down = (sigmoid(zp) - 1) / len(zp) * prior, sigmoid(zp) / len(zp) * prior, sigmoid(zu) / len(zu)
    positive = prior * np.logaddexp(0, -zp).mean() + decay / 2 * float(w @ w)
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    grad = np.append(plus.transposed(up) + decay * w, up.sum())
    rest = np.append(unlabelled.transposed(all_down) - plus.transposed(down), all_down.sum() - down.sum())
    return positive, negative, grad, rest


def direction(negative: float, grad: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """What a step goes against: the risk's gradient, or below zero that of the negative part, upwards."""
    return grad + rest if negative >= 0 else -rest


def fit_nnpu(plus: Counts, unlabelled: Counts, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam over the non-negative risk."""
    at = np.append(np.zeros(plus.shape[1]), np.log(prior / (1 - prior)))
    moment, square = np.zeros(len(at)), np.zeros(len(at))
    for t in range(1, steps + 1):
        _, negative, grad, rest = risk(plus, unlabelled, prior, at[:-1], at[-1], decay)
        step = direction(negative, grad, rest)
        moment, square = 0.9 * moment + 0.1 * step, 0.999 * square + 0.001 * step * step
        at = at - rate * (moment / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
    return at[:-1], float(at[-1])


def shift(toxic: np.ndarray, clean: np.ndarray, prior: float) -> float:
    """What is added to the scores before the logistic, so that their mean, toxic ones weighing prior, is the prior."""
    low, high = -20.0, 20.0
    for _ in range(60):
        middle = (low + high) / 2
        above = prior * sigmoid(toxic + middle).mean() + (1 - prior) * sigmoid(clean + middle).mean() > prior
        low, high = (low, middle) if above else (middle, high)
    return low


def telling_slots(rows: DataFrame, least_docs: int = LEAST_DOCS, least_z: float = LEAST_Z) -> np.ndarray:
    """The slots that tell toxic from clean documents of rows(kind, slots), by a z score of their document shares; sorted."""
    a, b = F.count_if(F.col("kind") == "toxic"), F.count_if(F.col("kind") == "clean")
    n, m = rows.agg(a, b).first()
    each = rows.filter("kind <> 'unlabelled'").select("kind", F.explode(F.array_distinct("slots")).alias("slot"))
    per = each.groupBy("slot").agg(a.alias("a"), b.alias("b")).filter(F.col("a") + F.col("b") >= least_docs)
    pooled = (F.col("a") + F.col("b")) / F.lit(float(n + m))
    z = F.abs(F.col("a") / F.lit(float(n)) - F.col("b") / F.lit(float(m))) / F.sqrt(pooled * (1 - pooled) * F.lit(1 / n + 1 / m) + F.lit(1e-12))
    return np.sort(np.array([r["slot"] for r in per.filter(z > least_z).select("slot").collect()], np.int64))


class Model:
    """Weights by slot; a text's score is the logistic of the bias plus its distinct words' weights."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias

    def scorer(self):
        known: dict[str, float] = {}
        weights, bias = self.weights, self.bias

        def score(text: str | None) -> float:
            if len(known) > KNOWN:
                known.clear()
            z = bias
            for word in words_of(text):
                w = known.get(word)
                if w is None:
                    w = known[word] = sum(weights.get(f, 0.0) for f in word_features(word))
                z += w
            return float(1 / (1 + np.exp(-min(30.0, max(-700.0, z)))))

        return score


def sample(docs: DataFrame, labels: DataFrame, positives: int, clean: int, unlabelled: int) -> tuple[DataFrame, int, int]:
    """(kind, doc_id) of the fit's documents, at most positives + clean + unlabelled; labels of the fold, and toxic ones."""
    known = labels.filter("toxic is not null and doc_id is not null").filter(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count(F.lit(1)), F.count_if(F.col("toxic") == 1)).first()

    def first(rows: DataFrame, kind: str, most: int) -> DataFrame:
        return rows.orderBy(F.xxhash64(F.lit(kind), "doc_id"), "doc_id").limit(most).select(F.lit(kind).alias("kind"), "doc_id").distinct()

    anyone = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").filter(~held_out())
    chosen = first(known.filter("toxic = 1"), "toxic", positives).unionByName(first(known.filter("toxic <> 1"), "clean", clean))
    return chosen.unionByName(first(anyone, "unlabelled", unlabelled)), n, toxic


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, clean: int = CLEAN, unlabelled: int = UNLABELLED) -> Model:
    """A model from documents and labels outside the held-out fold."""
    chosen, n, toxic = sample(docs, labels, positives, clean, unlabelled)
    if not toxic:
        return Model({}, -700.0)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("kind", "text")

    def make():
        return lambda batch: [(k, [f for w in sorted(words_of(t)) for f in word_features(w)]) for k, t in batch]

    rows = cut(map_rows(texts, make, "kind string, slots array<int>", 256))
    kinds = {r["kind"] for r in rows.select("kind").distinct().collect()}
    if "toxic" not in kinds:
        return Model({}, -700.0)
    if "clean" not in kinds:
        from . import unlabelled as alone

        return alone.train(docs, labels)
    features = telling_slots(rows)

    def narrow():
        counted = set(features.tolist())
        return lambda batch: [(k, [f for f in own if f in counted]) for k, own in batch]

    got = map_rows(rows, narrow, "kind string, slots array<int>", 256).toArrow()

    def counts(kind: str) -> Counts:
        slots = got.filter(pc.equal(got.column("kind"), kind)).column("slots").combine_chunks()
        return Counts(pc.list_value_length(slots).to_numpy(zero_copy_only=False).astype(np.int64), slots.flatten().to_numpy(zero_copy_only=False).astype(np.int64), features)

    of = {k: counts(k) for k in ("toxic", "clean", "unlabelled")}
    prior = min(0.99, max(1e-4, toxic / n))
    weights, bias = fit_nnpu(of["toxic"], of["unlabelled"], prior)
    bias += shift(of["toxic"].times(weights) + bias, of["clean"].times(weights) + bias, prior)
    return Model({int(s): float(w) for s, w in zip(features, weights)}, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""

    def make():
        of = model.scorer()
        return lambda batch: [(i, of(t)) for i, t in batch]

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose score is below threshold; its columns go through unchanged."""

    def make():
        of = model.scorer()
        return lambda text: of(text) < threshold

    return keep_rows(docs, ["text"], make)
