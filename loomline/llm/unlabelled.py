"""Toxicity where no label says that a document is clean: features, prior and intercept from toxic and unlabelled text alone.

The prior is a parameter or is estimated: each third of the sample is scored by a classifier fitted on the others, and
over all thresholds the share of unlabelled documents above it over the share of toxic ones is taken where its upper
confidence bound is least (after Garg, Wu, Smola, Balakrishnan and Lipton 2021). Features are those that tell toxic
from unlabelled documents by more than LEAST_Z standard errors; in a second fit, toxic and what the first one finds so
from the rest. The intercept is moved so that the mean score of unlabelled text is the prior. Without toxic rows all
scores are zero; where no feature tells, every score is the prior.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_rows
from .toxicity import LEAST_DOCS, Counts, Model, fit_nnpu, held_out, sigmoid, word_features, words_of

#: Bounds of the fit: documents of each kind. Standard errors by which a feature tells.
POSITIVES, UNLABELLED, LEAST_Z = 3000, 12_000, 4.0
#: The prior of the classifiers that the prior is estimated with, the standard errors of its upper bound, parts scored in turn,
#: and the least share of toxic documents above a threshold that counts.
FIRST_PRIOR, DOUBT, PARTS, LEAST_ABOVE = 0.3, 1.64, 3, 0.3


def shift(z: np.ndarray, prior: float) -> float:
    """What is added to the values z before the logistic, so that its mean is the prior."""
    low, high = -20.0, 20.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if sigmoid(z + middle).mean() > prior else (middle, high)
    return low


def estimated_prior(plus: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of toxic documents among unlabelled ones, from scores of both that the classifiers weren't fitted on."""
    if not len(plus) or not len(unlabelled):
        return FIRST_PRIOR
    cuts = np.unique(plus)
    above = 1 - np.searchsorted(np.sort(plus), cuts) / len(plus)
    share = np.maximum(1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled), 0.5 / len(unlabelled))
    spread = np.sqrt((1.5 - above) / above / len(plus) + (1 - share) / share / len(unlabelled))
    best = int(np.argmin(np.where(above >= LEAST_ABOVE, share / above * (1 + DOUBT * spread), np.inf)))
    return float(np.clip(share[best] / above[best], 1 / (len(unlabelled) + 1), 0.9))


def telling_slots(rows: DataFrame, least_docs: int = LEAST_DOCS, least_z: float = LEAST_Z) -> tuple[np.ndarray, np.ndarray]:
    """(slots, told): sorted slots that tell toxic from unlabelled documents of rows(kind, part, slots), by a z score of their shares.

    told has a row for each part, true for slots that tell without it, and a last one for those that tell in all parts
    together.
    """
    kinds, parts = ("toxic", "unlabelled"), range(PARTS)
    counts = [F.count_if((F.col("kind") == k) & (F.col("part") == p)).alias(f"{k}{p}") for k in kinds for p in parts]
    whole = rows.agg(*counts).first()
    per = rows.select("kind", "part", F.explode(F.array_distinct("slots")).alias("slot")).groupBy("slot").agg(*counts)

    def tells(without: int) -> Column:
        n, m = (sum(whole[f"{k}{p}"] for p in parts if p != without) for k in kinds)
        if not n or not m:
            return F.lit(False)
        a, b = (sum((F.col(f"{k}{p}") for p in parts if p != without), F.lit(0)) for k in kinds)
        pooled = (a + b) / F.lit(float(n + m))
        z = F.abs(a / F.lit(float(n)) - b / F.lit(float(m))) / F.sqrt(pooled * (1 - pooled) * F.lit(1 / n + 1 / m) + F.lit(1e-12))
        return (z > least_z) & (a + b >= least_docs)

    told = per.select("slot", *[tells(p).alias(f"t{p}") for p in range(PARTS + 1)])
    got = sorted(tuple(r) for r in told.filter(" or ".join(f"t{p}" for p in range(PARTS + 1))).collect())
    return np.array([r[0] for r in got], np.int64), np.array([r[1:] for r in got], bool).reshape(-1, PARTS + 1).T


def sample(docs: DataFrame, labels: DataFrame, positives: int, unlabelled: int) -> DataFrame:
    """(kind, doc_id, part) of the fit's documents, at most positives + unlabelled; each part is scored by a fit on the others."""
    known = labels.filter("toxic = 1 and doc_id is not null").filter(~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"))
    anyone = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").filter(~held_out())

    def first(rows: DataFrame, kind: str, most: int) -> DataFrame:
        named = rows.orderBy(F.xxhash64(F.lit(kind), "doc_id"), "doc_id").limit(most).distinct()
        return named.select(F.lit(kind).alias("kind"), "doc_id", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(PARTS)).cast("int").alias("part"))

    return first(known.distinct(), "toxic", positives).unionByName(first(anyone, "unlabelled", unlabelled))


class Fitting:
    """The sample as a table of slots, cut off, from which tables of counts are read."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def read(self, slots: np.ndarray) -> pa.Table:
        def narrow():
            counted = set(slots.tolist())
            return lambda batch: [(k, part, [f for f in own if f in counted]) for k, part, own in batch]

        return map_rows(self.rows, narrow, "kind string, part int, slots array<int>", 256).toArrow()

    @staticmethod
    def counts(got: pa.Table, kind: str, parts: list[int], features: np.ndarray) -> Counts:
        chosen = pc.and_(pc.equal(got.column("kind"), kind), pc.is_in(got.column("part"), pa.array(parts, pa.int32())))
        own = got.filter(chosen).column("slots").combine_chunks()
        return Counts(pc.list_value_length(own).to_numpy(zero_copy_only=False).astype(np.int64), own.flatten().to_numpy(zero_copy_only=False).astype(np.int64), features)

    def prior(self, got: pa.Table, slots: np.ndarray, told: np.ndarray) -> float:
        """The estimated prior; each part is scored by a fit, with features of its own, on the other parts."""
        scores: dict[str, list[np.ndarray]] = {"toxic": [], "unlabelled": []}
        for part in range(PARTS):
            others = [p for p in range(PARTS) if p != part]
            seen, unseen = ({k: self.counts(got, k, parts, slots[told[part]]) for k in scores} for parts in (others, [part]))
            if all(c.shape[0] for c in seen.values()):
                weights, bias = fit_nnpu(seen["toxic"], seen["unlabelled"], FIRST_PRIOR, steps=200)
                for k, c in unseen.items():
                    scores[k].append(c.times(weights) + bias)
        return estimated_prior(*(np.concatenate([*own, np.zeros(0)]) for own in scores.values()))

    def fit(self, got: pa.Table, features: np.ndarray, prior: float) -> Model:
        plus, others = (self.counts(got, k, list(range(PARTS)), features) for k in ("toxic", "unlabelled"))
        weights, bias = fit_nnpu(plus, others, prior)
        return Model({int(s): float(w) for s, w in zip(features, weights)}, bias + shift(others.times(weights) + bias, prior))

    def sorted_by(self, model: Model) -> DataFrame:
        """The sample with those unlabelled documents as toxic that model finds so."""

        def make():
            weights, bias = model.weights, model.bias
            return lambda batch: [("toxic" if k == "toxic" or sum(weights.get(f, 0.0) for f in own) + bias >= 0 else k, part, own) for k, part, own in batch]

        return map_rows(self.rows, make, "kind string, part int, slots array<int>", 256)


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, prior: float | None = None) -> Model:
    """A model from toxic documents and unlabelled text outside the held-out fold.

    The features of the first fit tell confirmed toxic documents from all unlabelled ones; those of the second tell
    these and what the first fit finds toxic from the rest. Both fits learn their weights from confirmed documents alone.
    """
    texts = docs.select("doc_id", "text").join(F.broadcast(sample(docs, labels, positives, unlabelled)), "doc_id").select("kind", "part", "text")

    def make():
        return lambda batch: [(k, part, [f for w in sorted(words_of(t)) for f in word_features(w)]) for k, part, t in batch]

    rows = cut(map_rows(texts, make, "kind string, part int, slots array<int>", 256))
    if not rows.filter("kind = 'toxic'").limit(1).count():
        return Model({}, -700.0)
    own = Fitting(rows)
    slots, told = telling_slots(rows)
    got = own.read(slots)
    prior = own.prior(got, slots, told) if prior is None else prior
    first = own.fit(got, slots[told[PARTS]], prior)
    slots, told = telling_slots(own.sorted_by(first))
    return own.fit(own.read(slots[told[PARTS]]), slots[told[PARTS]], prior)
