"""Class scores from logits: softmax, score and label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLASSES = ("negative", "neutral", "positive")


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits, shifted by their maximum."""
    top = F.array_max(logits)
    weights = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(weights, lambda x: x / F.aggregate(weights, F.lit(0.0), lambda a, b: a + b))


#: Names that models give the classes; labels without a name (label_0 ..) must be given by hand.
SYNONYMS = {"neg": "negative", "bearish": "negative", "neu": "neutral", "pos": "positive", "bullish": "positive"}


def canonical_labels(names: list[str], overrides: dict[str | int, str] | None = None) -> list[str]:
    """A model's class names in its own order as CLASSES; overrides go by name or place. Each class must occur once."""
    overrides = overrides or {}
    out = []
    for place, name in enumerate(names):
        said = overrides.get(place, overrides.get(name, name)).strip().lower()
        out.append(SYNONYMS.get(said, said))
    if sorted(out) != sorted(CLASSES):
        raise ValueError(f"{names} are not the three classes {CLASSES}")
    return out


def reorder(values: Column, classes: list[str]) -> Column:
    """values, given in the order of classes, in the order of CLASSES."""
    if sorted(classes) != sorted(CLASSES):
        raise ValueError(f"expected the classes {CLASSES}, not {classes}")
    return F.array(*[values[classes.index(c)] for c in CLASSES])


def score_of(p: Column) -> Column:
    """P(positive) - P(negative)"""
    return p[2] - p[0]


def label_of(p: Column) -> Column:
    """The likeliest class; the first one wins ties."""
    return F.element_at(F.array(*map(F.lit, CLASSES)), F.array_position(p, F.array_max(p)).cast("int"))
