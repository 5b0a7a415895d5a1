"""Label quality: shares, agreement, F1 and the choice among classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(pairs: DataFrame, a: str, b: str, keys: list[str] | None = None) -> DataFrame:
    return pairs.groupBy(*(keys or []), F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def label_shares(rows: DataFrame, label: str, classes: list) -> DataFrame:
    """(label, n, share) of each class; absent ones have zero."""
    known = rows.sparkSession.createDataFrame([(c,) for c in classes], f"label {rows.schema[label].dataType.simpleString()}")
    per = rows.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    got = known.join(per, "label", "left").na.fill(0, ["n"])
    total = got.agg(F.sum("n").alias("__t"))
    return got.crossJoin(F.broadcast(total)).select("label", "n", F.coalesce(F.try_divide("n", "__t"), F.lit(0.0)).alias("share"))


def agreement(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(n, percent, kappa): observed agreement and Cohen's kappa, null if chance agreement is complete."""
    table = confusion(pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()), a, b)
    total = table.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    rows = table.groupBy("a").agg(F.sum("n").alias("x"))
    columns = table.groupBy(F.col("b").alias("a")).agg(F.sum("n").alias("y"))
    chance = rows.join(columns, "a").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("c"))
    got = total.crossJoin(chance)
    po, pe = F.col("same") / F.col("n"), F.col("c") / (F.col("n") * F.col("n"))
    return got.select("n", po.alias("percent"), F.try_divide(po - pe, 1 - pe).alias("kappa"))


def f1_scores(pairs: DataFrame, truth: str, predicted: str, classes: list, keys: list[str] | None = None) -> DataFrame:
    """(keys, class, support, f1) of each class, zero where nothing is true or predicted."""
    keys = keys or []
    table = confusion(pairs, truth, predicted, keys)
    known = pairs.sparkSession.createDataFrame([(c,) for c in classes], f"class {pairs.schema[truth].dataType.simpleString()}")
    known = pairs.select(*keys).distinct().crossJoin(F.broadcast(known)) if keys else known
    tp = table.filter("a = b").select(*keys, F.col("a").alias("class"), F.col("n").alias("tp"))
    support = table.groupBy(*keys, F.col("a").alias("class")).agg(F.sum("n").alias("support"))
    guessed = table.groupBy(*keys, F.col("b").alias("class")).agg(F.sum("n").alias("guessed"))
    on = [*keys, "class"]
    got = known.join(tp, on, "left").join(support, on, "left").join(guessed, on, "left").na.fill(0, ["tp", "support", "guessed"])
    return got.select(*on, "support", F.coalesce(F.try_divide(2 * F.col("tp"), F.col("support") + F.col("guessed")), F.lit(0.0)).alias("f1"))


def macro_f1(pairs: DataFrame, truth: str, predicted: str, classes: list, keys: list[str] | None = None) -> DataFrame:
    """(keys, n, accuracy, macro_f1)"""
    keys = keys or []
    right = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy"))
    macro = f1_scores(pairs, truth, predicted, classes, keys).groupBy(*keys).agg(F.avg("f1").alias("macro_f1"))
    return right.join(macro, keys) if keys else right.crossJoin(macro)


def choose(scores: DataFrame, order: list[str]) -> DataFrame:
    """The model with the best macro_f1 of scores(model, macro_f1); the first in order wins ties."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("model"))
    return scores.agg(F.max_by("model", F.struct("macro_f1", (-rank).alias("first"))).alias("model"), F.max("macro_f1").alias("macro_f1"))
