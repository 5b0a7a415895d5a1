"""Documents to packed training sequences: quality, toxicity, near-duplicates, mixing, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loomline.llm import mixing, packing, quality, simhash, toxicity
from loomline.llm.common import checkpoint_dir, table

#: The score from which a document is toxic, as in op1_toxicity.
TOXIC = 0.3


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality rules reject."""
    return quality.keep_good(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that a classifier, trained on the labels of what is left, finds toxic."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), TOXIC)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources reach their target weights."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("quality", keep_good),
    ("toxicity", keep_clean),
    ("near_duplicates", keep_one),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Tokenisers, a trained classifier and best-fit packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet under the shared folder and read again by the next.

    A stage's folder goes once the next one is written; the last one's stays, as the result reads it.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, f"{folder}/{before}")
        before = name
    return docs
