from collections import Counter

import pytest

import corpus_pipeline
from loomline.llm import packing, quality, simhash, toxicity
from loomline.llm.common import dense_index, numbered, table
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder, out = tmp_path_factory.mktemp("stages"), []
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        got = spark.read.parquet(f"{folder}/{name}")
        out.append((name, docs, got))
        docs = got
    return out


def test_columns_and_effects(spark, stages):
    columns = table(spark, SF, "documents").columns
    assert all(got.columns == columns for _, _, got in stages[:-1])
    rows = {name: (before.collect(), got.collect()) for name, before, got in stages}
    before, after = rows["quality"]
    measure = quality._measure(None)
    assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before if measure(r.text, r.lang)[6])
    before, after = rows["toxicity"]
    score = toxicity.train(stages[1][1], table(spark, SF, "labels")).scorer()
    assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before if score(r.text) < corpus_pipeline.TOXIC)
    before, after = rows["near_duplicates"]
    left = {simhash.fingerprint(r.text) for r in after}
    assert len(left) == len(after) and all(a == b or bin(a ^ b).count("1") > 3 for a in left for b in left)
    assert all(any(bin(simhash.fingerprint(r.text) ^ f).count("1") <= 3 for f in left) or r.doc_id not in {x.doc_id for x in after} for r in before)
    before, after = rows["mixing"]
    assert set(Counter(after).values()) <= {1, 2, 3} and set(after) <= set(before)
    before, after = rows["packing"]
    encode = packing.encoder()
    assert sum(r.length for r in after) == sum(len(encode(r.text)) + 1 for r in before)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_numbering(spark, docs):
    hot = spark.range(5000).selectExpr("id", "case when id % 3 = 0 then null else 'x' end AS g")
    rows = numbered(hot, ["g"], F.xxhash64("id"), [F.col("id")], F.when(F.col("g").isNull(), 20).otherwise(40), "n").collect()
    for g in ("x", None):
        assert sorted(r.n for r in rows if r.g == g) == list(range(sum(r.g == g for r in rows)))
    got = dense_index(hot, [F.col("g").asc_nulls_last(), F.col("id")], "n").collect()
    assert [r.n for r in sorted(got, key=lambda r: (r.g is None, r.g or "", r.id))] == list(range(5000))
