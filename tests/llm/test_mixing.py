import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from loomline.llm import mixing


def plain_targets(sizes, most=3.0):
    """Targets by clamping and sharing again until none is above its clamp."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    free, out, left = set(names), {}, float(sum(sizes.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= most * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= over
    return out


@pytest.fixture(scope="module")
def many(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.expr("repeat('w ', cast(1 + pmod(xxhash64(id), 40) as int))").alias("text"),
        F.expr("case when id % 3 = 0 then 'big' when id % 50 = 1 then null when id % 7 = 0 then 'é' else concat('s', cast(id % 5 as string)) end").alias("source"),
    )
    return rows


def test_targets_and_taken(many):
    rows = mixing.mixture(many).collect()
    source = {r.doc_id: r.source for r in many.collect()}
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        sizes[source[r.doc_id]] += r["size"]
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        assert r.taken % max(r["size"], 1) == 0 and r.taken <= 3 * r["size"]
    want = plain_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s], rel=1e-9)
        assert abs(taken[s] - target[s]) <= 0.5, s
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))


@pytest.mark.parametrize("seed", range(40))
def test_nearest_subset_equals_trying_all(seed):
    rng = random.Random(seed)
    sizes, goal = [rng.randint(1, 60) for _ in range(rng.randint(0, 11))], rng.uniform(-2, 250)
    best = min((abs(sum(c) - goal), sum(c)) for r in range(len(sizes) + 1) for c in combinations(sizes, r))
    got = sum(sizes[k] for k in mixing.nearest_subset(sizes, goal))
    assert (abs(got - goal), got) == pytest.approx(best)


def test_small_sources_come_as_near_as_any_choice(spark):
    """On the given tables every source is within 1 % of its target or as near as any subset of its documents."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    by = defaultdict(list)
    for r in mixing.mixture(docs).collect():
        by[source[r.doc_id]].append(r)
    for rows in by.values():
        whole, target = int(rows[0].target // rows[0].source_size), rows[0].target
        off = abs(sum(r.taken for r in rows) - target)
        sums = {0}
        for r in rows:
            sums |= {s + r["size"] for s in sums}
        best = min(abs(whole * rows[0].source_size + s - target) for s in sums)
        assert off <= max(0.01 * target, best + 1e-6)


def test_reruns_and_partitions_agree(many):
    a, b = ({r.doc_id: r.taken for r in mixing.mixture(m).collect()} for m in (many, many.repartition(7)))
    assert a == b


def test_clamped_sources(spark):
    rows = [(i, "x " * 10, "tiny") for i in range(2)] + [(10 + i, "x " * 10, s) for i in range(300) for s in ("b", "c")]
    rows = [(k, t, s) for k, (_, t, s) in enumerate(rows)]
    got = mixing.mixture(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    by = {r.source_size: r.target for r in got.collect()}
    assert by[20] == 60.0


def test_mix_repeats_rows(many):
    plan = {r.doc_id: r.taken // r["size"] for r in mixing.mixture(many).collect()}
    got = Counter(r.doc_id for r in mixing.mix(many).collect())
    assert got == Counter({k: v for k, v in plan.items() if v})


def test_edge_cases(docs, no_docs):
    rows = mixing.mixture(docs).collect()
    assert len(rows) == docs.count()
    words = {(r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs.collect()}
    assert {(r.doc_id, r["size"]) for r in rows} == words
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mixture(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0


def test_no_words(spark):
    got = mixing.mixture(spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")).collect()
    assert sorted((r.doc_id, r["size"], r.target, r.taken) for r in got) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_water_level_stops(spark):
    sources = spark.createDataFrame([(1.0, 3.0), (2.0, 300.0), (3.0, 3000.0)], "weight double, cap double")
    level = mixing.water_level(sources, 1000.0)
    assert sum(min(c, level * w) for w, c in ((1, 3), (2, 300), (3, 3000))) == pytest.approx(1000)
    assert defaultdict(int) == {}


def test_clashing_columns_go_through(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "repeat('w ', int(id % 7)) AS text", "if(id % 3 = 0, 'a', 'b') AS source")
    for name in ("times", "size", "weight", "target", "hash", "bucket", "rest", "edge", "room", "docs", "cap"):
        docs = docs.withColumn(name, F.lit("clash"))
    got = mixing.mix(docs)
    assert got.columns == docs.columns and {r.times for r in got.select("times").collect()} == {"clash"}
    taken = {r.doc_id: r.taken for r in mixing.mixture(docs).collect()}
    words = {}
    for r in got.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert all(words.get(i, 0) == n for i, n in taken.items())
