import zlib
from collections import Counter

from loomline.llm import sharding


def test_laws(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "concat('text ', id) AS text").repartition(5)
    rows = sharding.shard(docs).collect()
    per = Counter(r["shard"] for r in rows)
    assert set(per) == set(range(24)) and max(per.values()) < 1.4 * 250
    for s, n in per.items():
        assert sorted(r.slot for r in rows if r["shard"] == s) == list(range(n))
    moved = [r for r in rows if r.grown_shard != r["shard"]]
    assert {r.grown_shard for r in moved} == {24} and 0.02 < len(moved) / len(rows) < 0.065
    assert all(r.text_crc32 == zlib.crc32(f"text {r.doc_id}".encode()) and r["size"] == len(f"text {r.doc_id}") + 8 for r in rows)


def test_weights_draw_in_proportion(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "'' AS text")
    per = Counter(r["shard"] for r in sharding.shard(docs, weights=[1.0, 2.0, 3.0]).collect())
    assert abs(per[0] - 1000) < 150 and abs(per[1] - 2000) < 180 and abs(per[2] - 3000) < 200


def test_other_rows_do_not_matter(spark):
    docs = spark.range(500).selectExpr("id AS doc_id", "'x' AS text")
    a = {r.doc_id: r["shard"] for r in sharding.shard(docs).collect()}
    b = {r.doc_id: r["shard"] for r in sharding.shard(docs.filter("doc_id % 3 = 0")).collect()}
    assert all(a[k] == v for k, v in b.items())


def test_edge_cases(docs, no_docs):
    rows = sharding.shard(docs).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert {(r["size"], r.text_crc32) for r in rows if r.doc_id == 4} == {(8, 0)}
    assert sharding.shard(no_docs).count() == 0


def plain_xxh64(data: bytes, seed: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data, seed)


def plain_shard(key: int, weights) -> int:
    """The winning shard by plain arithmetic: Spark hashes column by column, each hash being the next one's seed."""
    import math

    best = None
    for shard, weight in enumerate(weights):
        h = plain_xxh64(b"shard", 42)
        if key is not None:
            h = plain_xxh64((key & (1 << 64) - 1).to_bytes(8, "little"), h)
        h = plain_xxh64(shard.to_bytes(4, "little"), h)
        score = -weight / math.log(((h >> 11) + 0.5) * 2.0**-53)
        if best is None or score > best[0]:
            best = (score, shard)
    return best[1]


def test_brute_force(spark):
    weights = [1.0, 2.0, 0.5, *[1.0] * 21]
    docs = spark.range(-50, 1500).selectExpr("if(id = 7, null, id) AS doc_id", "concat('t', id % 90) AS text")
    rows = sharding.shard(docs, weights=weights, grown=1.5).collect()
    assert [r["shard"] for r in rows] == [plain_shard(r.doc_id, weights) for r in rows]
    assert [r.grown_shard for r in rows] == [plain_shard(r.doc_id, [*weights, 1.5]) for r in rows]
    for s in range(24):
        assert sorted(r.slot for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))


def test_write_shards(spark, tmp_path):
    docs = spark.range(200).selectExpr("id AS doc_id", "'x' AS text", "'clash' AS shard", "map('a', id) AS m")
    sharding.write_shards(docs, f"{tmp_path}/out", weights=[1.0] * 4)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    want = {r.doc_id: r["shard"] for r in sharding.shard(docs, weights=[1.0] * 4).collect()}
    assert {r.doc_id: r["shard"] for r in got} == want and {r["__shard"] for r in got} == {"clash"}
