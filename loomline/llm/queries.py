"""The registered queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chat, contamination, embeddings, html_text, mixing, packing, quality, sharding, simhash, toxicity, warc, whitening
from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents")))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.assemble(chat.segments(rows.unionByName(probe))))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation beyond 64 bits is null here; the operator gives it in 38 digits."""
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = contamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_toxicity, op2_packing, op3_warc, op4_mixing, op5_simhash, op6_sharding, op7_html_text, op8_chat, op9_quality, op10_embeddings, op11_centroids, op12_whitening, op13_decontamination)
}

_FAR = "list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
_KEPT = """kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS j, x AS c FROM kept ORDER BY sha256('1:' || vec_id) LIMIT 16)"""


def _round(r: int) -> str:
    """Vectors to the centroids c{r}, as a{r}, and the next centroids."""
    nearest = f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(x) AS x, min(CAST({_FAR} AS BIGINT)) AS d, arg_min(j, (CAST({_FAR} AS BIGINT), j)) AS j FROM kept, c{r} GROUP BY vec_id)"
    parts = f"""p{r} AS (SELECT j, i, CAST(floor(CAST(sum(v) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM (SELECT j, unnest(x) AS v, unnest(range(64)) AS i FROM a{r}) GROUP BY j, i)"""
    after = f"c{r + 1} AS MATERIALIZED (SELECT c{r}.j, coalesce(q.c, c{r}.c) AS c FROM c{r} LEFT JOIN (SELECT j, list(m ORDER BY i) AS c FROM p{r} GROUP BY j) q ON q.j = c{r}.j)"
    return f"{nearest}, {parts}, {after}"


_WORD_SQL = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: DuckDB has no word tokenisers, lattices, 64-bit shard hashes or eigenvectors; such queries are tested against brute force instead.
ORACLE_SQL: dict[str, str] = {
    "op11_centroids": f"""WITH {_KEPT}, {_round(0)}, {_round(1)}, {_round(2)}, {_round(3)}
SELECT vec_id, CAST(a3.j AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a3.j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a3 JOIN c3 ON c3.j = a3.j""",
    "op13_decontamination": f"""WITH docs AS MATERIALIZED (SELECT doc_id, coalesce({_WORD_SQL}, []) AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORD_SQL} AS w FROM benchmark),
windows AS MATERIALIZED (SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(list_slice(w, k, k + least(len(w), 10) - 1), ' ') AS g
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM windows),
places AS (SELECT doc_id, m, k, array_to_string(list_slice(w, k, k + m - 1), ' ') AS g FROM (SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS k FROM docs, sizes WHERE len(w) >= m)),
found AS MATERIALIZED (SELECT doc_id, m, k, item FROM places JOIN windows USING (m, g)),
hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS k FROM (SELECT DISTINCT doc_id, m, k FROM found)) GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT doc_id, item FROM found WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN listed USING (doc_id)""",
}
