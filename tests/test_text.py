"""Parsers for robots files, sitemaps and instructions; names; class labels; small tables."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomline.functions import scores, text
from loomline.operators import match, report, sampling, stats, validate


@pytest.fixture()
def one(spark):
    return lambda c: spark.range(1).select(c.alias("v")).first().v


def test_robots(one):
    got = one(text.robots(F.lit("# x\nUser-agent: bad\nDisallow: /\n\nUser-agent: *\nCrawl-delay: 2.5 # s\nDisallow: /private\nSitemap: https://a/s.xml\n")))
    assert (got.allows, got.delay, got.sitemaps) == (True, 2.5, ["https://a/s.xml"])
    got = one(text.robots(F.lit("User-agent: a\nUser-agent: *\nDisallow: /\n")))
    assert (got.allows, got.delay, got.sitemaps) == (False, None, [])
    assert one(text.robots(F.lit(None).cast("string"))).allows
    assert one(text.robots(F.lit("User-agent: *\nDisallow:\n"))).allows


def test_sitemaps(one):
    xml = "<urlset><url><loc> https://a.com/one-two-three/</loc><lastmod>2024-01-02T10:00</lastmod></url><url>\n<loc>https://a.com/tag/x-y-z</loc></url><url><loc>https://a.com/plain</loc></url></urlset>"
    assert [tuple(e) for e in one(text.sitemap_entries(F.lit(xml)))] == [("https://a.com/one-two-three/", "2024-01-02"), ("https://a.com/plain", None)]
    maps = lambda *x: one(text.article_sitemaps(F.array(*map(F.lit, x))))
    assert maps("/news-1.xml", "/tag-news.xml", "/other.xml") == ["/news-1.xml"] and maps("/a.xml", "/author.xml") == ["/a.xml"]


def test_names_and_sheets(one):
    assert one(text.slug(F.lit(" org/Model name-2 "))) == "org-Model-name-2"
    assert one(text.model_key(F.lit("m"), F.lit(None).cast("string"))) == "m:P"
    assert one(text.sheet_safe(F.lit("=1+1"))) == "'=1+1" and one(text.sheet_safe(F.lit("a\x00b"))) == "ab"
    rows = one(text.instruction_rows(F.lit("# Head\n\n- **an** item\n2. another\nplain `x`\n")))
    assert [tuple(r) for r in rows] == [("head", "Head"), ("item", "an item"), ("item", "another"), ("plain", "plain x")]


def test_class_labels():
    assert scores.canonical_labels(["Neg", "NEU", "bullish"]) == ["negative", "neutral", "positive"]
    assert scores.canonical_labels(["LABEL_0", "LABEL_1", "LABEL_2"], {0: "positive", "LABEL_1": "neutral", 2: "neg"}) == ["positive", "neutral", "negative"]
    for names in (["a", "b", "c"], ["neg", "neg", "pos"], ["neg", "pos"]):
        with pytest.raises(ValueError):
            scores.canonical_labels(names)


def test_checks(spark):
    declared = spark.createDataFrame([("a", 2), ("b", 3), ("c", 0)], "k string, n long")
    got = {r.k: (r.collected, r.complete) for r in validate.completeness(spark.createDataFrame([("a",), ("a",), ("b",)], "k string"), declared, ["k"]).collect()}
    assert got == {"a": (2, True), "b": (1, False), "c": (0, False)}
    a, b = (spark.createDataFrame(x, "k string, v double") for x in ([("a", 1.0), ("b", 2.0), ("c", 1.0)], [("a", 1.0 + 1e-12), ("b", 2.1)]))
    assert {r.k: r.agrees for r in validate.cross_check(a, b, ["k"], "v").collect()} == {"a": True, "b": False, "c": False}


def test_languages_samples_and_days(spark, one):
    said = lambda a, b: one(stats.relevant_language(F.lit(a), F.lit(b)))
    assert [said("m:P", "m:P_EN"), said("m:P", "m:P_RU"), said("m:P", "m:P_EN_RU"), said("m:P_EN", "m:P_EN_RU")] == ["en", "ru", "both", "ru"]
    news = spark.createDataFrame([(datetime(2024, 1, d),) for d in (1, 2, 27, 28)] + [(datetime(2024, 2, 5),)], "published timestamp")
    assert sorted(r.published.day for r in match.sample_rows(news, spark.createDataFrame([("2024-01",)], "month string")).collect()) == [2, 27]
    rows = spark.range(5000).selectExpr("id", "if(id < 4990, 'a', 'b') AS g")
    got = sampling.examples(rows, "g", "id", 4, 1).collect()
    assert sorted(r.g for r in got) == ["a"] * 4 + ["b"] * 4
    assert {r.id for r in sampling.examples(rows.orderBy(F.desc("id")), "g", "id", 4, 1).collect()} == {r.id for r in got}


def test_report_sheets(spark, tmp_path):
    runs = spark.createDataFrame([("m", "c1", 2.0), ("m", "c1", 3.0), ("n", "c2", 1.0)], "model string, commit string, seconds double")
    got = report.write_sheets({"runs": ("Runs", report.environment(runs)), "models": ("By model", report.seconds_by_model(runs))}, str(tmp_path))
    assert [(r.number, r.sheet, r.title) for r in got.collect()] == [(1, "runs", "Runs"), (2, "models", "By model")]
    assert {(r.commit, r.runs, r.seconds) for r in spark.read.csv(f"{tmp_path}/runs", header=True).collect()} == {("c1", "2", "5.0"), ("c2", "1", "1.0")}
    tried = spark.createDataFrame([("m", 1.0, 2.0), ("m", 3.0, 2.0)], "model string, mse double, zero double")
    assert tuple(report.tuning_ratios(tried, F.col("zero")).first()) == ("m", 0.5, 1.5)
