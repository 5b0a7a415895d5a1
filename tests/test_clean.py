"""Cleaning, matching and text functions."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.functions import scores, text, times
from loomline.operators import clean, grid, match, validate

T0 = datetime(2024, 3, 1)


def at(**k):
    return T0 + timedelta(**k)


def test_repeats_hang_on_the_last_kept_row(spark):
    hours = [1, 20, 24, 26, 49, 51]
    rows = spark.createDataFrame([(i, "t", at(hours=h)) for i, h in enumerate(hours)] + [(99, "other", at(hours=2))], "doc_id long, key string, published timestamp")
    got = clean.anchored_repeats(rows, "key", "published", "doc_id").orderBy("doc_id").collect()
    assert [hours[r.doc_id] for r in got if not r.repeat and r.key == "t"] == [1, 26, 51]
    assert [r.repeat for r in got if r.key == "other"] == [False]


def test_repeat_window_is_inclusive_and_ties_keep_one(spark):
    rows = [(1, "a", at(hours=0)), (2, "a", at(hours=24)), (3, "b", at(hours=0)), (4, "b", at(hours=24, seconds=1)), (5, "c", at(hours=0)), (6, "c", at(hours=0))]
    got = clean.anchored_repeats(spark.createDataFrame(rows, "doc_id long, key string, published timestamp"), "key", "published", "doc_id")
    assert {r.doc_id for r in got.collect() if r.repeat} == {2, 6}


def test_bursts(spark):
    rows, t = [], T0
    for n, gap in ((30, 15), (12, 0), (9, 20), (9, 30), (11, 30)):
        rows += [("s", t + timedelta(seconds=gap * k)) for k in range(n)]
        t += timedelta(hours=3)
    rows += [("s", T0 + timedelta(days=2, hours=k)) for k in range(20)] + [("other", T0 + timedelta(seconds=k)) for k in range(5)]
    news = spark.createDataFrame(rows, "source string, published timestamp")
    assert sorted(r.n for r in clean.burst_runs(news).collect()) == [11, 12, 30]
    edge = spark.createDataFrame([("s", at(seconds=60 * k)) for k in range(12)], "source string, published timestamp")
    assert clean.burst_runs(edge).count() == 0


def test_imprecise_clocks(spark):
    rows = [("a", at(hours=5 + k // 60, minutes=k % 60, seconds=7)) for k in range(200)] + [("a", at(days=k, hours=5)) for k in range(90)] + [("a", at(days=1))] + [("b", at(days=k, hours=6)) for k in range(10)]
    news = spark.createDataFrame(rows, "source string, published timestamp")
    got = clean.imprecise(news).groupBy("source").agg(F.count_if("imprecise").alias("n")).collect()
    assert {r.source: r.n for r in got} == {"a": 91, "b": 0}
    told = {r.source: r for r in clean.time_precision(news).collect()}
    assert told["a"].top_clock == "05:00:00" and told["b"].top_share == 1.0 and told["a"].records == 291


def test_stage_table(spark):
    long = at(hours=3, seconds=9)
    rows = [
        (1, "One!", "https://www.a.com/1", "a.com", long), (2, "Two", "https://www.a.com/1", "a.com", long + timedelta(hours=1)), (3, "one", "https://b.com/3", "b.com", long + timedelta(hours=2)),
        (4, None, "https://b.com/4", "b.com", long), (5, "Five", "https://b.com/5", "b.com", None), (6, "Six", "https://b.com/6", "b.com", T0), (7, " ", "https://b.com/7", "b.com", long),
    ]
    news = spark.createDataFrame(rows, "doc_id long, title string, url string, source string, published timestamp")
    marked = clean.cleaning_marks(news)
    assert {r.doc_id: r.removed_at for r in marked.collect()} == {1: None, 2: 4, 3: 5, 4: 2, 5: 1, 6: 3, 7: 2}
    assert [(r.left, r.removed) for r in clean.stage_table(marked).orderBy("stage").collect()] == [(7, 0), (6, 1), (4, 2), (3, 1), (2, 1), (1, 1)]


def test_sources(spark):
    news = spark.createDataFrame([("a", at(days=-500)), ("a", at(days=-1)), ("b", at(days=0)), ("b", at(days=-365))], "source string, published timestamp")
    span = {r.source: (r.n, r.recent, r.recent_share) for r in clean.sources_span(news).collect()}
    assert span == {"a": (2, 1, 0.3333), "b": (2, 2, 0.6667)}
    left, counts = clean.drop_sources(news, ["b", "absent"])
    assert left.count() == 2 and {r.source: r.n for r in counts.collect()} == {"b": 2, "absent": 0}


def test_coverage_end_sees_a_source_fade(spark):
    rows = [("steady", at(days=d, hours=h)) for d in range(120) for h in (1, 9)] + [("fading", at(days=d, hours=h)) for d in range(80) for h in (2, 8)] + [("fading", at(days=d)) for d in range(85, 120, 7)]
    got = {r.source: r for r in grid.coverage_end(spark.createDataFrame(rows, "source string, published timestamp")).collect()}
    assert abs((got["fading"].regular_until - at(days=81)).days) <= 2 and got["steady"].regular_until == at(days=120)


def test_match_finds_the_offset(spark):
    candles = [(at(minutes=15 * k), 100 + k + 0.123, 101 + k + 0.2, 99 + k + 0.1, 100.5 + k) for k in range(600)]
    candles += [(at(minutes=15 * 700), 5.0, 5.0, 5.0, 5.0), (at(minutes=15 * 701), 5.0, 5.0, 5.0, 5.0)]
    frame = spark.createDataFrame(candles, "open_time timestamp, open double, high double, low double, close double")
    news = [(k, f"s{k % 2}", c[0] + timedelta(hours=6, minutes=7), *c[1:]) for k, c in enumerate(candles[:300])] + [(999, "s0", at(days=7), 5.0, 5.0, 5.0, 5.0), (1000, "s0", at(days=1), None, 1.0, 1.0, 1.0)]
    found = match.match_candles(spark.createDataFrame(news, "record_id long, source string, published timestamp, open double, high double, low double, close double"), frame)
    assert found.count() == 300 and {r.minutes for r in found.collect()} == {367.0}
    best = match.best_offset(match.offset_scores(found))
    assert (best.first().offset, best.first().share) == (360, 1.0)
    parts = match.best_offset(match.offset_scores(found, ["source"]), ["source"])
    assert match.verdict(best, parts).first().verdict == "reliable"
    assert {r.rule: r.share for r in match.rule_shares(found, 360).collect()} == {"containing": 1.0, "next": 0.0, "nearest": 1.0}


def test_match_of_a_price_that_returns_for_years(spark):
    """One price over all candles: the rows of the plain join, and candidates in proportion to the records."""
    flat = [(at(hours=h), 7.0, 7.0, 7.0, 7.0) for h in range(2000)]
    lone = [(at(days=200 + 30 * k), 7.0, 7.0, 7.0, 7.0) for k in range(5)]
    frame = spark.createDataFrame(flat + lone, "open_time timestamp, open double, high double, low double, close double")
    times = [*(at(hours=7 * k, minutes=11) for k in range(250)), *(at(days=200 + 30 * k, hours=h) for k in range(5) for h in (-19, -18, 0, 18, 19)), at(days=900), None]
    news = [(k, t, 7.0, 7.0, 7.0, 7.0) for k, t in enumerate(times)]
    records = spark.createDataFrame(news, "record_id long, published timestamp, open double, high double, low double, close double")
    near = lambda t: [c[0] for c in flat + lone if t is not None and abs((t - c[0]).total_seconds()) <= 18 * 3600]
    want = {(k, near(t)[0], (t - near(t)[0]).total_seconds() / 60) for k, t in enumerate(times) if len(near(t)) == 1}
    got = match.match_candles(records, frame)
    assert {(r.record_id, r.open_time, r.minutes) for r in got.collect()} == want and len(want) >= 15
    assert "__bin" in got._jdf.queryExecution().optimizedPlan().toString()


def test_offset_scores_count_edges_as_the_definition(spark):
    """Whole and broken minutes at and beside every edge, null minutes and keys, no rows."""
    values = [s / 60 for o in match.OFFSETS[::7] for e in (-15, 15, 0) for s in ((o + e) * 60 - 1, (o + e) * 60, (o + e) * 60 + 1)] + [None]
    rows = [(k, v) for k in ("a", None) for v in values] + [("b", 15.0)] * 3
    table = spark.createDataFrame(rows, "source string, minutes double")
    for keys in (["source"], None):
        got = {(r.source if keys else 0, r.offset): (r.matches, r.share) for r in match.offset_scores(table, keys).collect()}
        for k in ("a", "b", None) if keys else (0,):
            mine = [v for s, v in rows if not keys or s == k]
            known = [v for v in mine if v is not None]
            for o in match.OFFSETS:
                assert got[k, o] == (len(mine), pytest.approx(sum(abs(v - o) < 15 for v in known) / len(known)))
    assert match.offset_scores(table.limit(0), ["source"]).count() == 0 and match.offset_scores(table.limit(0)).count() == 0


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(text.unescape_title(F.lit("S&amp;P  500 &#8217;x "))) == "S&P 500 ’x"
    assert one(text.normalize_title(F.lit("Ｂitcoin—is UP_2 \t!!"))) == "bitcoin is up_2"
    assert one(text.normalize_title(F.lit("Биткоин, снова!"))) == "биткоин снова"
    assert [one(text.source_of(F.lit(u))) for u in ("https://WWW.a.com/x", "http://b.org:8080/?q", "nothing", None)] == ["a.com", "b.org:8080", "", ""]
    assert one(text.first_time(F.lit('<time datetime="2024-01-02">'))) == "2024-01-02" and one(text.first_time(F.lit("none"))) is None
    assert one(text.sitemap_locations(F.lit("<loc> a </loc><loc>b</loc>"))) == ["a", "b"]
    assert one(text.rss_items(F.lit("<item><title><![CDATA[T]]></title><link>l</link><pubDate>d</pubDate></item>")))[0].asDict() == {"title": "T", "link": "l", "published": "d"}
    assert one(text.is_article_url(F.lit("https://a.com/one-two-three"))) and not one(text.is_article_url(F.lit("https://a.com/tag/one-two-three")))
    two = '<meta itemprop="datePublished" content="b"><script>"datePublished": "c"</script><time class=x datetime="a">'
    assert one(text.first_time(F.lit(two))) == "a" and one(text.first_time(F.lit(two[:60]))) == "b" and one(text.first_time(F.lit(two[:-30]))) == "c"
    assert one(text.first_time(F.lit("<pubDate>x</pubDate>"))) is None and one(text.feed_time(F.lit("<pubDate> Mon, 01 Jan 2024 10:00 GMT</pubDate>"))) == "Mon, 01 Jan 2024 10:00 GMT"
    assert one(text.has_minutes(F.lit("2024-01-01T10:00Z"))) and not one(text.has_zone(F.lit("2024/01/01 10:00")))
    assert one(text.decimal_comma(F.lit(1234.5), 2)) == "1 234,50"
    assert one(text.parse_label(F.lit(" Neg "), {"neg": "negative"})) == "negative"
    with pytest.raises(Exception, match="unknown label"):
        one(text.parse_label(F.lit("what"), {"neg": "negative"}))


def test_tags_follow_unicode_words(spark):
    titles = ["Bitcoin up", "BITCOIN cash", "биткоину", "wbtc", "БИТКОИН", None, "btc.", "Tether", "эфира", "в прямом эфире", "Ethereum Classic", "ETH/USD"]
    got = text.tag(spark.createDataFrame(list(enumerate(titles)), "i int, t string"), "t", text.COINS).orderBy("i").collect()
    assert [i for i, r in enumerate(got) if r.mentions_btc] == [0, 2, 4, 6]
    assert [i for i, r in enumerate(got) if r.mentions_eth] == [8, 11]


def test_time_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    t = F.lit(datetime(2024, 3, 31, 10, 59, 59))
    assert one(times.hour_of(t)) == datetime(2024, 3, 31, 10) and one(times.month_start(t)) == datetime(2024, 3, 1)
    assert one(times.ceil_day(t)) == datetime(2024, 4, 1) and one(times.ceil_day(F.lit(T0))) == T0
    assert one(times.parse_time(F.lit("2024-01-01T05:00:00+03:00"))) == datetime(2024, 1, 1, 2) and one(times.parse_time(F.lit("01.02.2024 10:30"))) == datetime(2024, 2, 1, 10, 30) and one(times.parse_time(F.lit("x"))) is None
    assert one(times.to_utc(F.lit(T0), 360)) == T0 - timedelta(hours=6)
    assert [one(times.offset_label(F.lit(m))) for m in (360, -330, 0)] == ["UTC+06:00", "UTC-05:30", "UTC+00:00"]
    assert one(times.month_range("2023-11-05", "2024-01-01")) == ["2023-11", "2023-12", "2024-01"]
    months = spark.createDataFrame([(datetime(2018 + k // 12, 1 + k % 12, 3),) for k in range(40)], "published timestamp")
    assert match.sample_months(months, "2018-01", 4).orderBy("month").collect()[-1].month == "2021-04"


def test_scores(spark):
    row = spark.range(1).select(scores.softmax(F.array(F.lit(1000.0), F.lit(1000.0), F.lit(0.0))).alias("p")).select("p", scores.label_of(F.col("p")).alias("l"), scores.score_of(F.col("p")).alias("s")).first()
    assert row.l == "negative" and row.p[0] == pytest.approx(0.5) and row.s == pytest.approx(-0.5)
    with pytest.raises(ValueError):
        scores.reorder(F.array(), ["a", "b", "c"])


def test_one_to_one(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "k string") for xs in (["x", "y", "y", "z"], ["x", "y"]))
    assert {r.check: r.violations for r in validate.one_to_one(a, b, "k").collect()} == {"repeated_left": 1, "repeated_right": 0, "unmatched": 1}
    assert [r.k for r in validate.unknown_labels(a, "k", ["x", "y"]).collect()] == ["z"]
    assert validate.share_complete(99, 100, 0.99) and not validate.share_complete(0, 0, 0.99)


def test_of_equal_rows_one_is_left(spark):
    """Rows equal in everything, and rows without a tie, against a walk through them in order."""
    rng = np.random.default_rng(12)
    start = datetime(2024, 1, 1, 5, 0, 1)
    rows = [(int(rng.integers(0, 3)) or None, f"Title {rng.integers(0, 4)}", f"u{rng.integers(0, 25)}", start + timedelta(hours=int(rng.integers(0, 80)))) for _ in range(60)]
    rows += rows[:25] + rows[:10]
    news = spark.createDataFrame(rows, "doc_id long, title string, url string, published timestamp").withColumn("source", F.lit("s")).repartition(5)
    first, left = {}, []
    order = sorted(rows, key=lambda r: (r[3], r[0] is not None, r[0] or 0))
    for r in order:
        if r[2] not in first:
            first[r[2]] = r
            left.append(r)
    kept, anchor = [], {}
    for r in left:
        if r[1] not in anchor or r[3] - anchor[r[1]] > timedelta(hours=24):
            anchor[r[1]] = r[3]
            kept.append(r)
    got = clean.cleaning_marks(news, least=10_000)
    assert got.count() == len(rows) and set(news.columns) | {"removed_at"} == set(got.columns)
    living = got.filter("removed_at is null").collect()
    assert sorted((r.url, r.published) for r in living) == sorted((r[2], r[3]) for r in kept)
    twice = spark.createDataFrame([(1, "t", start)] * 3 + [(1, "t", None)] * 2, "doc_id long, title string, published timestamp")
    marks = [r.repeat for r in clean.anchored_repeats(twice, "title", "published", "doc_id").orderBy(F.col("published").asc_nulls_first(), "repeat").collect()]
    assert marks == [False, False, False, True, True]


def test_stable_characters_are_their_own_nfkc_form():
    """None changes, is reordered, or composes with a character before it."""
    import re
    import unicodedata

    pairs = [d.split() for c in range(0x110000) if (d := unicodedata.decomposition(chr(c))) and d[0] != "<"]
    second = {chr(int(p[1], 16)) for p in pairs if len(p) == 2} | {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    stable = [chr(c) for c in range(0x110000) if re.match(f"[{text.STABLE}]", chr(c))]
    assert len(stable) > 30_000 and all(unicodedata.is_normalized("NFKC", c) and not unicodedata.combining(c) and c not in second for c in stable)


def test_python_steps_see_only_texts_that_need_them(spark, monkeypatch):
    """Spark runs a Python function on all rows, whatever `when` stands around it; the others must reach it as nulls."""
    from pyspark.sql.types import StringType

    reached = spark.sparkContext.accumulator(0)

    def counted(t):
        reached.add(len(t) - t.null_count)
        return t

    count = F.arrow_udf(counted, StringType(), F.ArrowUDFType.SCALAR)
    rows = spark.createDataFrame([("plain",), ("Ñandú über Ж",), ("ﬁne",), ("a\u0301",), ("x 😀",), (None,), ("a &amp; b",)], "t string")
    for name, change, n in (("_nfkc", text.normalize_title, 3), ("_unescape", text.unescape_title, 1)):
        before = reached.value
        monkeypatch.setattr(text, name, count)
        rows.select(change(F.col("t"))).collect()
        assert reached.value - before == n


def test_python_steps_over_many_slices(spark):
    values = [None, "ﬁ", "plain", "e\u0301 &lt;", "Ｂ &amp; b"] * 60
    got = [tuple(r) for r in spark.createDataFrame([(v,) for v in values], "t string").coalesce(1).select(text.normalize_title(F.col("t")), text.unescape_title(F.col("t"))).collect()]
    assert got == [(None, None), ("fi", "ﬁ"), ("plain", "plain"), ("é lt", "e\u0301 <"), ("b amp b", "Ｂ & b")] * 60


def test_cleaning_sends_only_odd_titles_to_python(spark, monkeypatch):
    from pyspark.sql.types import StringType

    reached = spark.sparkContext.accumulator(0)

    def counted(t):
        reached.add(len(t) - t.null_count)
        return t

    monkeypatch.setattr(text, "_nfkc", F.arrow_udf(counted, StringType(), F.ArrowUDFType.SCALAR))
    rows = [(i, f"title {i} über" if i % 10 else f"ﬁne {i}", "s", T0 + timedelta(hours=i, seconds=1), f"u{i}") for i in range(1, 41)]
    news = spark.createDataFrame(rows, "doc_id long, title string, source string, published timestamp, url string")
    assert clean.cleaning_marks(news).filter("removed_at is null").count() == 40 and 0 < reached.value <= 4


def test_only_odd_stretches_of_titles_reach_python(spark, monkeypatch):
    """A no-break space in a long title must not carry the title to Python."""
    from pyspark.sql.types import StringType

    reached = spark.sparkContext.accumulator(0)

    def counted(t):
        reached.add(sum(len(x) for x in t.to_pylist() if x is not None))
        return t

    monkeypatch.setattr(text, "_nfkc", F.arrow_udf(counted, StringType(), F.ArrowUDFType.SCALAR))
    rows = [(i, f"title {i} " + "word " * 400 + "10\u00a0000", "s", T0 + timedelta(hours=i, seconds=1), f"u{i}") for i in range(1, 41)]
    news = spark.createDataFrame(rows, "doc_id long, title string, source string, published timestamp, url string")
    assert clean.cleaning_marks(news).filter("removed_at is null").count() == 40 and 0 < reached.value <= 40 * 4


def test_nfkc_by_stretches_is_that_of_the_whole_text(spark):
    """Characters of all kinds in any order, NULs, marks at the start, and long runs of changing width."""
    import re
    import unicodedata

    rng = np.random.default_rng(5)
    assigned = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    changed = [c for c in assigned if not unicodedata.is_normalized("NFKC", c)]
    marks = [c for c in assigned if unicodedata.combining(c)]
    jamo = [chr(c) for c in range(0x1100, 0x1200)]
    stable = [c for c in assigned if re.match(f"[{text.STABLE}]", c)]
    pools = [changed, marks, jamo, stable, [chr(c) for c in range(32, 127)], ["\0", " ", "\n", "가", "か", "e", "ö", "\u00a0"]]
    values = ["".join(pools[k][rng.integers(len(pools[k]))] for k in rng.integers(0, len(pools), rng.integers(0, 30))) for _ in range(2000)]
    values += ["".join(f"{c}{x}" for x in ("", "\u0301", "\0")) for c in changed[::7]] + ["😀\ufe0f" * 100_000, "a\u0301" * 100_000, "\u0301" * 50_000, "ﬁ" * 100_000, "", None]
    got = spark.createDataFrame(list(enumerate(values)), "i int, t string").select("i", text.nfkc(F.col("t")).alias("n")).collect()
    assert {r.i: r.n for r in got} == {i: None if v is None else unicodedata.normalize("NFKC", v) for i, v in enumerate(values)}
