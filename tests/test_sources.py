"""File sources, settings and streams."""

import hashlib
import io
import json
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomline import config
from loomline.operators import features
from loomline.sources import files, paged
from loomline.streaming import hourly

T0 = datetime(2024, 1, 1)


def test_candle_files(spark, tmp_path):
    line = lambda t: f"{t},1,2,0.5,1.5,10,{t + 1},5,3,1,1,0"
    ms = int(T0.timestamp() * 1000)
    (tmp_path / "a.csv").write_text("\n".join([",".join(files.RAW), line(ms), line(ms + 3_600_000)]))
    (tmp_path / "b.csv").write_text("\n".join([line((ms + 4 * 3_600_000) * 1000), line((ms + 4 * 3_600_000) * 1000)]))
    rows = files.read_candle_files(spark, f"{tmp_path}/*.csv", "a")
    assert sorted(r.open_time for r in rows.collect()) == [T0, T0 + timedelta(hours=1)] + [T0 + timedelta(hours=4)] * 2
    got = files.complete_candles(rows.withColumn("trades", F.col("trades")))
    assert got["grid"].count() == 5 and got["gaps"].first().hours == 2 and got["repeats"].first().asDict() == {"symbol": "a", "raw": 4, "distinct": 3}


def test_checksums(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    (tmp_path / "y.bin").write_bytes(b"abd")
    digest = hashlib.sha256(b"abc").hexdigest()
    (tmp_path / "list.txt").write_text(f"{digest}  x.bin\n{digest}  y.bin\n")
    got = {r.name: r.ok for r in files.verify_checksums(spark, f"{tmp_path}/*.bin", f"{tmp_path}/list.txt").collect()}
    assert got == {"x.bin": True, "y.bin": False}


def test_headline_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('URL,Title,Date Time,Coin Type,Open\nu1,"A, b",2024-01-01 10:00,btc,1.5\nu2,B,x,eth,bad\n')
    (tmp_path / "b.csv").write_text("link,headline,published_at,Currency\nu3,C,2024-01-02,btc\n")
    (tmp_path / "c.csv").write_text("what,ever\n1,2\n")
    got, skipped = files.read_headlines(spark, [f"{tmp_path}/{x}.csv" for x in "abc"])
    rows = {r.url: r for r in got.collect()}
    assert skipped == [f"{tmp_path}/c.csv"] and rows["u1"].title == "A, b" and rows["u1"].open == 1.5 and rows["u2"].open is None and rows["u3"].coin_type == "btc" and rows["u3"].date_time == "2024-01-02"


def test_collected_lines(spark, tmp_path):
    lines = [{"page": 1, "url": "u", "published_utc": "2024-01-01T00:00:00Z", "title": "old"}, "{broken", {"page": 2, "url": "u", "published_utc": "2024-01-02T00:00:00Z", "title": "new"}, {"page": 2, "url": "v", "published_utc": "bad", "title": "t"}]
    (tmp_path / "x.jsonl").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    got = files.load_collected(spark, f"{tmp_path}/x.jsonl")
    assert {r.url: r.title for r in got.collect()} == {"u": "new", "v": "t"}
    assert sorted(r.page for r in files.done_pages(got).collect()) == [2]
    assert [r.url for r in files.finalise(got).collect()] == ["u"]
    page = json.dumps([{"id": 1, "link": "l", "date_gmt": "2024-01-01T10:00:00", "title": {"rendered": "T"}, "categories": [1, 2], "tags": []}, {"id": 2, "date_gmt": "2024-01-01T10:00:00"}])
    rows = files.parse_pages(spark.createDataFrame([(page,)], "body string")).collect()
    assert [(r.id, r.url, r.title, r.categories) for r in rows] == [(1, "l", "T", [1, 2])]


def test_sinks(spark, tmp_path):
    news = spark.createDataFrame([("u", "text", 1), ("v", "text", 2)], "url string, title string, n int")
    files.write_table(news, f"{tmp_path}/t", ["n"])
    assert spark.read.parquet(f"{tmp_path}/t").filter("n = 1").count() == 1
    files.write_report(news, f"{tmp_path}/r")
    assert spark.read.csv(f"{tmp_path}/r", header=True).count() == 2
    listed = files.release(news, news.select("url", "n"), news.filter("n = 1"), f"{tmp_path}/out")
    assert listed.count() >= 2 and "title" not in spark.read.parquet(f"{tmp_path}/out/news").columns and spark.read.parquet(f"{tmp_path}/out/scores").count() == 1


def test_settings(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("seed: 7\nfeatures: {vol_windows: [3]}\n")
    got = config.load(str(path), {"LOOMLINE_DATA": "/d"})
    assert (got.seed, got.features.vol_windows, got.data_path) == (7, (3,), "/d") and got.digest() != config.Config().digest()
    path.write_text("features: {what: 1}\n")
    with pytest.raises(ValueError, match="features.what"):
        config.load(str(path), {})
    assert {"commit", "config", "packages"} <= set(config.manifest(got))


def test_stream_equals_batch(spark, tmp_path):
    rows = [(T0 + timedelta(minutes=17 * k), (k % 5 - 2) / 2.0, "negative" if k % 5 < 2 else "positive", f"u{k % 40}") for k in range(60)] + [(T0 + timedelta(days=3), 0.0, "positive", "end")]
    schema = "published timestamp, score double, label string, url string"
    news = spark.createDataFrame(rows, schema)
    news.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    query = hourly.hourly_news(stream).writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r.hour: (r.n, r.sent_mean, r.neg_share) for r in spark.table("hours").collect()}
    assert got == {r.hour: (r.n, r.sent_mean, r.neg_share) for r in features.hourly_news(news).collect()}


def test_stream_of_repeats(spark, tmp_path):
    rows = [("t", T0 + timedelta(hours=h)) for h in (1, 20, 24, 26, 49, 51)]
    schema = "key string, published timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    query = hourly.anchored_repeats(stream, "key").writeStream.format("memory").queryName("repeats").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(180)
    kept = sorted((r.published - T0).total_seconds() / 3600 for r in spark.table("repeats").collect() if not r.repeat)
    assert kept == [1, 26, 51]


def test_paged_records(spark, tmp_path):
    item = lambda i: {"id": i, "link": f"l{i}", "date_gmt": "2024-01-01T00:00:00", "title": {"rendered": f"T{i}"}, "categories": [i], "tags": []}
    for page in (1, 2, 3):
        (tmp_path / f"p{page}.json").write_text(json.dumps([item(10 * page + k) for k in range(4)] + [{"id": 5}]))
    spark.dataSource.register(paged.PagedRecords)
    load = lambda **o: spark.read.format("paged_records").options(url=f"file://{tmp_path}/p{{page}}.json", pages=5, pause=0, **o).load()
    assert load().count() == 12 and {r.page for r in load(done="1,3").collect()} == {2}
    assert load().filter("id = 21").first().title == "T21"
    reader = paged.PageStream({"url": f"file://{tmp_path}/p{{page}}.json", "pause": "0"})
    rows, end = reader.read(reader.initialOffset())
    assert len(list(rows)) == 4 and end == {"page": 2} and reader.read({"page": 4})[1] == {"page": 4}
    assert len(list(reader.readBetweenOffsets({"page": 1}, {"page": 4}))) == 12


def test_outputs_are_moved_aside(spark, tmp_path):
    frame = spark.range(3)
    for _ in range(3):
        files.write_table(frame, f"{tmp_path}/t")
    assert len([x for x in tmp_path.iterdir() if x.name.startswith("t.")]) == 2 and spark.read.parquet(f"{tmp_path}/t").count() == 3


def test_tables_are_found_unpacked_and_fetched(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep/b.csv", "x\n2\n")
    outer = io.BytesIO()
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("folder/a.csv", "x\n1\n")
        z.writestr("__MACOSX/._a.csv", "no")
        z.writestr("readme.txt", "no")
        z.writestr("inner.zip", inner.getvalue())
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "set.zip").write_bytes(outer.getvalue())
    (tmp_path / "one" / "._c.csv").write_text("no")
    names = lambda got: [x.rpartition("/")[2] for x in got[0]]
    got = files.obtain(spark, f"{tmp_path}/one")
    assert names(got) == ["a.csv", "b.csv"] and got[1] == "from an archive in the folder"
    assert files.obtain(spark, f"{tmp_path}/one")[1] == "in the folder"
    (tmp_path / "two").mkdir()
    with pytest.raises(FileNotFoundError, match="by hand"):
        files.obtain(spark, f"{tmp_path}/two", lambda: None)
    assert files.obtain(spark, f"{tmp_path}/two", outer.getvalue)[1] == "fetched"


def test_month_files(spark, tmp_path):
    (tmp_path / "btc").mkdir()
    (tmp_path / "btc" / "btc-2024-01.csv").write_text("1")
    fetch = lambda month: {"2024-02": (b"2", True), "2024-03": (b"3", False)}.get(month)
    got = files.month_files(spark, str(tmp_path), "btc", ["2024-01", "2024-02", "2024-03", "2024-04"], fetch).collect()
    assert [r.status for r in got] == ["cache", "downloaded", "downloaded_unverified", "missing"]
    assert {r.status for r in files.month_files(spark, str(tmp_path), "btc", ["2024-02", "2024-03"]).collect()} == {"cache"}


def test_by_length_bounds_the_bytes_of_a_part(spark, monkeypatch):
    """One length with most rows, few very long texts, nulls and wide characters; no part is large, all is in order."""
    from collections import Counter

    monkeypatch.setattr(files, "PART_BYTES", 4000)
    values = ["a" * (k % 50) for k in range(600)] + ["hot text"] * 1500 + ["é" * 3000, "b" * 3000, "c" * 2999] + [None] * 300
    texts = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "t string, i long").repartition(3)
    got = files.by_length(texts, "t", 4)
    assert got.columns == ["t", "i"]
    parts = [[(r.t, r.i) for r in p] for p in got.rdd.glom().collect()]
    assert Counter(x for p in parts for x in p) == Counter(zip(values, range(len(values))))
    size = lambda t: -1 if t is None else len(t)
    lengths = [size(t) for p in parts for t, _ in p]
    assert lengths == sorted(lengths)
    weight = [sum(len((t or "").encode()) + 16 for t, _ in p) for p in parts]
    assert max(weight) <= 2 * 4000 + 6016 and sum(any(t == "hot text" for t, _ in p) for p in parts) >= 8
    assert files.by_length(texts.limit(0), "t", 4).count() == 0
    assert 2 <= sum(map(bool, files.by_length(texts.filter("i < 50"), "t", 4).rdd.glom().map(len).collect())) <= 4
