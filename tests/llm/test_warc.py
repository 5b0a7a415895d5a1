import base64
import hashlib
import io
import zlib

import pytest

from loomline.llm import warc


def blocks(data):
    return warc.Blocks(io.BytesIO(data), len(data))


def member(data):
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


RECORDS = [warc.record(i, f"http://x/{i}", f"<p>page {i} {'z' * (i * 400)}</p>".encode()) for i in range(6)]


@pytest.mark.parametrize("packed", [True, False])
def test_damage_costs_one_record_and_is_logged(packed):
    parts = [member(r) if packed else r for r in RECORDS]
    starts = [sum(map(len, parts[:i])) for i in range(7)]
    for hurt in range(6):
        data = bytearray(b"".join(parts))
        spot = starts[hurt] + len(parts[hurt]) // 2
        data[spot] ^= 0xFF
        got = list(warc.salvage(blocks(bytes(data))))
        assert [(k, a, b) for k, a, b, *_ in got if k == "gap"] == [("gap", starts[hurt], starts[hurt + 1])]
        assert [warc.page_of(f["warc-record-id"]) for k, _, _, f, _ in got if k == "record"] == [i for i in range(6) if i != hurt]


@pytest.mark.parametrize("packed", [True, False])
def test_truncated_and_foreign_bytes(packed):
    parts = [member(r) if packed else r for r in RECORDS]
    data = b"junk" * 700_000 + parts[0] + b"WARC/1.1\r\nContent-Length: 99999999\r\n\r\n" + parts[1] + parts[2][: len(parts[2]) // 2]
    got = list(warc.salvage(blocks(data)))
    assert [k for k, *_ in got] == ["gap", "record", "gap", "record", "gap"]
    assert got[0][1] == 0 and got[-1][2] == len(data)
    assert all(x[2] == y[1] for x, y in zip(got, got[1:]))


def test_several_records_in_one_member_and_version_1_0():
    old = RECORDS[1].replace(b"WARC/1.1", b"WARC/1.0")
    got = [f for k, _, _, f, _ in warc.salvage(blocks(member(RECORDS[0] + old) + RECORDS[2])) if k == "record"]
    assert [warc.page_of(f["warc-record-id"]) for f in got] == [0, 1, 2]


def test_clean_files_have_no_gaps_and_empty_ones_nothing():
    assert list(warc.salvage(blocks(b""))) == []
    assert all(k == "record" for k, *_ in warc.salvage(blocks(b"".join(map(member, RECORDS)))))


def ids(got):
    return [warc.page_of(x[3]["warc-record-id"]) for x in got if x[0] == "record"]


def test_one_member_with_a_bad_record_keeps_the_others():
    whole = b"".join(RECORDS)
    starts = [sum(map(len, RECORDS[:i])) for i in range(7)]
    for hurt in range(6):
        data = bytearray(whole)
        data[starts[hurt + 1] - 8] ^= 0xFF  # in the payload; the member is packed anew, so its own sum is right
        got = list(warc.salvage(blocks(member(bytes(data)))))
        assert ids(got) == [i for i in range(6) if i != hurt]
        assert [x[4] for x in got if x[0] == "gap"] == [(starts[hurt], starts[hurt + 1])]


def test_one_member_that_breaks_off_keeps_what_came_before_and_after():
    import random

    noise = random.Random(3)
    records = [warc.record(i, f"http://x/{i}", noise.randbytes(60_000)) for i in range(8)]
    packed = member(b"".join(records))
    for cut in (len(packed) // 2, len(packed) - 3):
        got = list(warc.salvage(blocks(packed[:cut] + member(records[7]) + records[6])))
        found = ids(got)
        assert found[-2:] == [7, 6] and found[:-2] == list(range(len(found) - 2)) and len(found) - 2 >= (cut // 60_100) - 1
        assert sum(x[0] == "gap" for x in got) == 1
    hurt = bytearray(packed)
    hurt[len(packed) // 2] ^= 0xFF
    assert set(ids(warc.salvage(blocks(bytes(hurt))))) >= {0, 1, 2}


def test_large_members_and_payloads_are_streamed():
    """A member of many records and a payload far beyond what is held at once."""
    import tracemalloc

    data = member(b"".join([*RECORDS, warc.record(9, "u", b"z" * (80 << 20)), *RECORDS]))
    tracemalloc.start()
    got = list(warc.salvage(blocks(data)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ids(got) == [0, 1, 2, 3, 4, 5, 9, 0, 1, 2, 3, 4, 5] and most < 20 << 20


def test_header_lines_may_be_long_but_junk_is_not_gathered():
    long = warc.record(1, "http://x/" + "a" * (5 << 20), b"p")
    assert ids(warc.salvage(blocks(member(long) + long))) == [1, 1]
    junk = b"WARC/1.1\r\n" + b"\x00" * 3_000_000
    got = list(warc.salvage(blocks(junk + RECORDS[2])))
    assert [x[:3] for x in got] == [("gap", 0, len(junk)), ("record", len(junk), len(junk) + len(RECORDS[2]))]
    folded = RECORDS[1].replace(b"WARC-Date: ", b"WARC-Date:\r\n  ")
    assert ids(warc.salvage(blocks(folded))) == [1]


def test_page_ids():
    for i in (0, 1, -1, 2**63 - 1, -(2**63)):
        assert warc.page_of(warc.record_urn(i)) == i
    assert warc.page_of(warc.record_urn(None, b"x")) is None and warc.page_of("nonsense") is None


def test_round_trip(spark):
    rows = [(1, "u1", "same"), (2, None, "same"), (3, "u\n3", "same"), (4, "u", None), (5, "u", ""), (6, "u", "ä" * 100_000), (7, "u", "own"), (7, "u", "own"), (None, "u", "lone"), (None, "u", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' AS refers_to", "1 AS path").repartition(3)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()), key=str)
    most = {}
    for i, _, html in rows:
        if i is not None:
            most[html or ""] = max(i, most.get(html or "", i))
    want = []
    for i, _, html in rows:
        data, keeper = (html or "").encode(), most.get(html or "")
        revisit = keeper is not None and i != keeper
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", keeper if revisit else None))
    assert got == sorted(want, key=str)


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_payloads_come_back(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x" * 10), (2, "u", "y")], "page_id long, url string, html string")
    manifest = warc.write_archives(pages, str(tmp_path))
    got = warc.read_archives(manifest, str(tmp_path), with_payload=True).collect()
    assert {r.page_id: bytes(r.payload) for r in got} == {1: b"x" * 10, 2: b"y"}


def test_large_pages_come_back(spark):
    """A payload of 300 MB and an address of 5 MB, each a row."""
    pages = spark.range(2).selectExpr("id AS page_id", "repeat('u', int(1 + id * 4999999)) AS url", "repeat('large page ', int(1 + (1 - id) * 27299999)) AS html")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert got[0].payload_bytes == 300_300_000 and got[1].payload_bytes == 11
    assert got[0].payload_digest == base64.b32encode(hashlib.sha1(b"large page " * 27_300_000).digest()).decode()


def test_archives_are_read_by_several_tasks(spark, tmp_path):
    pages = spark.range(400).selectExpr("id AS page_id", "'u' AS url", "repeat(uuid(), 40) AS html").repartition(4)
    manifest = warc.write_archives(pages, str(tmp_path), archive_bytes=20_000)
    items = warc.read_archives(manifest, str(tmp_path))
    tasks = items.selectExpr("spark_partition_id() AS t").distinct().count()
    assert manifest.count() >= 8 and tasks >= manifest.count() // 2 and items.count() == 400


def test_lost_records_are_an_error(spark, tmp_path):
    pages = spark.range(6).selectExpr("id AS page_id", "'u' AS url", "concat('page ', id) AS html").coalesce(1)
    manifest = warc.write_archives(pages, str(tmp_path))
    path = manifest.first().path
    data = bytearray(open(path, "rb").read())
    data[len(data) // 2] ^= 0xFF
    open(path, "wb").write(data)
    lost = warc.unread(manifest, warc.read_archives(manifest, str(tmp_path))).collect()
    assert [(r.records, r.read, r.gaps) for r in lost] == [(6, 5, 1)]
