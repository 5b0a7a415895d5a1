"""Kept times of segments against the fold over a key's every time."""

import numpy as np
from pyspark.sql import functions as F

from loomline.operators import anchors


def fold(times: list[int], span: int) -> list[int]:
    kept: list[int] = []
    for t in sorted(times):
        if not kept or t - kept[-1] > span:
            kept.append(t)
    return kept


def test_segment_ends_are_those_of_the_fold():
    rng = np.random.default_rng(1)
    for span, width, n in ((10, 320, 5), (10, 320, 200), (1, 32, 20), (0, 32, 30), (100, 3200, 1500)):
        start = -width
        times = sorted(set(int(t) for t in rng.integers(start, start + width, n)))
        entries = sorted(anchors.segment_ends(iter(times[::-1]), start, span))
        assert all(a[1] != b[1] for a, b in zip(entries, entries[1:]))
        for before in range(start - span - 3, start):
            left = [t for t in times if t > before + span]
            met = next((end for entry, end in entries if entry > before + span), None)
            assert met == (fold(left, span)[-1] if left else None)


def test_kept_times_equal_the_fold(spark):
    """A hot key over years, sparse keys, keys in step with the span and its edges, times before 1970, other columns."""
    rng = np.random.default_rng(2)
    span = 1000
    keys = {
        "hot": rng.integers(-200_000, 2_000_000, 6000),
        "even": np.arange(0, 400_000, 500),
        "edge": np.concatenate([np.arange(0, 300_000, 1000), np.arange(500_000, 900_000, 1001)]),
        "gaps": rng.integers(0, 10**12, 60),
        "one": [5],
        "borders": [k * 32_000 + d for k in range(-3, 9) for d in (-1, 0, 1)],
    }
    keys |= {f"few{i}": rng.integers(0, 100_000, 3) for i in range(40)}
    rows = [(k, int(t), f"{k}{t}") for k, ts in keys.items() for t in set(map(int, ts))]
    table = spark.createDataFrame(rows, "k string, t long, extra string").repartition(5)
    for s in (span, 0, 1):
        got: dict[str, list[int]] = {}
        for r in anchors.kept_times(table, "k", "t", s).collect():
            assert r.extra == f"{r.k}{r.t}"
            got.setdefault(r.k, []).append(r.t)
        assert {k: sorted(v) for k, v in got.items()} == {k: fold(list(set(map(int, ts))), s) for k, ts in keys.items()}
    assert anchors.kept_times(table.limit(0), "k", "t", span).count() == 0


def test_a_hot_key_is_spread(spark):
    """Every time of one key: no partition of the walk has most of them, and few entries pass through the key's one task."""
    table = spark.range(20_000).select(F.lit("hot").alias("k"), (F.col("id") * 100).alias("t"))
    got = anchors.kept_times(table, "k", "t", 1000)
    assert got.count() == len(fold(range(0, 2_000_000, 100), 1000))
    segments = table.groupBy(F.floor(F.col("t") / (anchors.SPANS * 1000)).alias("s")).count()
    assert segments.count() == 63 and segments.agg(F.max("count")).first()[0] <= 320
    ends = [len(list(anchors.segment_ends(iter(range(s + 31_900, s - 1, -100)), s, 1000))) for s in range(0, 2_000_000, 32_000)]
    assert sum(ends) <= 20_000 / 25
