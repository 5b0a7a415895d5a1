"""Anchored times as a segmented scan: the kept times of a key, of which each is more than a span after the one kept before.

A key's distinct times are cut into segments of SPANS spans, and no task has to walk a key's every time:

1. each segment tells where a walk through it would end, for every time at which the walk could enter it. It can enter at
   a time of its first span or at the first one after that, as the time kept before lies in an earlier segment; entries
   that follow each other and end alike are one row.
2. a key's segments are composed in order: the last kept time before a segment gives its entry, and that one its end.
   Only the entries' rows, at most those of one span in SPANS, pass through a key's task, as a stream with one time in
   memory.
3. each segment is walked from the time kept before it.

Steps 1 and 3 are spread by key and segment. Step 1 holds the times of one span, the others one time.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Spans in a segment.
SPANS = 32


def segment_ends(times: Iterator[int], start: int, span: int) -> Iterator[tuple[int, int]]:
    """(entry, end), both falling: where a walk that keeps entry ends; times are distinct and falling, none is before start.

    Of entries in a row with one end only the latest is given: it stands for all after the entry given next.
    """
    later: deque[tuple[int, int]] = deque()  # the times of one span after the current one, latest first, with their ends
    beyond, told = None, None
    for now in times:
        while len(later) > 1 and later[1][0] > now + span:
            later.popleft()
        end = later[0][1] if later and later[0][0] > now + span else now
        later.append((now, end))
        if now - start >= span:
            beyond = (now, end)  # the first time after the first span, if no earlier one follows
            continue
        if beyond is not None:
            yield beyond
            told, beyond = beyond[1], None
        if end != told:
            yield now, end
            told = end
    if beyond is not None:
        yield beyond


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """((key, segment), its rows) of batches in which these stand together; rows are streamed."""
    rows = chain.from_iterable(zip(*(c.to_pylist() for c in b.columns)) for b in batches)
    ahead = next(rows, None)

    def own(name: tuple) -> Iterator[tuple]:
        nonlocal ahead
        while ahead is not None and ahead[:2] == name:
            yield ahead[2:]
            ahead = next(rows, None)

    while ahead is not None:
        name = ahead[:2]
        part = own(name)
        yield name, part
        for _ in part:  # what the reader left
            pass


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], size: int = 10_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


def kept_times(times: DataFrame, key: str, time: str, span: int) -> DataFrame:
    """The kept rows of times, whose key and time (a long) are not null and distinct together; other columns stay.

    A key's first time is kept, then every time more than span after the last kept one.
    """
    width = SPANS * max(span, 1)
    rows = times.withColumn("__seg", F.expr(f"(`{time}` - pmod(`{time}`, {width}L)) div {width}L"))
    names, types = ["k", "seg", "entry", "end"], [pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((*name, *e) for name, part in _groups(batches) for e in segment_ends((r[0] for r in part), name[1] * width, span))
        yield from _batches(found, names, types)

    slim = rows.select(key, "__seg", time).repartition(key, "__seg").sortWithinPartitions(key, "__seg", F.desc(time))
    entries = slim.mapInArrow(ends, "k string, seg long, entry long, end long")

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def walk() -> Iterator[tuple]:
            last, anchor = None, 0
            for (k, seg), part in _groups(batches):
                known, before = k == last, anchor
                if known:
                    yield k, seg, before
                for entry, end in part:
                    if not known or entry > before + span:
                        anchor = end
                        break
                last = k

        yield from _batches(walk(), ["k", "seg", "anchor"], [pa.string(), pa.int64(), pa.int64()])

    anchors = entries.repartition("k").sortWithinPartitions("k", "seg", "entry").mapInArrow(compose, "k string, seg long, anchor long")
    # an anchor is a row of its segment that lies before the segment's times
    seeds = anchors.select(F.col("k").alias(key), F.col("seg").alias("__seg"), F.col("anchor").alias(time), F.lit(True).alias("__seed"))
    both = rows.withColumn("__seed", F.lit(False)).unionByName(seeds, allowMissingColumns=True)
    first = [key, "__seg", time, "__seed"]
    both = both.select(*first, *[c for c in times.columns if c not in first]).repartition(key, "__seg").sortWithinPartitions(key, "__seg", time)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, anchor = None, 0
        for batch in batches:
            keep = []
            for k, seg, now, seed in zip(*(batch.column(i).to_pylist() for i in range(4))):
                new = (k, seg) != last or now - anchor > span
                keep.append(new and not seed)
                if new:
                    last, anchor = (k, seg), now
            yield batch.filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(walk, both.schema).select(*times.columns)
