"""Cleaning of timestamped headlines: time precision, repeats, bursts, and what each stage removes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_title
from ..functions.times import clock, month_label
from ..session import cut
from .anchors import kept_times

STAGES = ("records", "with a valid time", "with title and address", "with a precise time", "without repeated addresses", "without repeated titles")


def has_text(*columns: str) -> Column:
    """Every column has something but white space."""
    out = F.lit(True)
    for c in columns:
        out = out & (F.length(F.trim(F.coalesce(c, F.lit("")))) > 0)
    return out


def drop_sources(news: DataFrame, sources: list[str]) -> tuple[DataFrame, DataFrame]:
    """(what is left, (source, n) of each listed source, zeros included)"""
    listed = news.sparkSession.createDataFrame([(s,) for s in dict.fromkeys(sources)], "source string")
    counts = news.join(F.broadcast(listed), "source", "left_semi").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return news.join(F.broadcast(listed), "source", "left_anti"), listed.join(counts, "source", "left").na.fill(0, ["n"])


def clock_counts(news: DataFrame, time: str = "published") -> DataFrame:
    """(source, records, top_clock, top_n): the commonest time of day; of equal ones the earliest."""
    per = news.groupBy("source", clock(F.col(time)).alias("clock")).agg(F.count(F.lit(1)).alias("n"))
    top = F.max(F.struct(F.col("n"), (-F.unix_timestamp(F.col("clock"), "HH:mm:ss")).alias("early"), F.col("clock"))).alias("top")
    return per.groupBy("source").agg(F.sum("n").alias("records"), top).select("source", "records", F.col("top.clock").alias("top_clock"), F.col("top.n").alias("top_n"))


def time_precision(news: DataFrame, time: str = "published") -> DataFrame:
    """How precise each source's times are: shares at midnight, on the hour, on the minute, and of the top clock."""
    t = F.col(time)
    share = lambda c: F.bround(F.avg(c.cast("double")), 4)
    shares = news.groupBy("source").agg(
        share(clock(t) == "00:00:00").alias("midnight_share"),
        share((F.minute(t) == 0) & (F.second(t) == 0)).alias("hour_share"),
        share(F.second(t) == 0).alias("minute_share"),
    )
    counts = clock_counts(news, time)
    return counts.join(shares, "source").withColumn("top_share", F.bround(F.col("top_n") / F.col("records"), 4)).drop("top_n")


def imprecise(news: DataFrame, time: str = "published", share: float = 0.3, least: int = 50) -> DataFrame:
    """news with `imprecise`: midnight, or the clock that stands at `share` of a source with `least` or more records."""
    counts = clock_counts(news, time).select("source", F.when((F.col("records") >= least) & (F.col("top_n") / F.col("records") >= share), F.col("top_clock")).alias("__stub"))
    own = clock(F.col(time))
    marked = news.join(counts, "source", "left")
    return marked.withColumn("imprecise", (own == "00:00:00") | F.coalesce(own == F.col("__stub"), F.lit(False))).drop("__stub")


def told_apart(news: DataFrame) -> DataFrame:
    """news, cut off, with __u, a number of its own for each row, so that one of equal rows can be kept."""
    return cut(news.withColumn("__u", F.monotonically_increasing_id()))


def anchored_repeats(news: DataFrame, key: str, time: str, tie: str, hours: int = 24, own: str | None = None, keyless_once: bool = False) -> DataFrame:
    """news with `repeat`: at most `hours` after the last kept row of its key; of equal times the least tie comes first.

    Which times are kept follows from a key's distinct times alone. These are aggregated before they are shuffled, and
    walked in segments of time (anchors.kept_times), so that no title is one task, however many times it has. The rows,
    wherever they lie, then look their own time up. Rows without a time are never repeats; of rows equal in key, time and
    tie one is kept. own is a column that tells all rows apart; without it they get one, at the price of a cut. Rows
    without a key are one key, of which with keyless_once only the first row is kept, whatever the time between them.
    """
    span = hours * 3_600_000_000
    rows = (told_apart(news) if own is None else news.withColumn("__u", F.col(own))).withColumn("__k", F.sha2(F.coalesce(F.col(key).cast("string"), F.lit("\0")), 256)).withColumn("__s", F.unix_micros(F.col(time)))
    walked = F.when(F.col(key).isNull() & F.lit(keyless_once), F.lit(0).cast("long")).otherwise(F.col("__s"))
    times = rows.filter("__s is not null").groupBy("__k", walked.alias("__at")).agg(F.min(F.struct("__s", F.col(tie).alias("tie"), "__u")).alias("__first"))
    kept = kept_times(times, "__k", "__at", span)
    kept = kept.select(F.col("__k").alias("__kk"), F.col("__first.__s").alias("__ks"), F.col("__first.__u").alias("__first"))
    marked = rows.join(kept, (F.col("__k") == F.col("__kk")) & (F.col("__s") == F.col("__ks")), "left")
    repeat = F.col("__s").isNotNull() & ~F.coalesce(F.col("__u") == F.col("__first"), F.lit(False))
    return marked.withColumn("repeat", repeat).select(*news.columns, "repeat")


def _numbered_runs(news: DataFrame, time: str, source: str, gap: float, tie: str | None, block: int) -> tuple[DataFrame, DataFrame]:
    """(rows, parts): rows with their block of time and the run's number inside it; each such part of a run.

    A source is cut into blocks of time, so that no task orders a source's every row; a block's first row is compared
    with the last one of the block before it, which comes from one row a block. Parts have burst, the run's number
    within its source, and its size.
    """
    rows = news.withColumn("__s", F.unix_micros(F.col(time)) / F.lit(1e6))
    rows = rows.withColumn("__b", F.coalesce(F.floor(F.col("__s") / F.lit(block)), F.lit(-(1 << 60)))).withColumn("__src", F.coalesce(F.col(source).cast("string"), F.lit("\0")))
    blocks = rows.groupBy("__src", "__b").agg(F.max("__s").alias("__hi"))
    before = blocks.select("__src", "__b", F.lag("__hi").over(Window.partitionBy("__src").orderBy("__b")).alias("__last"))
    w = Window.partitionBy("__src", "__b").orderBy(time, *([tie] if tie else []))
    rows = rows.join(before, ["__src", "__b"])
    starts = F.when(F.col("__s") - F.coalesce(F.lag("__s").over(w), F.col("__last")) >= gap, 1).otherwise(0)
    rows = rows.withColumn("__start", starts).withColumn("__run", F.sum("__start").over(w))
    parts = rows.groupBy("__src", "__b", "__run").agg(F.count(F.lit(1)).alias("__n"), F.min(time).alias("first"), F.max(time).alias("last"), F.first(source).alias(source))
    starts = parts.groupBy("__src", "__b").agg(F.max("__run").alias("__starts"))
    upto = F.sum("__starts").over(Window.partitionBy("__src").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    base = starts.select("__src", "__b", F.coalesce(upto, F.lit(0)).alias("__base"))
    parts = parts.join(base, ["__src", "__b"]).withColumn("burst", F.col("__base") + F.col("__run")).drop("__base")
    return rows, parts.withColumn("burst_size", F.sum("__n").over(Window.partitionBy("__src", "burst")))


def bursts(news: DataFrame, time: str = "published", source: str = "source", least: int = 10, gap: float = 60.0, tie: str | None = None, block: int = 86_400) -> DataFrame:
    """news with burst, burst_size and in_burst: runs of a source in which rows follow each other in less than gap seconds."""
    rows, parts = _numbered_runs(news, time, source, gap, tie, block)
    marked = rows.join(parts.select("__src", "__b", "__run", "burst", "burst_size"), ["__src", "__b", "__run"])
    return marked.withColumn("in_burst", F.col("burst_size") >= least).select(*news.columns, "burst", "burst_size", "in_burst")


def burst_runs(news: DataFrame, time: str = "published", source: str = "source", least: int = 10, gap: float = 60.0, tie: str | None = None, block: int = 86_400) -> DataFrame:
    """(source, first, last, n) of each burst."""
    _, parts = _numbered_runs(news.select(time, source, *([tie] if tie else [])), time, source, gap, tie, block)
    found = parts.filter(F.col("burst_size") >= least)
    return found.groupBy("__src", "burst").agg(F.first(source).alias(source), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("__n").alias("n")).drop("__src", "burst")


def sources_span(news: DataFrame, recent_months: int = 12) -> DataFrame:
    """(source, n, first, last, recent, recent_share): recent counts times after the last one less the months."""
    edge = news.select((F.max("published") - F.make_ym_interval(F.lit(0), F.lit(recent_months))).alias("edge"))
    rows = news.crossJoin(F.broadcast(edge))  # one row
    per = rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.min("published").alias("first"), F.max("published").alias("last"), F.count_if(F.col("published") > F.col("edge")).alias("recent")
    )
    total = per.agg(F.greatest(F.sum("recent"), F.lit(1)).alias("__total"))
    return per.crossJoin(F.broadcast(total)).withColumn("recent_share", F.bround(F.col("recent") / F.col("__total"), 4)).drop("__total")


def source_months(news: DataFrame, sources: list[str]) -> DataFrame:
    """Records of each listed source by month; zeros filled."""
    return news.groupBy(month_label(F.col("published")).alias("month")).pivot("source", sources).agg(F.count(F.lit(1))).na.fill(0)


def flag_coverage(news: DataFrame, a: str = "tag_a", b: str = "tag_b") -> DataFrame:
    """(kind, n, share): with a, with b, with both, with none, all."""
    one = news.agg(
        F.count_if(a).alias("a"), F.count_if(b).alias("b"), F.count_if(F.col(a) & F.col(b)).alias("both"), F.count_if(~F.col(a) & ~F.col(b)).alias("none"), F.count(F.lit(1)).alias("total")
    )
    rows = one.selectExpr("total", "stack(5, 'a', a, 'b', b, 'both', both, 'none', none, 'total', total) as (kind, n)")
    return rows.select("kind", "n", F.bround(F.col("n") / F.greatest("total", F.lit(1)), 4).alias("share"))


def cleaning_marks(news: DataFrame, time: str = "published", clock_column: str | None = None, hours: int = 24, least: int = 50, tie: str = "doc_id", key: Column | None = None, required: bool = True) -> DataFrame:
    """news with `removed_at`: the number of the stage in STAGES that drops the row, or null.

    Each stage looks only at rows that the earlier ones left. Of equal rows one is left: rows get a number of their own in
    one cut, which all stages read. Unless time, title and address are required, stages 1 and 2 drop nothing: a row without
    a time has no precise one, rows without an address have the same one, and of those without a title's key one is left.
    """
    t = clock_column or time
    stage = F.when(F.col(time).isNull(), 1).when(~has_text("title", "url"), 2) if required else F.lit(None).cast("int")
    rows = told_apart(news.withColumn("__norm", normalize_title(F.col("title")) if key is None else key)).withColumn("__stage", stage)
    rows = rows.withColumn("__clock", clock(F.col(t)))
    alive = F.col("__stage").isNull()
    counts = rows.filter(alive).groupBy("source", "__clock").agg(F.count(F.lit(1)).alias("n"))
    top = F.max(F.struct("n", (-F.unix_timestamp("__clock", "HH:mm:ss")).alias("early"), "__clock")).alias("top")
    stub = counts.groupBy("source").agg(F.sum("n").alias("records"), top).filter(F.col("records") >= least).filter(F.col("top.n") / F.col("records") >= 0.3)
    rows = rows.join(stub.select("source", F.col("top.__clock").alias("__stub")), "source", "left")
    vague = (F.col("__clock") == "00:00:00") | F.coalesce(F.col("__clock") == F.col("__stub"), F.lit(False))
    rows = rows.withColumn("__stage", F.when(alive & (vague | F.col(time).isNull()), 3).otherwise(F.col("__stage")))
    # the first living row of an address, found by an aggregate, and met by its own number, so that no address is one key
    first = rows.filter(alive).groupBy("url").agg(F.min(F.struct(F.col(time).alias("t"), F.col(tie).alias("k"), "__u")).alias("__f")).select(F.col("__f.__u").alias("__first"))
    rows = rows.join(first, F.col("__u") == F.col("__first"), "left").withColumn("__stage", F.when(alive & F.col("__first").isNull(), 4).otherwise(F.col("__stage"))).drop("__clock", "__stub", "__first")
    kept = anchored_repeats(rows.filter(alive), "__norm", time, tie, hours, own="__u", keyless_once=not required)
    kept = kept.withColumn("__stage", F.when(F.col("repeat"), 5)).drop("repeat")
    return kept.unionByName(rows.filter(~alive)).drop("__norm", "__u").withColumnRenamed("__stage", "removed_at")


def stage_table(marked: DataFrame) -> DataFrame:
    """(stage, name, left, removed) of cleaning_marks()."""
    names = marked.sparkSession.createDataFrame(list(enumerate(STAGES)), "stage int, name string")
    lost = marked.groupBy(F.coalesce("removed_at", F.lit(len(STAGES))).alias("stage")).agg(F.count(F.lit(1)).alias("n"))
    later = names.alias("a").join(lost.alias("b"), F.col("b.stage") > F.col("a.stage"), "left").groupBy("a.stage", "a.name").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("left"))
    return later.join(lost.withColumnRenamed("n", "removed"), "stage", "left").na.fill(0, ["removed"])
