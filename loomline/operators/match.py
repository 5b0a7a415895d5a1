"""Matching of priced records to candles and detection of a source's clock offset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close")
#: Candidate offsets in minutes, from -12 to +14 hours by half an hour.
OFFSETS = tuple(range(-12 * 60, 14 * 60 + 1, 30))
FIT_MINUTES = 15


def cents(price: Column) -> Column:
    return F.bround(price * 100).cast("long")


def match_candles(records: DataFrame, candles: DataFrame, hours: int = 18, key: str = "record_id") -> DataFrame:
    """records with open_time and minutes (record less candle) of the one candle whose prices agree to the cent.

    Candles stand in their own bin of time and both neighbours, a bin being as wide as the bound, and the bin is a join
    key beside the prices: a price that returns for years meets only the candles near a record. Records with several
    candles, with a null price or without a time are left out.
    """
    width = hours * 3600
    a = records.select("*", *[cents(F.col(p)).alias(f"__{p}") for p in PRICES]).filter(" and ".join(f"__{p} is not null" for p in PRICES))
    a = a.withColumn("__bin", F.floor(F.unix_timestamp("published") / F.lit(width)))
    own = F.floor(F.unix_timestamp("open_time") / F.lit(width))
    b = candles.select("open_time", *[cents(F.col(p)).alias(f"__{p}") for p in PRICES], F.explode(F.array(own - 1, own, own + 1)).alias("__bin"))
    apart = (F.unix_timestamp("published") - F.unix_timestamp("open_time")) / F.lit(60.0)
    both = a.join(b, [*[f"__{p}" for p in PRICES], "__bin"]).filter(F.abs(apart) <= hours * 60)
    both = both.withColumn("minutes", apart).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    return both.filter("__n = 1").drop("__n", "__bin", *[f"__{p}" for p in PRICES])


def offset_scores(matches: DataFrame, keys: list[str] | None = None, offsets: tuple[int, ...] = OFFSETS) -> DataFrame:
    """(keys, offset, matches, share): how many records lie within a quarter of an hour of their candle once shifted.

    Records are counted once, by whole minute and by the open minute between two. An offset's records are the sum of the
    counts between its edges; a key has at most two counts a minute, however many records it has.
    """
    names = keys or []
    minute = F.floor("minutes")
    at = (2 * minute + F.when(F.col("minutes") > minute, 1).otherwise(0)).cast("long")  # even: the minute itself, odd: beyond it
    counts = matches.select(*names, at.alias("__at")).groupBy(*names, "__at").agg(F.count(F.lit(1)).alias("__n"))
    near = lambda o: F.col("__at").between(2 * (o - FIT_MINUTES) + 1, 2 * (o + FIT_MINUTES) - 1)
    fits = F.array(*[F.struct(F.lit(o).alias("offset"), F.sum(F.when(near(o), F.col("__n")).otherwise(0)).alias("fit")) for o in offsets])
    known = F.sum(F.when(F.col("__at").isNotNull(), F.col("__n")))
    got = counts.groupBy(*names).agg(F.sum("__n").alias("matches"), known.alias("__known"), fits.alias("__fits")).filter("matches > 0")
    return got.select(*names, "matches", "__known", F.explode("__fits").alias("__f")).select(*names, "__f.offset", "matches", (F.col("__f.fit") / F.col("__known")).alias("share"))


def best_offset(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The offset with the largest share; of equal ones the nearest to zero, then the smaller."""
    best = F.max(F.struct("share", (-F.abs(F.col("offset"))).alias("near"), (-F.col("offset")).alias("low"), "matches")).alias("b")
    got = scores.groupBy(*keys).agg(best) if keys else scores.agg(best)
    return got.select(*(keys or []), (-F.col("b.low")).alias("offset"), F.col("b.share").alias("share"), F.col("b.matches").alias("matches"))


def rule_shares(matches: DataFrame, offset: int, candle_minutes: int = 15) -> DataFrame:
    """Shares of records whose candle contains them, follows them next, or opens nearest to them."""
    d = F.col("minutes") - offset
    rules = {"containing": (d >= 0) & (d < candle_minutes), "next": (d < 0) & (d >= -candle_minutes), "nearest": F.abs(d) <= candle_minutes / 2}
    one = matches.agg(*[F.avg(c.cast("double")).alias(name) for name, c in rules.items()])
    pairs = ", ".join(f"'{name}', {name}" for name in rules)
    return one.selectExpr(f"stack({len(rules)}, {pairs}) as (rule, share)")


def verdict(overall: DataFrame, by_part: DataFrame, least_matches: int = 100, least_share: float = 0.9) -> DataFrame:
    """overall with `verdict`: too few matches, unclear, varying between parts, or reliable."""
    agree = by_part.crossJoin(F.broadcast(overall.select(F.col("offset").alias("__o")))).agg(F.min((F.col("offset") == F.col("__o")).cast("int")).alias("__same"))
    told = F.when(F.col("matches") < least_matches, "too few matches").when(F.col("share") < least_share, "unclear").when(F.col("__same") == 0, "varies").otherwise("reliable")
    return overall.crossJoin(F.broadcast(agree)).withColumn("verdict", told).drop("__same")


def sample_months(times: DataFrame, since: str, n: int = 16) -> DataFrame:
    """n evenly spaced months among those in which times(published) lie."""
    months = times.select(F.date_format("published", "yyyy-MM").alias("month")).filter(F.col("month") >= since).distinct()
    ranked = months.withColumn("__i", F.row_number().over(Window.orderBy("month")) - 1)  # a row a month
    count = ranked.agg(F.count(F.lit(1)).alias("__n"))
    picks = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * (F.col("__n") - 1) / F.lit(max(1, n - 1))).cast("int"))
    spots = count.select(F.explode(F.array_distinct(picks)).alias("__i"))
    return ranked.join(spots, "__i", "left_semi").select("month")


def sample_rows(news: DataFrame, months: DataFrame, time: str = "published", days: tuple[int, int] = (2, 27)) -> DataFrame:
    """Rows of the sampled months(month) between two days of the month: at its edges an offset would reach other months."""
    inside = news.filter(F.dayofmonth(time).between(*days))
    return inside.join(F.broadcast(months.select(F.col("month").alias("__month"))), F.date_format(time, "yyyy-MM") == F.col("__month"), "left_semi")


def commonest_deltas(matches: DataFrame, top: int = 10, column: str = "minutes") -> DataFrame:
    """(delta, n): the commonest whole minutes between records and candles; of equal ones the smaller first."""
    return matches.groupBy(F.bround(column).cast("long").alias("delta")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "delta").limit(top)
