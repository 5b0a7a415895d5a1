"""Hourly aggregates and anchored repeats over streams. An addition: the batch operators define the results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def hourly_news(news: DataFrame, late: str = "2 hours") -> DataFrame:
    """The batch hourly_news over a stream: tumbling hours, closed once the watermark has passed them."""
    hours = news.withWatermark("published", late).groupBy(F.window("published", "1 hour"))
    got = hours.agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("sent_mean"), F.avg(F.when(F.col("label") == "negative", 1.0).otherwise(0.0)).alias("neg_share"))
    return got.select(F.col("window.start").alias("hour"), "n", "sent_mean", "neg_share")


def distinct_urls(news: DataFrame, late: str = "24 hours") -> DataFrame:
    """The first row of each address within the watermark."""
    return news.withWatermark("published", late).dropDuplicatesWithinWatermark(["url"])


def anchored_repeats(news: DataFrame, key: str, hours: int = 24, late: str = "1 hour") -> DataFrame:
    """(key, published, repeat) of rows that arrive in order within a micro-batch: state is a key's last kept time.

    A key's state is dropped once the watermark is beyond its anchor by the window.
    """
    span = pd.Timedelta(hours=hours)

    def walk(names: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        anchor = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        rows = pd.concat(list(frames)).sort_values("published")
        flags = []
        for t in rows["published"]:
            again = anchor is not None and t - anchor <= span
            flags.append(again)
            anchor = anchor if again else t
        state.update((int(anchor.value // 1000),))
        state.setTimeoutTimestamp(max(int((anchor + span).value // 1_000_000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: names[0], "published": rows["published"], "repeat": flags})

    marked = news.withWatermark("published", late).select(key, "published").groupBy(key)
    return marked.applyInPandasWithState(walk, f"{key} string, published timestamp, repeat boolean", "anchor_us long", "append", GroupStateTimeout.EventTimeTimeout)
