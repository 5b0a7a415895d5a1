"""A Python data source for paged JSON collections: one partition a page in batch, page numbers as stream offsets.

    spark.dataSource.register(PagedRecords)
    spark.read.format("paged_records").option("url", "https://host/api?page={page}").option("pages", 20).load()

The url may be any that urllib opens, file:// included. A page that doesn't exist ends the collection.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "page int, id long, url string, published_utc string, title string, categories array<long>, tags array<long>"


def fetch(url: str, retries: int = 4, pause: float = 1.0, timeout: float = 30.0) -> bytes | None:
    """The body at url, or None where there is none (400 or 404, or no such file); 429 and 5xx are tried again."""
    for attempt in range(retries + 1):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as answer:
                return answer.read()
        except urllib.error.HTTPError as e:
            if e.code in (400, 404):
                return None
            if e.code != 429 and e.code < 500 or attempt == retries:
                raise
        except urllib.error.URLError as e:
            if isinstance(e.reason, FileNotFoundError):
                return None
            if attempt == retries:
                raise
        time.sleep(pause * 2**attempt)
    return None


def rows_of(page: int, body: bytes | None) -> list[tuple]:
    """Rows of SCHEMA; items without an address or a date are left out."""
    out = []
    for item in json.loads(body) if body else []:
        if item.get("link") and item.get("date_gmt"):
            title = item.get("title") or {}
            out.append((page, item.get("id"), item["link"], item["date_gmt"] + "Z", title.get("rendered"), item.get("categories") or [], item.get("tags") or []))
    return out


class Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class Pages(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.url, self.done = options["url"], {int(p) for p in options.get("done", "").split(",") if p}
        self.first, self.count, self.pause = int(options.get("first", 1)), int(options["pages"]), float(options.get("pause", 1.0))

    def partitions(self) -> list[Page]:
        return [Page(n) for n in range(self.first, self.first + self.count) if n not in self.done]

    def read(self, partition: Page) -> Iterator[tuple]:
        yield from rows_of(partition.number, fetch(self.url.format(page=partition.number), pause=self.pause))


class PageStream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.url, self.first, self.pause = options["url"], int(options.get("first", 1)), float(options.get("pause", 1.0))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"page": self.first}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        body = fetch(self.url.format(page=start["page"]), pause=self.pause)
        return iter(rows_of(start["page"], body)), {"page": start["page"] + (body is not None)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        for page in range(start["page"], end["page"]):
            yield from rows_of(page, fetch(self.url.format(page=page), pause=self.pause))


class PagedRecords(DataSource):
    """Options: url with {page}, first, pages (batch), done (pages to skip, comma-separated), pause in seconds."""

    @classmethod
    def name(cls) -> str:
        return "paged_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Pages:
        return Pages(self.options)

    def simpleStreamReader(self, schema) -> PageStream:  # noqa: N802
        return PageStream(self.options)
