"""Text functions over columns. Two of them (HTML entities, NFKC) need Python and run as Arrow UDFs."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# How titles name the two coins in either alphabet. Other coins with like names are ruled out.
COINS = {
    "mentions_btc": r"\b(?:биткоин\w*|биткойн\w*|bitcoin(?!\s+(?:cash|sv|gold)\b)|btc)\b",
    "mentions_eth": r"\b(?:эфириум\w*|эфир(?:а|у|ом)?|ethereum(?!\s+classic\b)|ether|eth)\b",
}
# Where pages say when they were published, the first one that is there counts.
TIME_PATTERNS = (
    r'<time[^>]+datetime="([^"]+)"',
    r'"datePublished"\s*:\s*"([^"]+)"',
    r'<meta[^>]+property="article:published_time"[^>]+content="([^"]+)"',
    r'<meta[^>]+name="pubdate"[^>]+content="([^"]+)"',
    r'<meta[^>]+itemprop="datePublished"[^>]+content="([^"]+)"',
)
# A clock and a zone in a time mark, sitemaps with and without articles, addresses that are no articles, and slugs that are.
MINUTES = r"\d{1,2}:\d{2}"
ZONE = r"(Z|[+-]\d{2}:?\d{2}|GMT|MSK|\+0300)"
ARTICLE_SITEMAP = r"(?i)(news|post|article|iblock|archive)"
OTHER_SITEMAP = r"(?i)(author|tag|term|categor|page-sitemap|pairs|converter|quiz|calculator|files|image)"
NO_ARTICLE = (
    r"(?i)\.(png|jpe?g|gif|svg|webp|ico|css|js|pdf|xml|zip)(\?|$)"
    r"|/(tag|tags|category|rubrics?|author|page|search|feed|wp-content|wp-json|about|contacts?)/"
)
SLUG = r"/[^/]*-[^/]*-[^/]*/?$"


# Characters that NFKC never changes, nor composes with what stands before them: texts of these alone are their own NFKC form.
STABLE = (
    r"\x00-\x9F\xA1-\xA7\xA9\xAB-\xAE\xB0\xB1\xB6\xB7\xBB\xBF-\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E\u0180-\u01C3\u0388-\u03CF\u0400-\u0482"
    r"\u05D0-\u05EA\u0621-\u064A\u2012-\u2016\u2018-\u2023\u20AC\u3001-\u3020\u3041-\u3096\u30A0-\u30FE\u4E00-\u9FFF\uAC00-\uD7A3"
)
#: Stretches that NFKC leaves alone, less the character before an odd one, with which that may compose; a NUL always belongs to them.
STILL = rf"[\x00-\x7F[{STABLE}]]+(?:(?![\s\S])|(?<=\x00)|(?=[\x00-\x7F[{STABLE}]]))"
#: Texts that a task turns into Python objects at once.
SLICE = 64


def _by_slices(work: Callable[[str], str], texts: pa.Array) -> pa.Array:
    """work of each text; only SLICE texts are Python objects at a time."""
    parts = [pa.array([None if t is None else work(t) for t in texts.slice(i, SLICE).to_pylist()], texts.type) for i in range(0, len(texts), SLICE)]
    return pa.concat_arrays(parts) if parts else texts


@F.arrow_udf(StringType())
def _unescape(text: pa.Array) -> pa.Array:
    return _by_slices(html.unescape, text)


@F.arrow_udf(StringType())
def _nfkc(text: pa.Array) -> pa.Array:
    return _by_slices(partial(unicodedata.normalize, "NFKC"), text)


def _where(needed: Column, change: Callable[[Column], Column], text: Column) -> Column:
    """change(text) where needed, else text. Spark evaluates a Python function for all rows, so that the others are null to it."""
    return F.coalesce(change(F.when(needed, text)), text)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def unescape_title(text: Column) -> Column:
    """Entities decoded, white space collapsed and trimmed; null stays null."""
    return collapse(_where(F.instr(text, "&") > 0, _unescape, text))


def fold_title(text: Column) -> Column:
    """Lower case; everything but letters, digits and underscores becomes one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "))


def nfkc(text: Column) -> Column:
    """The NFKC form. Only what stands between STILL stretches reaches Python, joined by NULs, which neither change nor compose."""
    odd = F.when(text.rlike(rf"[^\x00-\x7F](?<![{STABLE}])"), F.array_join(F.split(text, STILL, -1), "\0"))
    changed = F.split(_nfkc(odd), "\0", -1)
    still = F.regexp_extract_all(text, F.lit(STILL), 0)
    joined = F.array_join(F.zip_with(changed, still, lambda new, rest: F.concat(new, F.coalesce(rest, F.lit("")))), "")
    return F.when(changed.isNotNull(), joined).otherwise(text)


def normalize_title(text: Column) -> Column:
    """fold_title of the NFKC form."""
    return fold_title(nfkc(text))


def source_of(url: Column) -> Column:
    """The address's host in lower case without www.; a port stays; no host gives an empty string."""
    return F.coalesce(F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("AUTHORITY"))), r"^www\.", ""), F.lit(""))


def tag(frame: DataFrame, column: str, patterns: dict[str, str]) -> DataFrame:
    """A boolean column for each pattern, found without regard to case and with Unicode word boundaries."""
    return frame.withColumns({name: F.coalesce(F.col(column), F.lit("")).rlike(f"(?iU){p}") for name, p in patterns.items()})


def strip_tags(markup: Column) -> Column:
    return collapse(F.regexp_replace(markup, r"<[^>]+>", " "))


def first_time(markup: Column) -> Column:
    """The first time mark by the order of TIME_PATTERNS, or null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(markup, f"(?i){p}", 1), F.lit("")) for p in TIME_PATTERNS])


def feed_time(xml: Column) -> Column:
    """The first publication time of a feed, or null; it stands in where pages have none."""
    return F.nullif(F.trim(F.regexp_extract(xml, r"(?is)<pubDate>([^<]+)</pubDate>", 1)), F.lit(""))


def has_minutes(time: Column) -> Column:
    return time.rlike(MINUTES)


def has_zone(time: Column) -> Column:
    return time.rlike(ZONE)


def robots(text: Column) -> Column:
    """A robots.txt as a struct: whether a plain reader may fetch the site's root, the crawl delay in seconds, sitemaps.

    Only the records of all agents (*) count; the root is barred by a rule `Disallow: /` without `Allow: /` among them.
    """
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), lambda x: F.trim(F.regexp_replace(x, r"#.*$", "")))
    value = lambda x: F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1))
    is_ = lambda x, name: F.lower(x).rlike(rf"^{name}\s*:")
    start = F.struct(F.lit(False).alias("ours"), F.lit(False).alias("agents"), F.array().cast("array<string>").alias("rules"))

    def step(state: Column, line: Column) -> Column:
        agent = is_(line, "user-agent")
        mine = agent & (value(line) == "*") | state["ours"] & (~agent | state["agents"])
        rule = mine & is_(line, "(allow|disallow|crawl-delay)")
        return F.struct(mine.alias("ours"), (agent | (state["agents"] & (line == ""))).alias("agents"), F.when(rule, F.concat(state["rules"], F.array(line))).otherwise(state["rules"]).alias("rules"))

    rules = F.aggregate(lines, start, step)["rules"]
    named = lambda name: F.transform(F.filter(rules, lambda x: is_(x, name)), value)
    barred = F.array_contains(named("disallow"), "/") & ~F.array_contains(named("allow"), "/")
    sitemaps = F.transform(F.filter(lines, lambda x: is_(x, "sitemap")), value)
    return F.struct((~barred).alias("allows"), F.get(named("crawl-delay"), F.lit(0)).try_cast("double").alias("delay"), sitemaps.alias("sitemaps"))


def links(markup: Column) -> Column:
    return F.regexp_extract_all(markup, F.lit(r'href="([^"]+)"'), 1)


def sitemap_locations(xml: Column) -> Column:
    """Addresses of a sitemap or sitemap index."""
    return F.transform(F.regexp_extract_all(xml, F.lit(r"(?s)<loc>(.*?)</loc>"), 1), lambda x: F.trim(x))


def rss_items(xml: Column) -> Column:
    """Structs (title, link, published) of a feed's items."""
    field = lambda block, name: F.trim(F.regexp_extract(block, rf"(?s)<{name}>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</{name}>", 1))
    return F.transform(
        F.regexp_extract_all(xml, F.lit(r"(?s)<item>(.*?)</item>"), 1),
        lambda b: F.struct(field(b, "title").alias("title"), field(b, "link").alias("link"), field(b, "pubDate").alias("published")),
    )


def sitemap_entries(xml: Column) -> Column:
    """Structs (url, changed) of a sitemap's blocks, without addresses that are no articles; changed is a day or null."""
    entry = lambda b: F.struct(
        F.regexp_extract(b, r"<loc>\s*([^<\s]+)", 1).alias("url"), F.nullif(F.regexp_extract(b, r"<lastmod>\s*(\d{4}-\d{2}-\d{2})", 1), F.lit("")).alias("changed")
    )
    blocks = F.regexp_extract_all(xml, F.lit(r"(?s)<url>(.*?)</url>"), 1)
    return F.filter(F.transform(blocks, entry), lambda e: (e["url"] != "") & ~e["url"].rlike(NO_ARTICLE))


def article_sitemaps(locations: Column) -> Column:
    """Of a sitemap index's addresses those of articles; where none says so, all that aren't of something else."""
    kept = F.filter(locations, lambda x: ~x.rlike(OTHER_SITEMAP))
    named = F.filter(kept, lambda x: x.rlike(ARTICLE_SITEMAP))
    return F.when(F.size(named) > 0, named).otherwise(kept)


def is_article_url(url: Column) -> Column:
    """A slug of at least three parts at the address's end, outside folders and kinds of files that are no articles."""
    return url.rlike(SLUG) & ~url.rlike(NO_ARTICLE)


def parse_label(label: Column, aliases: dict[str, str]) -> Column:
    """The label that an alias stands for; unknown ones raise."""
    known = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    key = F.lower(F.trim(label))
    found = F.try_element_at(known, key)
    return F.when(key.isNull() | (key == ""), None).when(found.isNull(), F.raise_error(F.concat(F.lit("unknown label: "), key))).otherwise(found)


def decimal_comma(value: Column, digits: int) -> Column:
    return F.translate(F.format_number(value, digits), ",.", " ,")


def slug(name: Column) -> Column:
    """A model's name as part of a file name."""
    return F.regexp_replace(F.regexp_replace(name, r"[^\p{L}\p{N}._-]+", "-"), r"^-+|-+$", "")


def model_key(model: Column, features: Column) -> Column:
    """The key of a model on a feature set; naive models have the set P."""
    return F.concat_ws(":", model, F.coalesce(features, F.lit("P")))


def sheet_safe(text: Column) -> Column:
    """Text that a spreadsheet won't read as a formula, without control characters."""
    plain = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    return F.when(plain.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), plain)).otherwise(plain)


def instruction_rows(markdown: Column) -> Column:
    """Lines of a markdown text as structs (kind, text): head, item or plain, without empty lines and marks."""
    lines = F.filter(F.transform(F.split(markdown, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    kind = lambda x: F.when(x.rlike(r"^#+\s"), "head").when(x.rlike(r"^(?:[-*]|\d+\.)\s"), "item").otherwise("plain")
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, r"^(?:#+|[-*]|\d+\.)\s+", ""), r"\*\*|`", "")
    return F.transform(lines, lambda x: F.struct(kind(x).alias("kind"), bare(x).alias("text")))
