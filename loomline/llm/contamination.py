"""Benchmark decontamination with a generalised suffix automaton.

The words of all test items form one automaton, which accepts exactly the runs of words that occur in an item. A
document's words are streamed through it; the state after each word is the longest run that ends there and occurs in an
item. Where it has `window` words or more, the last `window` are a hit; a shorter item is one window itself, found as a
suffix of the run along the automaton's suffix links. Spans of hit words, the items they come from and the longest run
are reported for each document (`matches`); `clean` cuts spans out of texts and drops documents that are mostly hit.

Scanning is a map over documents. The automaton is built from at most about BLOCK_WORDS words, so that what is broadcast
is bounded: items are cut into overlapping pieces of PIECE words, which share all windows, and dealt over as many blocks
as their words need; documents pass one block after the other, and what a pass has found is checkpointed before the next.

Defined results: words are runs of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased; a null text has none;
items without words or text are ignored; repeated items count once by their id, and items of equal text count each;
an item without an id makes words hit but is neither counted nor listed; repeated documents are rows like others; an empty
table of documents gives an empty result and one of items leaves all documents clean; in `matches` other columns are
not read, in `clean` they go through unchanged, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_rows

WINDOW = 10
#: Words of an automaton, of a piece of an item.
BLOCK_WORDS, PIECE = 200_000, 2_000
#: `clean` cuts spans of at least so many words, and drops documents of which at least this share is hit.
LEAST_SPAN, MOST_SHARE = 10, 0.5

_LETTERS = bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
#: Bytes to those of lower-cased words, all others to blanks; positions stay.
FOLD = bytes(b if b in _LETTERS else 32 for b in range(256)).lower()
_RUN = re.compile(rb"[^ ]+")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class Automaton:
    """The runs of words of several sequences.

    step holds state * width + word -> state, link a state's longest proper suffix state, length its longest run. ends
    has, for the states where an item shorter than the window ends and for those of whole windows, the items; short
    gives each state's nearest suffix state (or itself) that ends a short item, and gram that of its last `window` words.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window, self.number = window, {}
        for _, seq in items:
            for w in seq:
                self.number.setdefault(w, len(self.number))
        self.width = max(1, len(self.number))
        self.link, self.length, after = [-1], [0], [{}]
        coded = [(item, [self.number[w] for w in seq]) for item, seq in items if seq]
        for _, seq in coded:
            last = 0
            for w in seq:
                last = self._extend(after, last, w)
        self.step = {s * self.width + w: t for s, to in enumerate(after) for w, t in to.items()}
        del after
        self._mark(coded)

    def _new(self, after: list[dict], length: int, link: int, to: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        after.append(to)
        return len(self.length) - 1

    def _split(self, after: list[dict], p: int, w: int) -> int:
        """The state of p's longest run and w, apart from longer runs that used to share it."""
        q = after[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._new(after, self.length[p] + 1, self.link[q], dict(after[q]))
        self.link[q] = copy
        while p >= 0 and after[p].get(w) == q:
            after[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, after: list[dict], last: int, w: int) -> int:
        if w in after[last]:  # the run is known from an earlier sequence
            return self._split(after, last, w)
        state = self._new(after, self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in after[p]:
            after[p][w] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._split(after, p, w)
        return state

    def _mark(self, coded: list[tuple[str | None, list[int]]]) -> None:
        window, order = self.window, sorted(range(len(self.length)), key=self.length.__getitem__)
        self.gram = [-1] * len(order)
        for s in order[1:]:
            if self.length[s] >= window:
                up = self.link[s]
                self.gram[s] = s if self.length[up] < window else self.gram[up]
        found: dict[int, set] = {}
        ending = [False] * len(order)
        for item, seq in coded:
            state = 0
            for k, w in enumerate(seq):
                state = self.step[state * self.width + w]
                if k + 1 >= window:
                    found.setdefault(self.gram[state], set()).add(item)
            if len(seq) < window:
                ending[state] = True
                found.setdefault(state, set()).add(item)
        self.ends = {s: frozenset(i for i in items if i is not None) for s, items in found.items()}
        self.short = [0] * len(order)
        for s in order[1:]:
            self.short[s] = s if ending[s] else self.short[self.link[s]]

    def scan(self, seq: list[bytes]) -> tuple[list[tuple[int, int]], set, int]:
        """(spans of hit words as (start, end), items, words of the longest run) of a sequence of words."""
        get, step, width, link, length, gram, short, window = self.number.get, self.step.get, self.width, self.link, self.length, self.gram, self.short, self.window
        spans: list[list[int]] = []
        states, state, n, longest = set(), 0, 0, 0
        for i, w in enumerate(map(get, seq), 1):
            if w is None:
                state = n = 0
                continue
            to = step(state * width + w)
            while to is None:  # the root knows every word of the items
                state = link[state]
                n = length[state]
                to = step(state * width + w)
            state, n = to, n + 1
            if n > longest:
                longest = n
            hit = 0
            s = short[state]
            while s:
                if length[s] <= n:
                    states.add(s)
                    hit = max(hit, length[s])
                s = short[link[s]]
            if n >= window:
                states.add(gram[state])
                hit = window
            if hit:
                if spans and spans[-1][1] >= i - hit:
                    while len(spans) > 1 and spans[-2][1] >= i - hit:
                        spans.pop()
                    spans[-1] = [min(spans[-1][0], i - hit), i]
                else:
                    spans.append([i - hit, i])
        return [tuple(s) for s in spans], set().union(*(self.ends[s] for s in states)), longest


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, without overlaps; those that touch are one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(s) for s in out]


def pieces(items: DataFrame, window: int) -> DataFrame:
    """(item, run): the items' words by blanks, long ones in pieces that overlap by window - 1 words."""

    def make() -> Callable[[list[tuple]], list[tuple]]:
        def work(rows: list[tuple]) -> list[tuple]:
            out = []
            for item, text in rows:
                seq, stride = words(text), max(PIECE, window)
                for k in range(0, max(1, len(seq) - window + 1), stride):
                    if run := seq[k : k + stride + window - 1]:
                        out.append((item, b" ".join(run), len(run)))
            return out

        return work

    named = items.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    return map_rows(named, make, "item string, run binary, n int").dropDuplicates(["item", "run"])


def automata(items: DataFrame, window: int, block_words: int) -> Iterator[Automaton]:
    """An automaton for each block of items, one at a time; at least one, which may be empty."""
    runs = cut(pieces(items, window))
    total = runs.agg(F.sum("n")).first()[0] or 0
    count = -(-total // block_words) or 1
    dealt = runs.withColumn("__block", F.pmod(F.xxhash64("item", "run"), F.lit(count)))
    for k in range(count):
        rows = dealt.filter(F.col("__block") == k).select("item", "run").collect()  # about block_words words
        yield Automaton([(r.item, bytes(r.run).split(b" ")) for r in sorted(rows, key=lambda r: (r.item or "", r.run))], window)


_FOUND = "struct<n_words: long, spans: array<struct<start: long, end: long>>, items: array<string>, longest: long>"


def scanned(docs: DataFrame, items: DataFrame, window: int, block_words: int) -> DataFrame:
    """docs(row, text) with found: the number of words, spans of hit words, items and the longest run."""
    spark = docs.sparkSession
    schema = f"row {docs.schema['row'].dataType.simpleString()}, text string, found {_FOUND}"
    now = docs.select("row", F.col("text").cast("string").alias("text"), F.lit(None).cast(_FOUND).alias("found"))
    for k, one in enumerate(automata(items, window, block_words)):
        now, shared = cut(now) if k else now, spark.sparkContext.broadcast(one)

        def make(shared=shared) -> Callable[[list[tuple]], list[tuple]]:
            automaton = shared.value

            def work(rows: list[tuple]) -> list[tuple]:
                out = []
                for row, text, before in rows:
                    seq = words(text)
                    spans, hit, longest = automaton.scan(seq)
                    if before:
                        spans = joined(spans + [(s["start"], s["end"]) for s in before["spans"]])
                        hit, longest = hit.union(before["items"]), max(longest, before["longest"])
                    found = {"n_words": len(seq), "spans": [{"start": a, "end": b} for a, b in spans], "items": sorted(hit), "longest": longest}
                    out.append((row, text, found))
                return out

            return work

        now = map_rows(now, make, schema, slice_rows=256)
    return now


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, spans, items, longest) of docs(doc_id, text) against items(item_id, text)."""
    found = scanned(docs.select(F.col("doc_id").alias("row"), "text"), items, window, block_words)
    hit = F.aggregate("found.spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return found.select(F.col("row").alias("doc_id"), "found.n_words", hit.alias("n_hit"), "found.spans", "found.items", "found.longest")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """text from which the words of spans go, with what stands between them."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _RUN.finditer(raw.translate(FOLD))]
    kept, end = [], 0
    for a, b in spans:
        kept.append(raw[end : at[a][0]])
        end = at[b - 1][1]
    return b"".join([*kept, raw[end:]]).decode("utf-8", "surrogatepass")


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, least_span: int = LEAST_SPAN, most_share: float = MOST_SHARE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without the spans of at least least_span words and without documents of which most_share or more is hit."""
    found = scanned(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text"), items, window, block_words)
    hit = F.aggregate("found.spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    kept = found.filter((hit == 0) | (hit < most_share * F.col("found.n_words")))
    schema = f"row {found.schema['row'].dataType.simpleString()}, text string"

    def make() -> Callable[[list[tuple]], list[tuple]]:
        def work(rows: list[tuple]) -> list[tuple]:
            out = []
            for row, text, got in rows:
                spans = [(s["start"], s["end"]) for s in got["spans"] if s["end"] - s["start"] >= least_span]
                out.append((row, without(text, spans) if spans else text))
            return out

        return work

    done = map_rows(kept, make, schema, slice_rows=256)
    return done.select(*[(F.col("text") if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
