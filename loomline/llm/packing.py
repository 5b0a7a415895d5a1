"""Best-fit-decreasing packing of tokenised documents into sequences.

Documents are cut into pieces of at most CAPACITY tokens and packed longest first, each into the tightest sequence
it fits. The tightest capacity is found in a segment tree over remaining capacities, in logarithmic time. Sequences
with equal room and pieces of equal length are interchangeable, so a placement covers a run of equal pieces: the
packing of all data is worked out from the number of pieces of each length (at most CAPACITY numbers) and is the one
that document-by-document best-fit decreasing gives. Each piece then finds its place from its length and its number
among the pieces of that length, which are numbered in parallel.

Token ids: the 50k byte-level vocabulary, by its rank file, which gives the ids of its `tokenizers` file (tested over
all code points in use) at a quarter of the time; the end-of-text string in a text is its id, as there. Runs of white
space from LONG_RUN characters on, which the pattern's look-ahead can't take, are encoded beside it, in blocks joined
where the two tokens at the seam are what their bytes alone encode to (then the blocks' tokens are those of the run).

Defined results: null and empty texts are documents of the end id alone; repeated rows are packed each; null ids are
kept; an empty table packs into nothing; very long texts, of white space or anything else, only make more pieces; other
columns are not read.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PER_BUCKET, cut, map_rows, numbered

CAPACITY, END_ID = 2048, 0
END_OF_TEXT, END_OF_TEXT_ID = "<|endoftext|>", 50256
#: Characters of white space that are encoded beside the pattern, and bytes that are encoded at once there.
LONG_RUN, RUN_BLOCK = 50_000, 1 << 20
#: White space as the vocabulary's pattern has it (Unicode's White_Space).
_RUN = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}+" % LONG_RUN)


def encoder(path: str | None = None):
    """text -> ids of the byte-level vocabulary at path (a rank file)."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    own = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: END_OF_TEXT_ID})
    single, token = own._core_bpe.encode_single_piece, {v: k for k, v in ranks.items()}

    def encode(text: str) -> list[int]:
        if len(text) < LONG_RUN or not _RUN.search(text):
            return own.encode(text, allowed_special="all")
        out: list[int] = []
        for k, part in enumerate(text.split(END_OF_TEXT)):
            out += [END_OF_TEXT_ID] * (k > 0)
            at = 0
            for run in _RUN.finditer(part):
                # the last white space before another character belongs to what follows
                end = run.end() - (run.end() < len(part))
                out += own.encode_ordinary(part[at : run.start()])
                out += run_ids(part[run.start() : end].encode(), single, token)
                at = end
            out += own.encode_ordinary(part[at:])
        return out

    return encode


def run_ids(piece: bytes, single: Callable[[bytes], list[int]], token: dict[int, bytes], block: int = RUN_BLOCK) -> list[int]:
    """The ids of a piece that no pattern splits, worked out in blocks; single encodes bytes as they stand.

    Encodings of two halves stand side by side in the encoding of the whole if their two tokens at the seam do so in
    the encoding of those two alone. A block is shortened until that holds; failing that, the piece is encoded at once.
    """
    joined = lambda a, b: single(token[a] + token[b]) == [a, b]
    out: list[int] = []
    at = 0
    while at < len(piece):
        for end in range(min(len(piece), at + block), max(at, at + block - 256), -1):
            ids = single(piece[at:end])
            if out and not joined(out[-1], ids[0]):
                continue
            if end == len(piece) or joined(ids[-1], single(piece[end : end + 4096])[0]):
                break
        else:
            return single(piece)
        out += ids
        at = end
    return out


def cuts(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, after a first one that may be shorter."""
    first = length % capacity or min(length, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, length, capacity)]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) and, if asked for, ids of every piece."""

    def make():
        encode = encoder(vocabulary)

        def work(batch):
            out = []
            for i, text in batch:
                ids = np.array(encode(text or "") + [END_ID], "<u4")
                for k, (start, n) in enumerate(cuts(len(ids), capacity)):
                    part = ids[start : start + n]
                    out.append((i, k, start, n, zlib.crc32(part.tobytes()), *([part.tolist()] if with_ids else [])))
            return out

        return work

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return map_rows(docs.select(F.col(id_col).cast("long"), F.col(text_col)), make, schema, 256)


class Tightest:
    """Segment tree over remaining capacities: the smallest one of at least n that has an open sequence."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.size)

    def mark(self, room: int, there: bool) -> None:
        i = room + self.size
        self.open[i] = there
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def at_least(self, n: int) -> int | None:
        i = n + self.size
        while not self.open[i]:
            while i & 1:  # a right child: nothing further right below this parent
                i //= 2
            if i == 0:
                return None
            i += 1
        while i < self.size:
            i = 2 * i if self.open[2 * i] else 2 * i + 1
        return i - self.size


def best_fit(lengths: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first, n, sequence, offset): pieces first.. of a length go to sequences sequence.. at offset."""
    tree, room, out, bins = Tightest(capacity), defaultdict(list), [], 0

    def put(left: int, first: int, n: int) -> None:
        if n and left:
            room[left].append((first, n))
            tree.mark(left, True)

    for length in sorted(lengths, reverse=True):
        left, rank = lengths[length], 0
        while left:
            space = tree.at_least(length)
            if space is None:
                space, each = capacity, capacity // length
                first, n = bins, -(-left // each)
                bins += n
            else:
                first, n = room[space].pop()
                if not room[space]:
                    tree.mark(space, False)
                each = space // length
            full = min(n, left // each)
            for j in range(each if full else 0):
                out.append((length, rank, full, first, capacity - space + j * length))
                rank += full
            left -= full * each
            put(space - each * length, first, full)
            if full < n:
                for j in range(left):
                    out.append((length, rank, 1, first + full, capacity - space + j * length))
                    rank += 1
                put(space - left * length, first + full, 1)
                put(space, first + full + 1, n - full - 1)
                left = 0
    return out


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """parts with sequence_id and offset; it has a column length, from 1 to capacity.

    parts is checkpointed first, as its rows are read twice.
    """
    rows = cut(parts.withColumn("__uid", F.monotonically_increasing_id()))
    lengths = {int(r["length"]): r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = np.array(best_fit(lengths, capacity) or np.zeros((0, 5)), np.int64).reshape(-1, 5)
    key = plan[:, 0] << 44 | plan[:, 1]
    order = np.argsort(key)
    key, plan = key[order], plan[order]
    each = F.lit([-(-lengths.get(n, 1) // PER_BUCKET) for n in range(capacity + 1)])
    ranked = numbered(rows, ["length"], F.xxhash64("__uid"), [F.col("__uid")], F.get(each, F.col("length").cast("int")), "__rank").drop("__uid")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema), "sequence_id long", "offset long"])
    names = parts.columns

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64)
            length, rank = get("length"), get("__rank")
            at = np.searchsorted(key, length << 44 | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(plan[at, 3] + rank - plan[at, 1]), pa.array(plan[at, 4])],
                names=[*names, "sequence_id", "offset"],
            )

    return ranked.mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids, offsets) of pieces that were packed with their ids; at most capacity ids a row."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    return parts.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("offsets"))
