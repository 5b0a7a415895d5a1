"""Chat formatting by token-level assembly.

Every segment (a turn's role, a turn's text) is escaped and encoded on its own, before conversations are brought
together; reserved ids, which no text can produce, are spliced in around them. The loss mask is the prefix sum of +1 at
the start and -1 behind the end of each assistant text. Control strings in a text are escaped by a backslash behind
their first character, and backslashes are doubled, so that `unescape` gives the text back.

    BOS  (TURN role SEP text END)*  EOS

Rows of a conversation are taken by turn, then role and a hash of the text. A conversation is streamed in rows of about ROW_IDS
ids, numbered by `part`, so that a very long one never is in memory at once.

Defined results: null texts and roles are empty; repeated rows are turns of their own; null turns come first; rows
without a conversation id form one conversation; an empty table gives an empty result; a very long text, of white space
or anything else, is one turn of one row; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows
from .packing import encoder

VOCABULARY = 50257
#: Reserved ids and how the formatted text shows them.
BOS, EOS, TURN, SEP, END = range(VOCABULARY, VOCABULARY + 5)
SHOWN = {BOS: "<s>", EOS: "</s>", TURN: "<|im_start|>", SEP: "<|im_sep|>", END: "<|im_end|>"}
#: Strings that templates use as control marks.
CONTROL = (
    "<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_sep|>", "<|im_end|>",
    "<|endoftext|>", "<|startoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|begin_of_text|>", "<|end_of_text|>",
    "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>",
)
ROW_IDS = 1 << 18
#: Ids that are looked up at once.
DECODED = 1 << 16
_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True)))
_SLASHES = re.compile(r"\\+")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    """The text that escape was given: a lone backslash was put in, others were doubled."""
    return _SLASHES.sub(lambda m: "\\" * (len(m[0]) // 2), text)


def segments(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, tie, role_ids, text_ids): each segment encoded on its own, ids as 16-bit numbers.

    Texts themselves stay behind: tie, a hash of the text, orders turns that are equal otherwise.
    """
    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), tie.alias("tie"), "text")

    def make():
        encode = encoder()
        pack = lambda text: np.array(encode(escape(text)), "<u2").tobytes()

        def work(batch):
            return [(c, t, r, x, pack(r), pack(text or "")) for c, t, r, x, text in batch]

        return work

    return map_rows(rows, make, "conv_id long, turn long, role string, tie long, role_ids binary, text_ids binary", 512)


def loss_mask(length: int, spans: list[tuple[int, int]]) -> np.ndarray:
    """1 inside the spans [start, end), as prefix sums of their edges."""
    edge = np.zeros(length + 1, np.int32)
    for start, end in spans:
        edge[start] += 1
        edge[end] -= 1
    return np.cumsum(edge[:-1], dtype=np.int32).astype(np.int8)


def assemble(encoded: DataFrame, learn_from: str = "assistant", row_ids: int = ROW_IDS) -> DataFrame:
    """(conv_id, part, last, ids, mask) rows of segments(), a conversation's rows in order of part."""
    ordered = encoded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "tie").select("conv_id", "role", "role_ids", "text_ids")
    schema = "conv_id long, part int, last boolean, ids array<int>, mask array<tinyint>"
    arrow = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("last", pa.bool_()), ("ids", pa.list_(pa.int32())), ("mask", pa.list_(pa.int8()))])
    bos, eos, turn, sep, end = (np.array([i], "<u2").tobytes() for i in (BOS, EOS, TURN, SEP, END))

    class Row:
        def __init__(self, conv, part: int, first: bytes):
            self.conv, self.part, self.ids, self.size, self.spans = conv, part, [first], len(first) // 2, []

        def add(self, role: str, role_ids: bytes, text_ids: bytes) -> None:
            start = self.size + 2 + len(role_ids) // 2
            stop = start + len(text_ids) // 2
            if role == learn_from:
                self.spans.append((start, stop))
            self.ids += [turn, role_ids, sep, text_ids, end]
            self.size = stop + 1

        def done(self, last: bytes = b"") -> tuple:
            ids = np.frombuffer(b"".join([*self.ids, last]), "<u2").astype(np.int32)
            return self.conv, self.part, bool(last), ids, loss_mask(len(ids), self.spans)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Row | None = None
        out, held = [], 0
        for batch in batches:
            for conv, role, role_ids, text_ids in zip(*(c.to_pylist() for c in batch.columns)):
                if now is not None and conv != now.conv:
                    out.append(now.done(eos))
                    held, now = held + now.size, None
                if now is None:
                    now = Row(conv, 0, bos)
                elif now.size >= row_ids:
                    out.append(now.done())
                    held, now = held + now.size, Row(conv, now.part + 1, b"")
                now.add(role, role_ids, text_ids)
                if held >= ROW_IDS:
                    yield packed(out)
                    out, held = [], 0
        if now is not None:
            out.append(now.done(eos))
        if out:
            yield packed(out)

    return ordered.mapInArrow(run, schema)


def decoder(path: str | None = None):
    """ids of the vocabulary -> text."""
    import base64

    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        token = {int(b): base64.b64decode(a) for a, b in map(bytes.split, file)}
    part = lambda ids: b"".join([token[i] for i in ids.tolist()])
    return lambda ids: b"".join(part(ids[k : k + DECODED]) for k in range(0, len(ids), DECODED)).decode()


def parse(ids: np.ndarray, mask: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(role ids, text ids, text ids under the mask) of each turn in a row of assemble()."""
    for start, middle, stop in zip(*(np.flatnonzero(ids == mark).tolist() for mark in (TURN, SEP, END))):
        text = ids[middle + 1 : stop]
        yield ids[start + 1 : middle], text, text[mask[middle + 1 : stop] != 0]


def read_back(rows: DataFrame) -> DataFrame:
    """Digests of each conversation, from the ids and masks of assemble() alone, in its partitions and order."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode, state = decoder(), None
        for batch in batches:
            conv, part, last = (batch.column(k).to_pylist() for k in range(3))
            ids, mask = (batch.column(k).flatten().to_numpy() for k in (3, 4))
            edges = np.concatenate(([0], np.cumsum(pa.compute.list_value_length(batch.column(3)).to_numpy())))
            out = []
            for k in range(batch.num_rows):
                own, learnt_here = ids[edges[k] : edges[k + 1]], mask[edges[k] : edges[k + 1]]
                if part[k] == 0:
                    state = [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, learnt in parse(own, learnt_here):
                    role_text, shown = decode(role), decode(text)
                    state[0] += 1
                    state[1].update(f"{unescape(role_text)}\n{unescape(shown)}\n".encode())
                    if len(learnt):
                        loss = unescape(decode(learnt))
                        state[2] += len(loss)
                        state[3].update(loss.encode())
                    state[4] += len(role_text) + len(shown)
                state[4] += sum(len(s) * int(np.count_nonzero(own == i)) for i, s in SHOWN.items())
                if last[k]:
                    out.append((conv[k], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
            if out:
                names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return rows.mapInArrow(run, schema)


def formatted_text(ids: list[int]) -> str:
    """The ids as text, reserved ones shown by their strings."""
    decode, out, plain = decoder(), [], []
    for i in ids:
        if i in SHOWN:
            out += [decode(np.array(plain, np.int64)), SHOWN[i]]
            plain = []
        else:
            plain.append(i)
    return "".join([*out, decode(np.array(plain, np.int64))])
