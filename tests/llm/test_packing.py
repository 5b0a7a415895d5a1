import random
import zlib
from collections import Counter

import numpy as np
import pytest

from loomline.llm import packing


def plain_best_fit(lengths, capacity):
    """Document by document: the tightest open bin, else a new one."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(bins) if room >= n]
        if fits:
            i = min(fits, key=lambda k: bins[k])
            bins[i] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(12))
def test_runs_give_the_packing_of_single_documents(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 100])
    lengths = [rng.randint(1, capacity) if rng.random() < 0.7 else rng.choice([1, 2, capacity // 3]) for _ in range(rng.randint(1, 300))]
    rooms, spans = {}, {}
    for length, first, n, seq, offset in packing.best_fit(Counter(lengths), capacity):
        for k in range(n):
            spans.setdefault(seq + k, []).append((offset, length))
    for seq, parts in spans.items():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
        rooms[seq] = capacity - end
    assert sorted(rooms.values()) == plain_best_fit(lengths, capacity)
    assert Counter(length for parts in spans.values() for _, length in parts) == Counter(lengths)


def test_runs_do_not_grow_with_the_data():
    rng = np.random.default_rng(1)
    share = rng.dirichlet(np.ones(2048))
    small, large = ({k + 1: max(1, int(p * n)) for k, p in enumerate(share)} for n in (10**6, 10**10))
    assert len(packing.best_fit(large)) < 3 * len(packing.best_fit(small)) < 3_000_000


def test_pieces_and_places(docs):
    got = packing.pack(packing.pieces(docs, with_ids=True), 2048)
    rows = got.collect()
    encode = packing.encoder()
    want = Counter()
    for r in docs.collect():
        ids = encode(r.text or "") + [0]
        for k, (start, n) in enumerate(packing.cuts(len(ids))):
            want[(r.doc_id, k, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        assert [o for o, _ in sorted(parts)] == list(np.cumsum([0] + [n for _, n in sorted(parts)])[:-1])
    full = packing.sequences(got).collect()
    assert sum(len(r.ids) for r in full) == sum(r.length for r in rows) and max(len(r.ids) for r in full) <= 2048


def test_cuts():
    assert packing.cuts(5, 10) == [(0, 5)]
    assert packing.cuts(20, 10) == [(0, 10), (10, 10)]
    assert packing.cuts(23, 10) == [(0, 3), (3, 10), (13, 10)]


def test_ids_equal_the_tokenizers_file():
    import public_tokenizers
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.encoder()
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}b 1{chr(c)}! {chr(c)}" for c in points[k : k + 64]) for k in range(0, len(points), 64)]
    texts += ["x<|endoftext|> y", "", "  \n\n  a", "don't can't I'LL"]
    assert [e.ids for e in known.encode_batch(texts, add_special_tokens=False)] == [encode(t) for t in texts]


@pytest.fixture(scope="module")
def known():
    import public_tokenizers
    from tokenizers import Tokenizer

    return lambda texts: [e.ids for e in Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("space", [" ", "\t", "\n", "\u00a0", "\r\n", " \u00a0"])
def test_long_white_space_has_the_ids_of_the_tokenizers_file(known, space):
    run = space * (1_000_200 // len(space))
    texts = [run, f"some words{run}and more", f"a{run}<|endoftext|>{run[:70_000]} b", f"{run[:60_001]}!"]
    encode = packing.encoder()
    for text, want in zip(texts, known(texts)):
        assert encode(text) == want


def test_blocks_of_a_run_join_to_the_ids_of_the_run():
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    single = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
    token, rng = {v: k for k, v in ranks.items()}, random.Random(8)
    for _ in range(200):
        kinds = rng.choice([" \n", " \n\t\r", "\u00a0 ", "\u00a0", "\u2003\u3000 \u0085\n", "\n"])
        piece = "".join(rng.choices(kinds, k=rng.randint(1, 3000))).encode()
        assert packing.run_ids(piece, single, token, rng.choice([70, 300, 1000])) == single(piece)


def test_long_white_space_is_packed(spark):
    docs = spark.createDataFrame([(1, " "), (2, "\u00a0"), (3, "x")], "doc_id long, c string").selectExpr("doc_id", "if(doc_id < 3, repeat(c, 1000000 + int(doc_id)), c) AS text")
    rows = packing.pack(packing.pieces(docs)).collect()
    encode = packing.encoder()
    for i, text in ((1, " " * 1_000_001), (2, "\u00a0" * 1_000_002), (3, "x")):
        ids = [*encode(text), 0]
        own = sorted((r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == i)
        assert own == [(s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for s, n in packing.cuts(len(ids))]


def test_starts_of_numbers_are_few(spark):
    """One a length and PER_BUCKET rows, not one a row."""
    parts = spark.range(60_000).selectExpr("id AS doc_id", "int(id % 3) * 5 + 1 AS length")
    rows = packing.pack(parts)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window") == 2
    got = rows.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert max(r[1] for r in got) <= 2048 and sum(r[1] for r in got) == 20_000 * (1 + 6 + 11)


def test_empty(no_docs):
    assert packing.pack(packing.pieces(no_docs)).count() == 0
