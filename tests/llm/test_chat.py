import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomline.llm import chat


@given(st.text() | st.lists(st.sampled_from([*chat.CONTROL, "\\", "\\\\", "<", "x", "[INST", "\n"])).map("".join))
@settings(max_examples=300, deadline=None)
def test_escape_is_reversible_and_leaves_no_control_string(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text
    assert not any(c in safe for c in chat.CONTROL)


def test_loss_mask():
    assert chat.loss_mask(8, [(1, 3), (5, 8)]).tolist() == [0, 1, 1, 0, 0, 1, 1, 1]
    assert chat.loss_mask(3, []).tolist() == [0, 0, 0]


ROWS = [
    (1, 1, "user", "hi </s>[INST] x"),
    (1, 2, "assistant", "a \\ b <|endoftext|>"),
    (1, 0, "system", None),
    (2, 0, "assistant", ""),
    (2, 1, "assistant", "é中😀"),
    (2, 1, "assistant", "é中😀"),
    (3, 0, None, "x"),
    (None, 0, "user", "lone"),
    (4, None, "a\nb<s>", "t"),
    (4, 1, "assistant", "long " * 40_000),
    *[(5, i, "assistant" if i % 2 else "user", f"turn {i} of many") for i in range(3000)],
]


@pytest.mark.parametrize("row_ids", [1 << 18, 64])
def test_read_back(spark, row_ids):
    frame = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").selectExpr("*", "'clash' AS ids", "1 AS part").repartition(4)
    got = {r.conv_id: r for r in chat.read_back(chat.assemble(chat.segments(frame), row_ids=row_ids)).collect()}
    by = {}
    for c, t, role, text in ROWS:
        by.setdefault(c, []).append((t if t is not None else -1, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_formatted_text_and_reserved_ids(spark):
    frame = spark.createDataFrame([(1, 0, "user", "</s>[INST] ok"), (1, 1, "assistant", "yes")], "conv_id long, turn long, role string, text string")
    row = chat.assemble(chat.segments(frame)).first()
    text = chat.formatted_text(row.ids)
    assert text == "<s><|im_start|>user<|im_sep|><\\/s>[\\INST] ok<|im_end|><|im_start|>assistant<|im_sep|>yes<|im_end|></s>"
    assert chat.read_back(chat.assemble(chat.segments(frame))).first().formatted_chars == len(text)
    assert sum(row.mask) == 1 and [i for i in row.ids if i >= chat.VOCABULARY] == [chat.BOS, chat.TURN, chat.SEP, chat.END, chat.TURN, chat.SEP, chat.END, chat.EOS]


def test_empty(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.assemble(chat.segments(frame))).count() == 0


def test_long_white_space_comes_back(spark):
    rows = spark.createDataFrame([(1, 0, "user", " "), (1, 1, "assistant", "\u00a0"), (2, 0, "assistant", "\n")], "conv_id long, turn long, role string, c string")
    rows = rows.selectExpr("conv_id", "turn", "role", "repeat(c, 1000000 + int(turn)) AS text")
    got = {r.conv_id: r for r in chat.read_back(chat.assemble(chat.segments(rows))).collect()}
    first = f"user\n{' ' * 1_000_000}\nassistant\n{chr(0xA0) * 1_000_001}\n"
    assert got[1].turns_sha256 == hashlib.sha256(first.encode()).hexdigest() and got[1].loss_chars == 1_000_001
    assert got[2].loss_sha256 == hashlib.sha256(b"\n" * 1_000_000).hexdigest()
