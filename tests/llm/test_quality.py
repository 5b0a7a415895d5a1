import re
from collections import Counter

import numpy as np
import pytest

from loomline.llm import quality


def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = set()
    for i, w in enumerate(zip(words, words[1:], words[2:])):
        if windows[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


@pytest.mark.parametrize("text", [None, "", "a", "a b", "a a a", "a a a a", "a b c a b c", "x\nx\n\n\nx y\nx", "#*$ %&|<>\n \n \n", "p q r s p q r s t p q", "é ü\x0b中 文\r\nx"])
def test_base_measures(text):
    assert quality.base_measures(text) == plain_measures(text)


def test_base_measures_of_random_texts():
    rng = np.random.default_rng(0)
    for _ in range(60):
        text = " ".join(rng.choice(["a", "b", "c", "dd", "\n", "#"], rng.integers(0, 60)))
        assert quality.base_measures(text) == plain_measures(text)


def test_fertility():
    measure = quality.Fertility()
    tokens, share, entropy = measure("the the the the")
    assert tokens == 4 and share == 0 and entropy == 0
    assert measure("\U00013000" * 10)[1] > 0.7
    assert measure("") == (0, 0.0, 0.0)
    long = "several words of text " * 9000
    assert abs(measure(long)[0] - len(measure.model.encode(long))) <= 4


def test_blocks_cover_the_text():
    for text in ("", "a b", "x" * 1000, "word " * 300):
        assert "".join(quality.blocks(text, 64)) == text


GOOD = (
    "The river ran high that spring and the people of the valley moved their boats to the upper landing, where an old stone wall kept the water back. "
    "Every evening someone walked along it with a lamp, looking for new cracks, and in the morning the children brought clay and straw to fill them. "
    "By the end of May the flood had gone and nobody spoke of it again until the next year."
)


def test_verdicts(spark):
    rows = [
        (1, GOOD, "en"),
        (2, GOOD, None),
        (3, " ".join(w + "%%%" for w in GOOD.split()), "en"),
        (4, "short text", "en"),
        (5, "again and again " * 60, "en"),
        (6, GOOD.upper().replace(" ", "!! "), "en"),
        (7, None, "en"),
        (8, "река текла широко и люди из долины увели лодки выше по течению где старая каменная стена держала воду каждый вечер кто нибудь шёл вдоль неё с лампой искал новые трещины а утром дети носили глину и солому чтобы их заделать к концу мая вода ушла и до следующего года никто о ней больше не вспоминал совсем", "ru"),
    ]
    got = {r.doc_id: r for r in quality.assess(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert {k: v.kept for k, v in got.items()} == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False, 7: False, 8: True}
    assert {k for k, v in got.items() if v.base_failed} == {4, 5, 7}


def test_held_out_labels(spark):
    """On the given labels nearly all good documents that pass the base rule stay, and most symbol noise goes."""
    path = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    rows = quality.assess(docs).join(labels, "doc_id").filter("not base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.7


def test_edge_cases(docs, no_docs):
    rows = quality.assess(docs).collect()
    assert len(rows) == docs.count()
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in rows)
    assert quality.assess(no_docs).count() == 0
