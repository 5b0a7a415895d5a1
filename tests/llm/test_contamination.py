import numpy as np
import pytest

from loomline.llm import contamination as D
from loomline.llm.queries import ORACLE_SQL, QUERIES

from ..test_queries import SF, cells, duck  # noqa: F401

ITEMS = "item_id long, text string"


def brute(docs, items, window):
    """{doc_id: (n_words, hit positions, items)} by comparing all windows; texts of distinct ids."""
    out = {}
    for doc, text in docs:
        seq, hit, found = D.words(text), set(), set()
        for item, passage in items:
            run = D.words(passage)
            m = min(window, len(run))
            grams = {tuple(run[k : k + m]) for k in range(len(run) - m + 1)} if run else set()
            for k in range(len(seq) - m + 1):
                if tuple(seq[k : k + m]) in grams:
                    hit |= set(range(k, k + m))
                    found |= {str(item)} - {"None"}
        out[doc] = (len(seq), hit, sorted(found))
    return out


def told(df):
    return {r.doc_id: (r.n_words, {k for a, b in r.spans for k in range(a, b)}, list(r["items"])) for r in df.collect()}


def random_case(seed, letters=4):
    rng = np.random.default_rng(seed)
    text = lambda n: " ".join(f"w{c}" for c in rng.integers(0, letters, n))
    return [(i, text(int(rng.integers(0, 60)))) for i in range(40)], [(i, text(int(rng.integers(0, 12)))) for i in range(15)]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("block_words, piece", [(200_000, 2_000), (25, 5)])
def test_equals_comparing_all_windows(spark, monkeypatch, seed, block_words, piece):
    monkeypatch.setattr(D, "PIECE", piece)
    docs, items = random_case(seed)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert told(D.matches(frame, spark.createDataFrame(items, ITEMS), 4, block_words)) == brute(docs, items, 4)


@pytest.mark.parametrize("seed", range(30))
def test_longest_runs_equal_brute_force(seed):
    docs, items = random_case(seed, 3)
    one = D.Automaton([(str(i), D.words(t)) for i, t in items], 5)
    assert len(one.length) <= 2 * sum(len(D.words(t)) for _, t in items) + 1
    runs = {tuple(w[a:b]) for _, t in items for w in [D.words(t)] for a in range(len(w)) for b in range(a, len(w) + 1)}
    for _, text in docs:
        seq = D.words(text)
        assert one.scan(seq)[2] == max((b - a for a in range(len(seq)) for b in range(a, len(seq) + 1) if tuple(seq[a:b]) in runs), default=0)


def test_words_and_odd_rows(spark):
    assert D.words("It's A-1\x00ÄÖ 中文_x\tÀ") == [w.encode() for w in ("it", "s", "a", "1", "ÄÖ", "中文", "x", "À")]
    long = " ".join(f"x{i % 977}" for i in range(100_000))
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, None), (2, ""), (3, f"{long} {item.upper()} {long}"), (3, f"{long} {item.upper()} {long}"), (None, item), (4, "!!! ..."), (5, "seven eight")]
    items = [(1, item), (1, item), (2, item), (None, item), (None, None), (3, ""), (4, "Seven, eight!")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'clash' AS found", "1 AS row", "2 AS n_words", "3 AS item_id")
    got = sorted(D.matches(frame, spark.createDataFrame(items, ITEMS).selectExpr("*", "1 AS n", "2 AS run")).collect(), key=str)
    seen = [(r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.longest) for r in got]
    assert seen == [(1, 0, 0, [], 0), (2, 0, 0, [], 0), (3, 200_011, 11, ["1", "2", "4"], 11), (3, 200_011, 11, ["1", "2", "4"], 11), (4, 0, 0, [], 0), (5, 2, 2, ["4"], 2), (None, 11, 11, ["1", "2", "4"], 11)]
    kept = D.clean(frame, spark.createDataFrame(items, ITEMS))
    assert kept.columns == frame.columns
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert set(texts) == {1, 2, 3, 4} and texts[3] == f"{long}  {long}" and texts[1] is None and texts[4] == "!!! ..."


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([], ITEMS)
    assert told(D.matches(docs, none)) == {1: (3, set(), [])}
    assert D.matches(docs.limit(0), none).count() == 0 and D.clean(docs, none).collect() == docs.collect()


def test_query_equals_sql(spark, duck):  # noqa: F811
    got, want = QUERIES["op13_decontamination"](spark, SF).toPandas(), duck.execute(ORACLE_SQL["op13_decontamination"]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and cells(got) == cells(want)
