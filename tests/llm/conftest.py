import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with nulls everywhere, copies, repeated rows, a very long text and columns that clash with inner names."""
    words = [f"word{i % 97}x{i % 89}" for i in range(30_000)]
    base = "Some plain words stand here and they form a sentence that nobody wrote before, with enough words to count. " * 3
    rows = [
        (1, base, "en", "a", 1),
        (2, base, "en", "b", 1),
        (3, base, "en", "b", 1),
        (3, base, "en", "b", 1),
        (4, None, "en", "a", None),
        (5, "", None, None, 0),
        (None, "a text without an id", "en", "a", 5),
        (None, None, None, None, None),
        (6, " ".join(words), "en", "a", 9),
        (7, "zwei\n\nzwei\nzwei drei", "de", "c", 9),
        (8, "\x0b\t \r\n", "fr", "c", 9),
        (9, "ÄÖÜ   中文 字 😀 <|endoftext|> x", "zh", "d", 9),
        (10, base + "tail", "en", "d", 1),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for extra in ("fp", "key", "hash", "size", "length", "shard", "slot", "id", "component_id", "__x", "chunk"):
        df = df.selectExpr("*", f"'clash' AS `{extra}`")
    return df.repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
