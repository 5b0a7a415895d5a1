"""Every registered query against its SQL on the smallest tables, and the driver contract."""

import subprocess
import sys

import duckdb
import pandas as pd
import pytest

from loomline import catalogue

from .conftest import ROOT

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return db


def cells(frame: pd.DataFrame) -> list[tuple]:
    shown = lambda v: None if pd.isna(v) else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) or "int" in type(v).__name__ or "float" in type(v).__name__ else str(v)
    return sorted((tuple(map(shown, r)) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(catalogue.ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(got) == cells(want)


def test_contract_without_a_session():
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and callable(e.entry); print(len(q))"
    assert int(subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout) >= 80


def test_nothing_outside_imports_the_corpus_package():
    import pathlib

    for path in pathlib.Path(ROOT, "loomline").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path


#: Documents as no given table has them: blank and missing titles, missing sources and ids, ids below zero, letters that engines may lower or normalize unlike.
ODD = {
    "titles": "SELECT i AS doc_id, ['', '  ', NULL, '?!', 'Title ' || i % 40][i % 5 + 1] AS text, 'src' || i % 20 AS source FROM range(3000) t(i)",
    "sources": "SELECT i AS doc_id, 'Title ' || i % 40 AS text, CASE WHEN i % 3 > 0 THEN 'src' || i % 20 END AS source FROM range(3000) t(i)",
    "ids": "SELECT CASE WHEN i % 7 > 0 THEN i - 1500 END AS doc_id, 'Title ' || i % 40 AS text, 'src' || i % 20 AS source FROM range(3000) t(i)",
    "letters": "SELECT i AS doc_id, ['ﬁne', 'fine', 'x²', 'x2', 'İl', 'il', 'i l', 'ΟΔΟΣ', 'οδος', 'οδοσ', 'a b', 'A b'][i % 12 + 1] AS text, 'src' || i % 20 AS source FROM range(3000) t(i)",
}


@pytest.fixture(params=sorted(ODD))
def odd(request, tmp_path):
    """(folder, database) of the smallest tables with odd documents."""
    db = duckdb.connect()
    db.execute(f"COPY (SELECT *, 'en' AS lang, length(coalesce(text, '')) AS n_chars FROM ({ODD[request.param]})) TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    for t in TABLES:
        if t != "documents":
            (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet')")
    return str(tmp_path), db


def test_cleaning_of_odd_documents_equals_sql(spark, odd):
    folder, db = odd
    got = catalogue.QUERIES["cleaning_stages"](spark, folder).toPandas()
    assert cells(got) == cells(db.execute(catalogue.ORACLE_SQL["cleaning_stages"]).fetchdf())


def test_data_flow_of_odd_documents_equals_sql(spark, odd):
    folder, db = odd
    got = catalogue.QUERIES["data_flow"](spark, folder).toPandas()
    assert cells(got) == cells(db.execute(catalogue.ORACLE_SQL["data_flow"]).fetchdf())


def test_data_flow_without_event_types_equals_sql(spark, tmp_path):
    db = duckdb.connect()
    db.execute(f"COPY (SELECT * REPLACE (CASE WHEN event_id % 11 > 0 THEN event_type END AS event_type) FROM '/root/testdata/sf0.01/events.parquet') TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    (tmp_path / "documents.parquet").symlink_to(f"{SF}/documents.parquet")
    for t in ("events", "documents"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet')")
    got = catalogue.QUERIES["data_flow"](spark, str(tmp_path)).toPandas()
    assert cells(got) == cells(db.execute(catalogue.ORACLE_SQL["data_flow"]).fetchdf())
