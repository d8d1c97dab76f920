"""Every query of the package against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from pagewright.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("customer", "orders", "lineitem", "part", "events", "documents", "pages", "conversations", "labels", "embeddings")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(map(tuple, frame[columns].astype(object).where(frame[columns].notna(), None).astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_others_give_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_names_of_reserved_words_and_new_marks_as_in_sql(spark, tmp_path):
    """Texts that sanitize_unicode's SQL leaves as they are though a file system reserves them, and marks of format that Java's class hasn't."""
    texts = ["Con.", "NUL", "aux", "con‍", "com1", "x࢐y", "x\U00013439y", "any words", None]
    spark.createDataFrame([(4 * i + k, t) for i, t in enumerate(texts) for k in range(4)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert rows(QUERIES["sanitize_unicode"](spark, str(tmp_path)).toPandas()) == rows(con.sql(ORACLES["sanitize_unicode"]).df())
