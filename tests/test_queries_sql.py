"""Every registered query with SQL gives the same rows, names and types as the SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
import check_sql

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check_sql.TABLES:
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, con, name):
    text, _, _, _ = check_sql.compare(spark, con, FOLDER, name)
    assert text.startswith("ok"), text


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert set(df.columns) == {"doc_id", "split", "text", "label_id", "unseen_label"}
    assert df.count() > 0


@pytest.mark.parametrize(
    "name", ["html_to_text", "contraction_expand", "split_glued_words", "baseline_text_chain"]
)
def test_text_queries_without_sql_keep_every_row(spark, name):
    out = entry.queries()[name](spark, FOLDER)
    table = "pages" if name == "html_to_text" else "documents"
    assert out.count() == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()
