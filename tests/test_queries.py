"""Every registered query against its SQL form on the smallest data folder."""
import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    return str(v) if isinstance(v, decimal.Decimal) else repr(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    result = db.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    places = [names.index(c) for c in cols]
    assert got == sorted(tuple(plain(r[i]) for i in places) for r in result.fetchall())


@pytest.mark.parametrize("name", ["s7_page_texts"])
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["source", "distinct_docs", "readable_docs", "mean_readability"] and df.count() > 0


def test_registry_is_consistent():
    assert set(SQL) <= set(QUERIES)
