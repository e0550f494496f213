"""Every registered query with SQL returns the rows that DuckDB returns."""

import datetime
import decimal
import os

import duckdb
import pytest

import factloom.plans.evidence  # registers its queries, and those it builds on
from factloom.plans.queries import QUERIES, SQL

DATA = os.environ.get("FACTLOOM_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the generated tables are not here")


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, decimal.Decimal, float)):
        return round(float(x), 6)
    return x.isoformat() if isinstance(x, (datetime.date, datetime.datetime)) else x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    want = duck.execute(SQL[name]).fetchall()
    columns = [d[0] for d in duck.description] if hasattr(duck, "description") else df.columns
    assert sorted(df.columns) == sorted(columns)
    got = rows_of(df.columns, df.collect())
    assert got == rows_of(columns, want)
    assert got, "an empty result shows nothing"
