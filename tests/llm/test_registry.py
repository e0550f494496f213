import os

import duckdb
import pytest

from factloom.llm.registry import QUERIES, SQL

DATA = os.environ.get("FACTLOOM_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the generated tables are not here")


def test_every_operator_is_registered():
    assert sorted(q.split("_")[0] for q in QUERIES) == sorted([*(f"op{n}" for n in range(1, 14)), "pipeline"])


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for view in ("documents", "embeddings"):
        duck.execute(f"CREATE VIEW {view} AS SELECT * FROM '{DATA}/{view}.parquet'")
    df = QUERIES[name](spark, DATA)
    found = duck.execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, found.fetchall()))
