"""Training-data queries with SQL give DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest

from fathom.llm import queries

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    df, want = queries.QUERIES[name](spark, D), c.sql(queries.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = want.columns
    assert sorted(map(str, (tuple(r[k] for k in order) for r in df.collect()))) == sorted(map(str, want.fetchall()))
