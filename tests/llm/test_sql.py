"""The queries that SQL can express, against DuckDB on the small tables."""

import collections

import duckdb
import pytest

from lectern.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, sf_dir, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    df, told = QUERIES[name](spark, sf_dir), con.sql(ORACLE[name])
    names = sorted(df.columns)
    assert names == sorted(told.columns)
    bag = lambda columns, rows: collections.Counter(tuple(r[columns.index(n)] for n in names) for r in rows)
    assert bag(df.columns, df.collect()) == bag(told.columns, told.fetchall())
