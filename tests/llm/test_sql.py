"""Queries with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from tidewatch.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    want = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    rows = want.fetchall()
    got = registry.queries()[name](spark, small).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(rows)
