"""Every query with SQL gives the same rows as DuckDB."""

import duckdb
import pytest

from lodestone.plans import catalogue, workflow

QUERIES = catalogue.QUERIES | workflow.QUERIES
ORACLES = catalogue.ORACLES | workflow.ORACLES

TABLES = "documents embeddings pages benchmark labels conversations events".split()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equal_to_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = QUERIES[name](spark, sf)
    want = con.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda found: sorted(map(repr, found))
    assert rows(map(tuple, got.select(*columns).collect())) == rows(con.sql(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall())
