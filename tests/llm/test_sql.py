"""Queries that SQL can express give the rows of their SQL."""

import duckdb
import pytest

from riskloom.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_twin(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    theirs = c.sql(queries.SQL[name])
    at = [theirs.columns.index(x) for x in sorted(df.columns)]
    mine = sorted((tuple(r[x] for x in sorted(df.columns)) for r in df.collect()), key=repr)
    assert mine == sorted((tuple(r[i] for i in at) for r in theirs.fetchall()), key=repr)
