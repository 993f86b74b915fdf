"""Every query of the package gives the rows of its SQL twin."""

import duckdb
import pytest
from conftest import DATA

from riskloom import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.twins()))
def test_twin(spark, duck, name):
    df = plans.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    mine = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    theirs = duck.sql(plans.twins()[name])
    at = [theirs.columns.index(c) for c in cols]
    assert len(theirs.columns) == len(cols)
    assert mine == sorted((tuple(r[i] for i in at) for r in theirs.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.twins())))
def test_rows(spark, name):
    assert plans.queries()[name](spark, DATA).count() > 0
