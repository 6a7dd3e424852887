"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from checks.compare import _bag
from checks.queries import ORACLES, QUERIES
from checks.views import TABLES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    left = _bag(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(ORACLES[name])
    right = _bag([d[0] for d in cur.description], cur.fetchall())
    assert left[0] == right[0]
    assert left[1] == right[1]


def test_entry(spark):
    from __spark_entry__ import entry, oracle_sql, queries

    assert entry(spark).count() > 0
    assert set(oracle_sql()) <= set(queries())
    assert set(QUERIES) <= set(queries())
