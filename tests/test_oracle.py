"""Every registered query against its DuckDB oracle on sf0.001.

The same comparison the round check runs at sf0.01: row count, column
names and an order-insensitive hash of the values.
"""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from alertlens.plans.catalog import QUERIES as CATALOG
from tests.conftest import SF001
from tools.compare_oracle import TABLES, digest

QUERIES = entry.queries()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF001}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    yield c
    c.close()


def test_every_query_has_an_oracle():
    # the removable part has queries beyond SQL, which its own tests cover
    assert set(CATALOG) <= set(SQL) <= set(QUERIES)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["year_creation", "mth_creation", "dt_creation", "NAME", "Count"]
    assert df.count() == 1140


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF001)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(SQL[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows) == digest(ocols, orows)
