"""Every registered query equals its DuckDB oracle on the small driver tables (the driver's gate)."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from loadgrid.plans import driver_queries
from tools.oracle_check import TABLES, compare

SF = os.environ.get("LOADGRID_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF, f"{t}.parquet")
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_query_has_oracle():
    missing = set(driver_queries.QUERIES) - set(driver_queries.ORACLE)
    assert not missing, missing


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and len(df.columns) > 0


@pytest.mark.parametrize("name", sorted(driver_queries.QUERIES))
def test_query_matches_oracle(spark, con, name):
    ok, msg, _ = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF)
    assert ok, "\n".join(map(str, msg))
