"""Every registered query of the catalog equals its DuckDB oracle (sf0.001 here; the driver
checks sf0.01, ``tools/oracle_check.py`` runs any scale)."""

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF001
from tools.oracle_check import TABLES, compare


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(E.QUERIES) == set(E.SQL)


@pytest.mark.parametrize("name", sorted(E.QUERIES))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF001)
    assert r["cols_match"], r
    assert r["spark_rows"] == r["oracle_rows"], r
    assert r["values_match"], r


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["request_id", "client_ip", "request_count", "over_limit", "suspicious", "decision"]
    assert df.count() > 0
