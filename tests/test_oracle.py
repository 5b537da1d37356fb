"""Every registered query equals its DuckDB oracle SQL at sf0.01 (rows, schema, values)."""

import pytest

import __spark_entry__ as E
from classledger.plans.catalog import QUERIES
from tools.oracle_check import compare, duckdb_views

from .conftest import SF_ORACLE


@pytest.fixture(scope="module")
def con():
    return duckdb_views(SF_ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, con, name):
    ok, n, m, detail = compare(spark, con, name, SF_ORACLE)
    assert ok, f"{name}: spark {n} rows, oracle {m} rows; {detail}"
