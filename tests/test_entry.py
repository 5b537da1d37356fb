"""Driver contract: entry() runs on sf0.001; every query has an oracle and runs there."""

import pytest

import __spark_entry__ as E
from classledger.plans.catalog import QUERIES

from .conftest import SF_SMALL


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "matched" in df.columns


def test_every_query_has_oracle():
    assert set(QUERIES) <= set(E.queries())
    assert set(QUERIES) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs_small(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    assert df.count() >= 0
    assert len(set(df.columns)) == len(df.columns)
