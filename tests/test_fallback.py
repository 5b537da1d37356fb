"""Beyond the broadcast bound the joins fall back to shuffle joins with the same results."""

import contextlib
import io

import pytest

import __spark_entry__ as E
from classledger.operators import joins

from .conftest import SF_ORACLE

NAMES = ["grade_merge", "set_grades", "edit_students", "roster_import", "screen_accounts",
         "delete_students", "add_students"]


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


@pytest.fixture
def no_broadcast(spark, monkeypatch):
    monkeypatch.setattr(joins, "fits_broadcast", lambda *a, **k: False)
    for mod in ("grades", "changes", "ingest", "accounts"):
        m = __import__(f"classledger.operators.{mod}", fromlist=["x"])
        if hasattr(m, "fits_broadcast"):
            monkeypatch.setattr(m, "fits_broadcast", lambda *a, **k: False)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


@pytest.fixture(scope="module")
def expected(spark):
    return {n: rows(E.queries()[n](spark, SF_ORACLE)) for n in NAMES}


def test_fits_broadcast_bounds(spark):
    df = spark.range(100)
    assert joins.fits_broadcast(df, max_rows=100)
    assert not joins.fits_broadcast(df, max_rows=99)
    assert not joins.fits_broadcast(df, max_rows=1000, max_bytes=799)


@pytest.mark.parametrize("name", NAMES)
def test_shuffle_path_matches(spark, expected, no_broadcast, name):
    df = E.queries()[name](spark, SF_ORACLE)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    assert "BroadcastHashJoin" not in buf.getvalue()
    assert rows(df) == expected[name]
