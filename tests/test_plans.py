"""Plan shapes that the scale design relies on (read from ``explain``)."""

import contextlib
import io

import __spark_entry__ as E
from classledger.plans.catalog import QUERIES

from .conftest import SF_ORACLE


def plan(df, mode="formatted"):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def test_grade_merge_streams_students_past_a_broadcast(spark):
    p = plan(E.queries()["grade_merge"](spark, SF_ORACLE), "simple")
    top_join = next(line for line in p.splitlines() if "Join" in line)
    assert "BroadcastHashJoin" in top_join and "LeftOuter" in top_join
    assert "SortMergeJoin" not in p


def test_class_counts_aggregates_partially_before_the_shuffle(spark):
    p = plan(E.queries()["class_counts"](spark, SF_ORACLE), "simple")
    assert "partial_count" in p


def test_positions_slice_only_hot_groups(spark):
    from pyspark.sql import functions as F
    from classledger.operators.ranking import positions_within
    from classledger.sources import driver_tables as D
    # every roster group is small: a plain window, no slices
    p = plan(positions_within(D.rosters(spark, SF_ORACLE), ["account", "class_name"], ["ord"]), "simple")
    assert "Window" in p and "rangepartitioning" not in p
    # one hot class: its rows are read back from the written slices
    df = D.rosters(spark, SF_ORACLE).withColumns({
        "account": F.lit("one"),
        "class_name": F.when(F.col("ord") % 3 == 0, F.lit("HOT")).otherwise(F.col("class_name"))})
    p = plan(positions_within(df, ["account", "class_name"], ["ord"], min_hot_rows=10), "simple")
    assert "Union" in p and "_slice" in p


def test_search_term_reaches_the_plan_as_a_literal(spark):
    p = plan(E.queries()["student_search"](spark, SF_ORACLE), "simple")
    assert "mer#0000001" in p          # lower(term) folded at plan time
    assert "PythonUDF" not in p and "BatchEvalPython" not in p


def test_scans_read_only_needed_columns(spark):
    p = plan(E.queries()["class_counts"](spark, SF_ORACLE), "simple")
    customer_scans = [line for line in p.splitlines() if "customer.parquet" in line]
    assert customer_scans and all("c_name" not in line and "c_acctbal" not in line for line in customer_scans)


PYTHON_NODES = ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "MapInArrow", "MapInPandas", "FlatMapGroupsIn", "PythonDataSource")


def test_no_python_in_any_registered_query(spark):
    for name, fn in QUERIES.items():
        p = plan(fn(spark, SF_ORACLE), "simple")
        assert not [n for n in PYTHON_NODES if n in p], name
