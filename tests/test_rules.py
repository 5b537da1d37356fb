"""Rules on inputs that the registered tables never hold."""

import pytest

from classledger.functions import final_grade, parse_grade
from classledger.operators import joins
from classledger.operators.accounts import screen_accounts
from classledger.operators.changes import add_classes  # noqa: F401  (import check)
from classledger.operators.grades import set_grades
from classledger.operators.ingest import import_roster

from .fixtures import classes_df, imported


def test_infinite_grades_stay_infinite(spark):
    df = spark.createDataFrame([("Infinity", "1"), ("1e999", "1"), ("-1e999", "5"), ("1e999", "-1e999"), ("7", "8")],
                               "a string, b string")
    got = [r[0] for r in df.select(final_grade("a", "b")).collect()]
    assert got[1] == float("inf") and got[2] == float("-inf") and got[3] != got[3] and got[4] == 7.5
    assert df.select(parse_grade("a")).count() == 5


def test_null_secret_is_too_short(spark):
    accounts = spark.createDataFrame([("x", False, 1)], "account string, is_admin boolean, ord long")
    new = spark.createDataFrame([(1, "bob", None)], "row_no long, account string, secret_length int")
    assert screen_accounts(accounts, new).first().verdict != "accepted"


def test_empty_batch_without_headers_is_a_no_op(spark):
    sheet = spark.createDataFrame([], "row_no long, account string")
    base = imported(spark)
    students, rejects = import_roster(base, classes_df(spark), sheet)
    assert students.count() == base.count() and rejects.count() == 0


def test_point_grades_need_an_order(spark):
    entries = spark.createDataFrame([], "account string, class_name string, student_id string, midterm double, exam double")
    with pytest.raises(ValueError):
        set_grades(imported(spark), classes_df(spark), entries)


def test_size_check_has_no_limit_and_counts_struct_fields(spark):
    df = spark.sql("select struct('x' as a, repeat('y', 100) as b) as s from range(10)")
    assert not joins.fits_broadcast(df, max_bytes=500)
    assert joins.fits_broadcast(df, max_bytes=5000)
    assert not joins.fits_rows(df, 9) and joins.fits_rows(df, 10)
