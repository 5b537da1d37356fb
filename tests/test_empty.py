"""Empty tables and batches: every operator returns an empty (or unchanged) result, never fails."""

from pyspark.sql import functions as F

from classledger import schema as S
from classledger.operators.accounts import account_listing, screen_accounts
from classledger.operators.changes import add_classes, add_students, delete_students, edit_students
from classledger.operators.grades import merge_counts, merge_grades, set_grades
from classledger.operators.roster import class_counts, roster_positions
from classledger.operators.search import search_classes

from .fixtures import GRADE_HEADERS, classes_df, imported, sheet


def empty(spark, schema):
    return spark.createDataFrame([], schema)


def test_empty_tables(spark):
    st, cl = empty(spark, S.STUDENTS), empty(spark, S.CLASSES)
    assert roster_positions(st).count() == 0
    assert class_counts(cl, st).count() == 0
    assert search_classes(cl, st, "a").count() == 0
    assert account_listing(empty(spark, S.ACCOUNTS), cl).count() == 0


def test_empty_batches_change_nothing(spark):
    base = imported(spark)
    g = sheet(spark, GRADE_HEADERS, []).where(F.lit(False))
    merged = merge_grades(base, g, classes_df(spark))
    assert merged.where("matched").count() == 0 and merged.count() == 5
    assert merge_counts(merged).first().updated == 0
    new = empty(spark, "row_no bigint, account string, student_id string, full_name string, "
                       "birth_date string, gender string, class_name string")
    out, rej = add_students(base, new)
    assert out.count() == 5 and rej.count() == 0
    assert add_classes(classes_df(spark), empty(spark, "row_no bigint, account string, class_name string")).count() == 3
    assert delete_students(base, empty(spark, "account string, student_id string")).count() == 5
    ed = empty(spark, "account string, original_id string, student_id string, full_name string, "
                      "birth_date string, gender string, class_name string, midterm double, exam double")
    assert edit_students(base, ed)[0].count() == 5
    ent = empty(spark, "row_no bigint, account string, class_name string, student_id string, midterm double, exam double")
    assert set_grades(base, classes_df(spark), ent)[0].count() == 5
    assert screen_accounts(empty(spark, S.ACCOUNTS),
                           empty(spark, "row_no bigint, account string, secret_length int")).count() == 0
