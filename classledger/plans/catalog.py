"""Registered queries: each operator run over views of the driver's tables.

Every entry takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole tables; nothing is sampled, capped or collected.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import dates, final_grade, grade_truthy, parse_grade
from ..operators import accounts as acc
from ..operators import changes, edit_chains, grades, ingest, roster, search
from ..session import ensure_checkpoint_dir
from ..sources import bucketed, nested, sheets, snapshots
from ..sources import driver_tables as D

# Fixed parameters of the registered queries.
STUDENT_TERM = "MER#0000001"
CLASS_TERM = "r#00000000"
ROSTER_CLASS = "NATION_7"
QUERY_BUCKETS = 16
NESTED_ROWS = 1000
EMPTIED_ACCOUNT = "AMERICA"


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder in the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/classledger/{label}-{uuid.uuid4().hex}"


def q_class_counts(spark, d):
    return roster.class_counts(D.classes(spark, d), D.students(spark, d))


def q_grade_merge(spark, d):
    return grades.merge_grades(D.students(spark, d), D.grade_sheet(spark, d), D.classes(spark, d))


def q_grade_merge_sheets(spark, d):
    return grades.merge_grades(D.students(spark, d), D.grade_sheet(spark, d), D.classes(spark, d),
                               sheet_col="sheet_no")


def q_grade_merge_bucketed(spark, d):
    students = bucketed.write_students(D.students(spark, d), scratch(spark, "students"), QUERY_BUCKETS)
    return grades.merge_grades_by_bucket(students, D.grade_sheet(spark, d), scratch(spark, "sheet"), D.classes(spark, d))


def q_set_grades_bucketed(spark, d):
    path = scratch(spark, "students")
    bucketed.write_students(D.students(spark, d), path, QUERY_BUCKETS)
    out, _ = grades.set_grades_by_bucket(bucketed.open_students(spark, path), D.classes(spark, d), D.grade_entries(spark, d),
                                         scratch(spark, "entries"))
    return out


def q_grade_merge_count(spark, d):
    return grades.merge_counts(q_grade_merge(spark, d))


def q_grade_import_report(spark, d):
    return grades.grade_import_report(D.students(spark, d), D.classes(spark, d), D.grade_sheet(spark, d))


def q_grade_import_report_sheets(spark, d):
    return grades.grade_import_report(D.students(spark, d), D.classes(spark, d), D.grade_sheet(spark, d),
                                      sheet_col="sheet_no")


def q_roster_positions(spark, d):
    return roster.roster_positions(D.rosters(spark, d)).select(
        "account", "class_name", "student_id", "full_name", "pos")


def q_roster_order(spark, d):
    return roster.roster_order(D.rosters(spark, d)).select(
        "account", "student_id", "full_name", "roster_pos")


def q_student_search(spark, d):
    return search.search_students(D.students(spark, d), STUDENT_TERM)


def q_class_search(spark, d):
    return search.search_classes(D.classes(spark, d), D.students(spark, d), CLASS_TERM)


def q_class_roster(spark, d):
    return roster.class_roster(D.students(spark, d), ROSTER_CLASS)


def q_headcount(spark, d):
    return roster.headcount(D.students(spark, d), ROSTER_CLASS)


def q_student_labels(spark, d):
    return roster.student_labels(D.students(spark, d))


def _classes_grown(spark, d):
    """Classes after the supplier-derived additions: a class table that grows with the data."""
    return changes.add_classes(D.classes(spark, d), D.new_classes(spark, d))


def _accounts_grown(spark, d):
    """Accounts after the part-derived registrations: an account table that grows with the data."""
    accounts = D.accounts(spark, d)
    return acc.register_accounts(accounts, acc.screen_accounts(accounts, D.account_candidates(spark, d)))


def q_class_list(spark, d):
    return roster.class_list(_classes_grown(spark, d))


def q_missing_classes(spark, d):
    return ingest.missing_classes(D.classes(spark, d), D.roster_sheet(spark, d))


def q_missing_class_report(spark, d):
    return ingest.missing_class_report(q_missing_classes(spark, d))


def q_missing_columns(spark, d):
    return ingest.missing_column_report(D.header_sheets(spark, d), "sheet_no")


def q_roster_import(spark, d):
    out, _ = ingest.import_roster(D.students(spark, d), D.classes(spark, d), D.roster_sheet(spark, d))
    return out


def q_roster_import_sheets(spark, d):
    out, _ = ingest.import_roster(D.students(spark, d), D.classes(spark, d), D.roster_sheet(spark, d),
                                  sheet_col="sheet_no")
    return out


def q_parse_grades(spark, d):
    e = D.table(spark, d, "events").select("event_id", "props", "value", "event_type")
    a = F.regexp_replace(F.col("props"), "^[^0-9.+-]*", "")
    b = F.concat(F.col("value").cast("string"), F.col("event_type"))
    return e.select("event_id", parse_grade(a).alias("midterm"), parse_grade(b).alias("exam"),
                    final_grade(a, b).alias("final_grade"), grade_truthy(a).alias("cell_truthy"))


def q_delete_classes(spark, d):
    c, _ = changes.delete_classes(_classes_grown(spark, d), D.students(spark, d), D.class_delete_keys(spark, d))
    return c


def q_delete_classes_students(spark, d):
    _, s = changes.delete_classes(D.classes(spark, d), D.students(spark, d), D.class_delete_keys(spark, d))
    return s


def q_delete_students(spark, d):
    return changes.delete_students(D.students(spark, d), D.student_delete_keys(spark, d))


def q_delete_accounts(spark, d):
    a, _, _ = acc.delete_accounts(_accounts_grown(spark, d), D.classes(spark, d), D.students(spark, d),
                                  D.account_delete_keys(spark, d))
    return a


def q_delete_accounts_students(spark, d):
    _, _, s = acc.delete_accounts(D.accounts(spark, d), D.classes(spark, d), D.students(spark, d),
                                  D.account_delete_keys(spark, d))
    return s


def q_edit_students(spark, d):
    out, _ = changes.edit_students(D.students(spark, d), D.edits(spark, d))
    return out


def q_set_grades(spark, d):
    out, _ = grades.set_grades(D.students(spark, d), D.classes(spark, d), D.grade_entries(spark, d))
    return out


def q_set_grades_rejects(spark, d):
    _, rej = grades.set_grades(D.students(spark, d), D.classes(spark, d), D.grade_entries(spark, d))
    return rej.select("row_no", "account", "student_id", "reason")


def q_add_students(spark, d):
    out, _ = changes.add_students(D.students(spark, d), D.new_students(spark, d))
    return out


def q_add_students_rejects(spark, d):
    _, rej = changes.add_students(D.students(spark, d), D.new_students(spark, d))
    return rej.select("row_no", "account", "reason")


def q_add_classes(spark, d):
    return changes.add_classes(D.classes(spark, d), D.new_classes(spark, d))


def q_screen_accounts(spark, d):
    return acc.screen_accounts(D.accounts(spark, d), D.account_candidates(spark, d))


def q_account_listing(spark, d):
    return acc.account_listing(_accounts_grown(spark, d), D.classes(spark, d))


def q_delete_accounts_classes(spark, d):
    _, c, _ = acc.delete_accounts(D.accounts(spark, d), _classes_grown(spark, d), D.students(spark, d),
                                  D.account_delete_keys(spark, d))
    return c


def _moved_edits(spark, d):
    """The customers' edits, some of them onto the id of the next customer but four."""
    k = F.col("original_id").cast("long")
    return D.edits(spark, d).withColumn(
        "student_id", F.when(k % 11 == 0, (k + 5).cast("string")).otherwise(F.col("student_id")))


def q_edit_students_rejects(spark, d):
    _, rej = changes.edit_students(D.students(spark, d), _moved_edits(spark, d))
    return rej.select("account", "original_id", "student_id", "reason")


def q_edit_students_in_order(spark, d):
    return edit_chains.edit_students_in_order(D.students(spark, d), D.edits_in_order(spark, d))


def q_sheet_read_back(spark, d):
    """The grade sheet written as JSON lines, ids and midterms as numbers where they are, and read again as text."""
    sheet, path = D.grade_sheet(spark, d), scratch(spark, "sheet-json")
    sheets.write_sheet(sheet, path, numbers=(S.H_ID, S.H_MIDTERM))
    back = sheets.read_sheet(spark, path, "json")
    return back.select("row_no", "account", F.col(S.H_ID).alias("id"), F.col(S.H_CLASS[1]).alias("class_name"),
                       F.col(S.H_MIDTERM).alias("midterm"), F.col(S.H_EXAM[0]).alias("exam"))


def _snapshot(spark, d):
    path = scratch(spark, "snapshot")
    snapshots.save(snapshots.Tables(D.accounts(spark, d), D.classes(spark, d), D.students(spark, d)), path, buckets=QUERY_BUCKETS)
    return path


def q_snapshot_students(spark, d):
    """All students as a snapshot gives them back; the admin account's are not kept."""
    return snapshots.load(spark, _snapshot(spark, d)).students


def q_snapshot_update(spark, d):
    """A snapshot after some accounts changed in place: one is left without students, the others are graded anew."""
    path = _snapshot(spark, d)

    def change(t):
        left = t.students.where(F.col("account") != EMPTIED_ACCOUNT)
        merged = grades.merge_grades(left, D.grade_sheet(spark, d), t.classes).drop("matched")
        return snapshots.Tables(t.accounts, t.classes, merged)

    snapshots.update_accounts(spark, path, D.account_delete_keys(spark, d), change)
    return snapshots.load(spark, path).students


def q_seed_listing(spark, d):
    """The seed state after the part-derived registrations."""
    state = snapshots.seed(spark)
    accounts = acc.register_accounts(state.accounts, acc.screen_accounts(state.accounts, D.account_candidates(spark, d)))
    return acc.account_listing(accounts, state.classes)


def _nested(spark, d):
    tables = snapshots.Tables(D.accounts(spark, d), _classes_grown(spark, d), D.students(spark, d))
    path = scratch(spark, "nested")
    nested.nest_accounts(tables, part_rows=NESTED_ROWS).write.json(path)
    return nested.read_accounts(spark, path)


def q_nested_students(spark, d):
    """Students nested into account records, written as JSON lines, and taken apart again."""
    return nested.unnest_accounts(_nested(spark, d)).students


def q_nested_classes(spark, d):
    return nested.unnest_accounts(_nested(spark, d)).classes


def q_nested_class_sizes(spark, d):
    return nested.class_sizes(_nested(spark, d))


def q_birth_days(spark, d):
    return dates.with_birth_dates(D.birth_texts(spark, d)).select("account", "student_id", "birth_date", "birth_day")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "class_counts": q_class_counts,
    "grade_merge": q_grade_merge,
    "grade_merge_sheets": q_grade_merge_sheets,
    "grade_merge_count": q_grade_merge_count,
    "grade_import_report": q_grade_import_report,
    "grade_import_report_sheets": q_grade_import_report_sheets,
    "roster_positions": q_roster_positions,
    "roster_order": q_roster_order,
    "student_search": q_student_search,
    "class_search": q_class_search,
    "class_roster": q_class_roster,
    "headcount": q_headcount,
    "student_labels": q_student_labels,
    "class_list": q_class_list,
    "missing_classes": q_missing_classes,
    "missing_class_report": q_missing_class_report,
    "missing_columns": q_missing_columns,
    "roster_import": q_roster_import,
    "roster_import_sheets": q_roster_import_sheets,
    "parse_grades": q_parse_grades,
    "delete_classes": q_delete_classes,
    "delete_classes_students": q_delete_classes_students,
    "delete_students": q_delete_students,
    "delete_accounts": q_delete_accounts,
    "delete_accounts_students": q_delete_accounts_students,
    "edit_students": q_edit_students,
    "set_grades": q_set_grades,
    "set_grades_rejects": q_set_grades_rejects,
    "add_students": q_add_students,
    "add_students_rejects": q_add_students_rejects,
    "add_classes": q_add_classes,
    "screen_accounts": q_screen_accounts,
    "account_listing": q_account_listing,
    "grade_merge_bucketed": q_grade_merge_bucketed,
    "set_grades_bucketed": q_set_grades_bucketed,
    "delete_accounts_classes": q_delete_accounts_classes,
    "edit_students_rejects": q_edit_students_rejects,
    "edit_students_in_order": q_edit_students_in_order,
    "sheet_read_back": q_sheet_read_back,
    "snapshot_students": q_snapshot_students,
    "snapshot_update": q_snapshot_update,
    "seed_listing": q_seed_listing,
    "nested_students": q_nested_students,
    "nested_classes": q_nested_classes,
    "nested_class_sizes": q_nested_class_sizes,
    "birth_days": q_birth_days,
}
