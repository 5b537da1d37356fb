"""Batch change sets: additions, keyed edits and cascading deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import final_grade_of, js_or, truthy
from .joins import broadcast_if_small, broadcast_when, fits_broadcast
from ..session import materialise


def _append_ord(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """``ord`` for appended rows: above the account's maximum, in ``row_no`` order.

    Only the batch's accounts are read from ``existing`` (broadcast semi-join).
    """
    # One row for each account of the batch: written once, and its own size is what is checked.
    first = materialise(batch.groupBy("account").agg(F.min("row_no").alias("_min_row")), "batch-accounts")
    small = fits_broadcast(first)
    accounts = broadcast_when(small, first.select("account"))
    top = (existing.join(accounts, "account", "left_semi")
                   .groupBy("account").agg(F.max("ord").alias("_max_ord")))
    marks = broadcast_when(small, first.join(top, "account", "left"))
    return (batch.join(marks, "account")
                 .withColumn("ord", (F.coalesce(F.col("_max_ord"), F.lit(0)) + F.lit(1)
                                     + F.col("row_no") - F.col("_min_row")).cast("long")))


def add_students(students: DataFrame, new: DataFrame):
    """Append students ``(row_no, account, student_id, full_name, birth_date, gender, class_name)``.

    A row needs a non-empty id, name, birth date and class; gender defaults
    to 'Nam', grades to 0. Returns ``(students, rejects)``.
    """
    ok = truthy("student_id") & truthy("full_name") & truthy("birth_date") & truthy("class_name")
    checked = new.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    rejects = checked.where(~F.col("_ok")).drop("_ok").withColumn("reason", F.lit("missing_required"))
    good = checked.where(F.col("_ok")).drop("_ok").withColumns({
        "gender": js_or("gender", F.lit(S.DEFAULT_GENDER)),
        "midterm": F.lit(0.0), "exam": F.lit(0.0), "final_grade": F.lit(0.0)})
    appended = _append_ord(students, good).select(*S.STUDENT_COLUMNS)
    return students.select(*S.STUDENT_COLUMNS).unionByName(appended), rejects


def add_classes(classes: DataFrame, new: DataFrame) -> DataFrame:
    """Append classes ``(row_no, account, class_name)``; blank names are skipped, duplicates kept."""
    good = new.where(truthy("class_name"))
    appended = _append_ord(classes, good).select("account", "class_name", "ord")
    return classes.select("account", "class_name", "ord").unionByName(appended)


def delete_classes(classes: DataFrame, students: DataFrame, keys: DataFrame):
    """Delete classes ``(account, class_name)`` with every copy of the name and their students.

    Students without a class are kept. Returns ``(classes, students)``.
    """
    k = broadcast_if_small(keys.select("account", "class_name").distinct())
    return (classes.join(k, ["account", "class_name"], "left_anti"),
            students.join(k, ["account", "class_name"], "left_anti"))


def delete_students(students: DataFrame, keys: DataFrame) -> DataFrame:
    """Delete every row whose ``(account, student_id)`` is in ``keys``, in every class."""
    k = broadcast_if_small(keys.select("account", "student_id").distinct())
    return students.join(k, ["account", "student_id"], "left_anti")


EDIT_FIELDS = ("student_id", "full_name", "birth_date", "gender", "class_name", "midterm", "exam")


def edit_conflicts(edits: DataFrame) -> DataFrame:
    """Original ids of edits that cannot be applied as one batch.

    A repeated original id, or an edit whose new id is another edit's
    original id (both of that pair): applied one by one, the outcome would
    depend on their order. The original ids are made distinct before the
    join, so each edit meets at most one partner.
    """
    dup = (edits.groupBy("account", "original_id").agg(F.count(F.lit(1)).alias("_n"))
                .where(F.col("_n") > 1).select("account", "original_id"))
    origs = edits.select(F.col("account").alias("_acc"), F.col("original_id").alias("_orig")).distinct()
    onto = edits.join(origs, (edits["account"] == origs["_acc"]) &
                      (edits["student_id"] == origs["_orig"]) &
                      (edits["original_id"] != origs["_orig"]), "left_semi")
    renamed = onto.select("account", "original_id")
    targets = onto.select("account", F.col("student_id").alias("original_id"))
    return dup.unionByName(renamed).unionByName(targets).distinct()


def edit_students(students: DataFrame, edits: DataFrame):
    """Replace every student row whose id equals an edit's ``original_id`` by the edit's values.

    All rows with that id in the account are replaced (any class), the new id
    is not checked against existing ids, the stored order is kept and the
    final grade recomputed; an edit may set a value to NULL. Conflicting edits
    (see :func:`edit_conflicts`) are refused. Returns ``(students, rejects)``.
    """
    bad = edit_conflicts(edits)
    rejects = edits.join(bad, ["account", "original_id"], "left_semi").withColumn(
        "reason", F.lit("conflicting_edit"))
    good = edits.join(bad, ["account", "original_id"], "left_anti")
    # The accepted edits are written once (the conflict analysis runs once),
    # then broadcast when the written table is provably small.
    side = broadcast_if_small(materialise(good.select(
        "account", F.col("original_id").alias("_orig"),
        *[F.col(c).alias(f"_e_{c}") for c in EDIT_FIELDS], F.lit(True).alias("_hit")), "edits"))
    return replace_students(students, side), rejects


def replace_students(students: DataFrame, side: DataFrame) -> DataFrame:
    """Students whose (account, id) is in ``side`` (account, _orig, _e_<field>, _hit) with its values."""
    j = students.join(side, (students["account"] == side["account"]) &
                      (students["student_id"] == side["_orig"]), "left")
    hit = F.coalesce(side["_hit"], F.lit(False))
    cols = []
    for c in S.STUDENT_COLUMNS:
        if c in EDIT_FIELDS:
            cols.append(F.when(hit, side[f"_e_{c}"]).otherwise(students[c]).alias(c))
        elif c == "final_grade":
            cols.append(F.when(hit, final_grade_of(side["_e_midterm"], side["_e_exam"]))
                         .otherwise(students[c]).alias(c))
        else:
            cols.append(students[c])
    return j.select(*cols)
