"""Class dashboard, roster order and roster views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import roster_sort_key
from .ranking import positions_within


def class_counts(classes: DataFrame, students: DataFrame) -> DataFrame:
    """Students per class, empty classes included; a class listed twice shows twice.

    Students are counted per ``(account, class_name)`` with a partial
    aggregation first, so a class holding most students costs one row per
    task before the shuffle; the class list then joins the small result.
    """
    counts = (students.where(F.col("class_name").isNotNull())
                      .groupBy("account", "class_name")
                      .agg(F.count(F.lit(1)).alias("_n")))
    return (classes.join(counts, ["account", "class_name"], "left")
                   .select("account", "class_name", "ord",
                           F.coalesce(F.col("_n"), F.lit(0)).cast("long").alias("n_students")))


def headcount(students: DataFrame, class_name: str) -> DataFrame:
    """Headcount of one class, per account holding it."""
    return (students.where(F.col("class_name") == F.lit(class_name))
                    .groupBy("account").agg(F.count(F.lit(1)).alias("headcount")))


def roster_order(students: DataFrame, out: str = "roster_pos") -> DataFrame:
    """Position of every student in its account's roster order.

    Order: given name (last space-separated token) under Vietnamese
    collation, ties by stored order ``ord``.
    """
    return positions_within(students, ["account"], [roster_sort_key("full_name"), "ord"], out=out)


def roster_positions(students: DataFrame, out: str = "pos") -> DataFrame:
    """Position of every student inside its class roster (same order as ``roster_order``)."""
    return positions_within(students, ["account", "class_name"],
                            [roster_sort_key("full_name"), "ord"], out=out)


def class_roster(students: DataFrame, class_name: str) -> DataFrame:
    """One class's roster view: id, name, birth date, gender, grades, position."""
    one = students.where(F.col("class_name") == F.lit(class_name))
    return roster_positions(one).select("account", "class_name", "student_id", "full_name",
                                        "birth_date", "gender", "midterm", "exam", "final_grade", "pos")


def student_labels(students: DataFrame) -> DataFrame:
    """Pick-list label ``"<name> - <id>"`` per class, with the roster position."""
    return roster_positions(students.where(F.col("class_name").isNotNull())).select(
        "account", "class_name", "student_id",
        F.concat_ws(" - ", "full_name", "student_id").alias("label"), "pos")


def class_list(classes: DataFrame) -> DataFrame:
    """Class names of each account in insertion order."""
    return positions_within(classes, ["account"], ["ord"], out="pos").select(
        "account", "class_name", "pos")
