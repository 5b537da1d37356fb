"""Student and class search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import contains_ci

SEARCH_VIEW = ("account", "student_id", "full_name", "class_name", "midterm", "exam",
               "final_grade", "ord")


def student_match(term: str):
    """Name or id contains the term, case-insensitively; an empty term matches nothing."""
    if term == "":
        return F.lit(False)
    return contains_ci("full_name", term) | contains_ci("student_id", term)


def search_students(students: DataFrame, term: str) -> DataFrame:
    """Students whose name or id contains ``term`` (case-insensitive, accent-sensitive).

    For display in stored order, sort by ``roster_sort_key("full_name"), "ord"``.
    """
    return students.where(student_match(term)).select(*SEARCH_VIEW)


def search_classes(classes: DataFrame, students: DataFrame, term: str) -> DataFrame:
    """Classes whose name contains ``term`` or that hold a student matching it.

    An empty term returns every class. The test is an EXISTS beside an OR, which
    Spark plans as an existence join: a class is kept or not, and never repeated
    by its students. Matching students are reduced to their distinct
    ``(account, class_name)`` first, so the join side is at most the number of
    classes.
    """
    if term == "":
        return classes.select("account", "class_name", "ord")
    hits = (students.where(student_match(term) & F.col("class_name").isNotNull())
                    .select(F.col("account").alias("_account"), F.col("class_name").alias("_class")).distinct())
    of_class = (F.col("_account") == F.col("c.account").outer()) & (F.col("_class") == F.col("c.class_name").outer())
    keep = contains_ci("c.class_name", term) | hits.where(of_class).exists()
    return classes.alias("c").where(keep).select("c.account", "c.class_name", "c.ord")
