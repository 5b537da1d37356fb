"""Accounts as one nested record each, the form the application state has.

A record holds the account's name and role, the array of its class names and
the array of its students. ``unnest_accounts`` takes such records apart into the
three tables, the place in an array becoming ``ord``; ``nest_accounts`` puts them
together again. An account with more than ``part_rows`` classes or students is
several records (``part`` 0, 1, ...), each naming the place of its first class and
student, so no record and no task grows with the largest account. A record
without these columns is a whole account.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import parse_grade
from ..operators.ranking import positions_within
from .snapshots import Tables

# Field names of the nested records, and the student columns they hold.
USER, IS_ADMIN, DATA = "user", "isAdmin", "data"
STUDENT_FIELDS = {"masv": "student_id", "hoten": "full_name", "ngaysinh": "birth_date", "gioitinh": "gender",
                  "malop": "class_name", "diemqt": "midterm", "diemthi": "exam", "diemtong": "final_grade"}
GRADES = ("midterm", "exam", "final_grade")

_student = ", ".join(f"{f}: string" for f in STUDENT_FIELDS)
NESTED = (f"{USER} string, {IS_ADMIN} boolean, ord long, part int, class_from long, student_from long, "
          f"{DATA} struct<classes: array<string>, students: array<struct<{_student}>>>")
PART_ROWS = 10_000


def read_accounts(spark: SparkSession, path: str) -> DataFrame:
    """Nested records of JSON lines; grades are read as text, whether written as numbers or as text."""
    return spark.read.schema(NESTED).option("mode", "FAILFAST").json(path)


def _from(records: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)) if name in records.columns else F.lit(0)


def unnest_accounts(records: DataFrame) -> Tables:
    """The accounts, classes and students of nested records.

    Null and empty arrays give no rows; null grades are 0. ``ord`` of an account
    is the records' ``ord``, or 0 without one. Repeated records of one part give
    their classes and students again; the account is listed once.
    """
    account = F.col(USER).alias("account")
    order = _from(records, "ord")
    accounts = records.groupBy(account).agg(
        F.coalesce(F.bool_or(IS_ADMIN), F.lit(False)).alias("is_admin"), F.min(order).cast("long").alias("ord"))
    named = records.select(account, _from(records, "class_from").alias("_from"),
                           F.posexplode_outer(F.col(DATA)["classes"]).alias("_at", "class_name")).where(F.col("_at").isNotNull())
    classes = named.select("account", "class_name", (F.col("_from") + F.col("_at")).cast("long").alias("ord"))
    held = records.select(account, _from(records, "student_from").alias("_from"),
                          F.posexplode_outer(F.col(DATA)["students"]).alias("_at", "s")).where(F.col("_at").isNotNull())
    cells = {c: F.col("s")[f] for f, c in STUDENT_FIELDS.items()}
    cells = {c: parse_grade(x) if c in GRADES else x for c, x in cells.items()}
    students = held.select("account", *[x.alias(c) for c, x in cells.items()], (F.col("_from") + F.col("_at")).cast("long").alias("ord"))
    return Tables(accounts, classes, students.select(*S.STUDENT_COLUMNS))


def _in_parts(rows: DataFrame, value: Column, out: str, part_rows: int) -> DataFrame:
    """(account, part, out): each account's values in stored order, ``part_rows`` to a part."""
    placed = positions_within(rows, ["account"], ["ord"], out="_pos")
    part = F.floor((F.col("_pos") - 1) / part_rows).cast("int")
    items = F.array_sort(F.collect_list(F.struct(F.col("_pos"), value.alias("_value"))))
    return (placed.groupBy("account", part.alias("part"))
                  .agg(F.transform(items, lambda x: x["_value"]).alias(out)))


def nest_accounts(tables: Tables, part_rows: int = PART_ROWS) -> DataFrame:
    """``NESTED`` records of all accounts; those without classes and students have one empty record."""
    classes = _in_parts(tables.classes, F.col("class_name"), "classes", part_rows)
    fields = [(F.col(c).cast("string") if c in GRADES else F.col(c)).alias(f) for f, c in STUDENT_FIELDS.items()]
    students = _in_parts(tables.students, F.struct(*fields), "students", part_rows)
    both = classes.join(students, ["account", "part"], "full")
    j = tables.accounts.join(both, "account", "left")
    part = F.coalesce(F.col("part"), F.lit(0))
    at = (part.cast("long") * part_rows)
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(both.schema[c].dataType))
    return j.select(F.col("account").alias(USER), F.col("is_admin").alias(IS_ADMIN), "ord", part.alias("part"),
                    at.alias("class_from"), at.alias("student_from"),
                    F.struct(empty("classes").alias("classes"), empty("students").alias("students")).alias(DATA))


def class_sizes(records: DataFrame) -> DataFrame:
    """Number of classes per account, by the size of the nested arrays; nothing is exploded."""
    size = F.greatest(F.coalesce(F.size(F.col(DATA)["classes"]), F.lit(0)), F.lit(0))
    return records.groupBy(F.col(USER).alias("account")).agg(F.sum(size).cast("long").alias("n_classes"))
