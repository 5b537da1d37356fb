"""Bucketed students, buckets rewritten in place, nested records, JSON cells, typed birth dates."""

import contextlib
import datetime
import glob
import io
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from classledger import schema as S
from classledger.functions.dates import birth_date_value
from classledger.operators.grades import merge_grades, merge_grades_by_bucket, set_grades, set_grades_by_bucket
from classledger.operators.search import search_classes
from classledger.sources.bucketed import open_students, write_students
from classledger.sources.nested import class_sizes, nest_accounts, read_accounts, unnest_accounts
from classledger.sources.sheets import read_sheet, write_sheet
from classledger.sources.snapshots import Tables, account_bucket, load, save, update_accounts

from .fixtures import GRADE_HEADERS, GRADE_ROWS, classes_df, imported, sheet


def scratch():
    return tempfile.mkdtemp(prefix="classledger-test-", dir="/tmp")


def plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def many_students(spark, n=400):
    return spark.createDataFrame([(f"t{i % 3}", None if i % 50 == 0 else f" S{i} ", f"n {i}", "", "Nam", f"C{i % 7}", 1.0, 2.0, 1.5, i)
                                  for i in range(n)], S.STUDENTS)


def many_grades(spark, n=400):
    return sheet(spark, GRADE_HEADERS, [(i, f"S{i}", f"C{i % 7}" if i % 5 else "C9", str(i % 10), None, "7") for i in range(n)], "t0").withColumn(
        "account", F.expr("concat('t', row_no % 3)"))


def test_bucketed_merges_exchange_nothing(spark):
    d, students, grades = scratch(), many_students(spark), many_grades(spark)
    classes = spark.createDataFrame([(f"t{i}", "C0", 0) for i in range(3)], S.CLASSES)
    write_students(students, f"{d}/students", buckets=4)
    stored = open_students(spark, f"{d}/students")
    merged = merge_grades_by_bucket(stored, grades, f"{d}/sheet", classes)
    entries = spark.createDataFrame([(i, f"t{i % 3}", f"C{i % 7}", f" S{i} ", float(i % 9), 3.0) for i in range(100)],
                                    "row_no long, account string, class_name string, student_id string, midterm double, exam double")
    graded, _ = set_grades_by_bucket(stored, classes, entries, f"{d}/entries")
    for df in (merged, graded):
        lines = plan(df).splitlines()
        start = next(i for i, line in enumerate(lines) if "SortMergeJoin" in line)
        stop = next(i for i in range(start, len(lines)) if lines[i].startswith("   +- "))   # the hot ids' branch of the union
        of_buckets = "\n".join(lines[start:stop])
        assert of_buckets.count("Bucketed: true") == of_buckets.count("FileScan") == 2 and "Exchange" not in of_buckets
    assert rows(merged) == rows(merge_grades(students, grades, classes))
    assert rows(graded) == rows(set_grades(students, classes, entries)[0])


def test_hot_ids_stay_out_of_the_buckets(spark):
    d = scratch()
    students = many_students(spark).unionByName(spark.createDataFrame(
        [("t0", "HOT", f"h {i}", "", "Nam", "C1", 0.0, 0.0, 0.0, 1000 + i) for i in range(300)], S.STUDENTS))
    stored = write_students(students, f"{d}/students", buckets=4, min_hot_rows=50)
    assert stored.hot.count() == 300 and rows(stored.all()) == rows(students)
    grades = many_grades(spark).unionByName(sheet(spark, GRADE_HEADERS, [(999, "HOT", "C1", "9", "9", None)], "t0"))
    assert rows(merge_grades_by_bucket(stored, grades, f"{d}/sheet")) == rows(merge_grades(students, grades))


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/*/account_bucket=*/*.parquet")}


def test_an_update_rewrites_only_its_accounts_buckets(spark):
    d, names = scratch(), [f"t{i}" for i in range(40)]
    accounts = spark.createDataFrame([("admin", True, -1)] + [(n, False, i) for i, n in enumerate(names)], S.ACCOUNTS)
    classes = spark.createDataFrame([(n, "C", 0) for n in names], S.CLASSES)
    students = spark.createDataFrame([(n, f"S{i}", "x", "", "Nam", "C", 1.0, 1.0, 1.0, i) for n in names for i in range(3)], S.STUDENTS)
    save(Tables(accounts, classes, students), f"{d}/v", buckets=8)
    before = files(f"{d}/v")
    one = spark.createDataFrame([("t7",)], "account string")
    touched = update_accounts(spark, f"{d}/v", one, lambda t: Tables(t.accounts, t.classes, t.students.withColumn("full_name", F.lit("new"))))
    bucket = spark.range(1).select(account_bucket(F.lit("t7"), 8).alias("b")).first().b
    assert touched == [bucket]
    after = files(f"{d}/v")
    same = {f for f in before if f in after and before[f] == after[f]}
    assert same == {f for f in before if f"account_bucket={bucket}/" not in f}
    assert {f for f in after if f not in same} and all(f"account_bucket={bucket}/" in f for f in after if f not in same)
    got = {(r.account, r.full_name) for r in load(spark, f"{d}/v").students.collect()}
    assert got == {(n, "new" if n == "t7" else "x") for n in names}
    # An account, then all accounts of its bucket, are emptied: they stay empty, the others keep their rows.
    empty = lambda t: Tables(t.accounts, t.classes.limit(0), t.students.limit(0))
    update_accounts(spark, f"{d}/v", one, empty)
    assert load(spark, f"{d}/v", "t7").students.count() == 0 and load(spark, f"{d}/v").students.count() == 39 * 3
    mates = accounts.where(account_bucket(accounts.account, 8) == bucket).select("account")
    gone = [r.account for r in mates.collect()]
    update_accounts(spark, f"{d}/v", mates, lambda t: Tables(t.accounts.limit(0), t.classes.limit(0), t.students.limit(0)))
    left = load(spark, f"{d}/v")
    assert {r.account for r in left.students.collect()} == set(names) - set(gone)
    kept_admin = {"admin"} if "admin" in gone else set()
    assert {r.account for r in left.accounts.collect()} == (set(names) | {"admin"}) - set(gone) | kept_admin


def test_nested_records_and_back(spark):
    d = scratch()
    accounts = spark.createDataFrame([("admin", True, 0), ("thay", False, 1), ("moi", False, 2)], S.ACCOUNTS)
    classes = spark.createDataFrame([("thay", f"C{i}", 10 * i) for i in range(7)] + [("admin", None, 4)], S.CLASSES)
    students = spark.createDataFrame([("thay", f"S{i}", None, "", "Nam", f"C{i}", 1.25, 0.1, 0.68, 100 - i) for i in range(5)], S.STUDENTS)
    for size in (2, 100):
        nest_accounts(Tables(accounts, classes, students), part_rows=size).write.json(f"{d}/n{size}")
        back = unnest_accounts(read_accounts(spark, f"{d}/n{size}"))
        assert rows(back.accounts) == rows(accounts)
        assert rows(back.classes) == [("admin", None, 0)] + [("thay", f"C{i}", i) for i in range(7)]
        assert rows(back.students) == sorted((("thay", f"S{i}", None, "", "Nam", f"C{i}", 1.25, 0.1, 0.68, 4 - i) for i in range(5)), key=str)
        assert rows(class_sizes(read_accounts(spark, f"{d}/n{size}"))) == [("admin", 1), ("moi", 0), ("thay", 7)]


def test_records_as_the_application_holds_them(spark):
    d = scratch()
    with open(f"{d}/state.json", "w", encoding="utf-8") as f:
        f.write(json.dumps({"user": "admin", "isAdmin": True, "data": {"classes": [], "students": []}}) + "\n")
        f.write(json.dumps({"user": "thay", "isAdmin": False, "data": {"classes": ["CT01", "CT01"], "students": [
            {"masv": "S1", "hoten": "Lê An", "ngaysinh": "2004-01-01", "gioitinh": "Nữ", "malop": "CT01",
             "diemqt": "8,5", "diemthi": 7, "diemtong": "7.50"}]}}, ensure_ascii=False) + "\n")
        f.write(json.dumps({"user": "trong", "isAdmin": False}) + "\n")
    t = unnest_accounts(read_accounts(spark, f"{d}/state.json"))
    assert rows(t.accounts) == [("admin", True, 0), ("thay", False, 0), ("trong", False, 0)]
    assert rows(t.classes) == [("thay", "CT01", 0), ("thay", "CT01", 1)]
    assert rows(t.students) == [("thay", "S1", "Lê An", "2004-01-01", "Nữ", "CT01", 8.0, 7.0, 7.5, 0)]


def test_json_numbers_and_texts_are_told_apart(spark):
    d = scratch()
    with open(f"{d}/s.json", "w", encoding="utf-8") as f:
        f.write('{"row_no": 1, "MSSV": 20210001.0, "Lớp": "CT01", "it\'s": 1.50, "x": true}\n')
        f.write('{"row_no": 2, "MSSV": "20210001.0", "Lớp": "007", "it\'s": 2.5E3, "x": null}\n')
        f.write('{"row_no": 3, "MSSV": 7, "it\'s": "1.50", "x": "TRUE"}\n')
    got = read_sheet(spark, f"{d}/s.json", "json", account="t1").orderBy("row_no").collect()
    assert [r.MSSV for r in got] == ["20210001", "20210001.0", "7"]
    assert [r["it's"] for r in got] == ["1.5", "2500", "1.50"]
    assert [(r["Lớp"], r.x) for r in got] == [("CT01", "true"), ("007", None), (None, "TRUE")]


def test_a_written_sheet_reads_back(spark):
    d = scratch()
    sh = sheet(spark, GRADE_HEADERS, GRADE_ROWS + [(6, "20210001", "CT01", "7,5", None, "0.25")])
    write_sheet(sh, f"{d}/s", numbers=("MSSV", "Điểm quá trình", "Điểm thi"))
    back = read_sheet(spark, f"{d}/s", "json")
    assert rows(back.select(*sh.columns)) == rows(sh)
    students, classes = imported(spark), classes_df(spark)
    assert rows(merge_grades(students, back, classes)) == rows(merge_grades(students, sh, classes))


def test_class_search_is_an_existence_join(spark):
    students = imported(spark)
    classes = classes_df(spark).unionByName(classes_df(spark, ["CT01", None]))
    got = search_classes(classes, students, "ánh")
    assert "ExistenceJoin" in plan(got)
    assert [r.class_name for r in got.collect()] == ["CT01", "CT01"]        # a class listed twice shows twice
    assert sorted(r.class_name for r in search_classes(classes, students, "ct0").collect()) == ["CT01", "CT01", "CT02", "CT03"]


@pytest.mark.parametrize("text, day", [
    ("2004-02-29", (2004, 2, 29)), (" 2004-02-29T00:00:00Z", (2004, 2, 29)), ("2003-02-29", None), ("29/2/2004", (2004, 2, 29)),
    ("01/12/1999", (1999, 12, 1)), ("13/13/2000", None), ("38000", (2004, 1, 14)), ("38000.75", (2004, 1, 14)), ("1", (1900, 1, 1)),
    ("59", (1900, 2, 28)), ("60", None), ("61", (1900, 3, 1)), ("0", None), ("2958465", (9999, 12, 31)), ("2958466", None),
    ("9999999", None), ("", None), (None, None), ("12-31-2000", None), ("abc", None)])
def test_birth_dates(spark, text, day):
    got = spark.createDataFrame([(text,)], "c string").select(birth_date_value("c").alias("d")).first().d
    assert got == (datetime.date(*day) if day else None)
