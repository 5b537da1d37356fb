"""Dropped sheet files are imported one by one into new snapshots."""

import tempfile

from pyspark.sql import functions as F

from classledger import schema as S
from classledger.sources.snapshots import Tables, load
from classledger.streaming import start_sheet_imports


def write_csv(path, header, rows):
    with open(path, "w", encoding="utf-8") as f:
        f.write(",".join(header) + "\n")
        for r in rows:
            f.write(",".join("" if v is None else str(v) for v in r) + "\n")


def test_grade_files_become_snapshots(spark):
    d = tempfile.mkdtemp(prefix="classledger-stream-", dir="/tmp")
    accounts = spark.createDataFrame([("admin", True, 0), ("thay", False, 1)], S.ACCOUNTS)
    classes = spark.createDataFrame([("thay", "CT01", 0)], S.CLASSES)
    students = spark.createDataFrame([("thay", "S1", "Lê An", "", "Nam", "CT01", 1.0, 1.0, 1.0, 0),
                                      ("thay", "S2", "Võ Ba", "", "Nam", "CT01", 2.0, 2.0, 2.0, 1)],
                                     S.STUDENTS)
    header = ["row_no", "account", "MSSV", "Lớp", "Điểm quá trình", "Điểm kết thúc"]
    import os
    os.makedirs(f"{d}/drop")
    write_csv(f"{d}/drop/1.csv", header, [(1, "thay", "S1", "CT01", 9, 7), (2, "thay", "S1", "CT01", 1, 1)])
    write_csv(f"{d}/drop/2.csv", header, [(1, "thay", "S2", "CT01", 5, 6), (2, "thay", "S9", "CT01", 5, 6)])
    q = start_sheet_imports(spark, f"{d}/drop", f"{d}/snap", f"{d}/ckpt", kind="grades",
                            headers=header[2:], initial=Tables(accounts, classes, students),
                            files_per_trigger=1, available_now=True)
    q.awaitTermination(120)
    log = spark.read.parquet(f"{d}/snap/_log").orderBy("epoch").collect()
    assert len(log) == 2
    last = load(spark, log[-1].path, account="thay").students
    got = sorted((r.student_id, r.final_grade) for r in last.collect())
    assert got == [("S1", 8.0), ("S2", 5.5)]
    rep = spark.read.parquet(f"{d}/snap/_reports/grades").where(F.col("account") == "thay")
    assert sorted((r.file[-5:], r.status, r.updated) for r in rep.collect()) == \
        [("1.csv", "updated", 1), ("2.csv", "updated", 1)]


def test_roster_files_import_and_refuse(spark):
    import os

    import pytest

    from classledger.operators.ingest import MissingColumns
    d = tempfile.mkdtemp(prefix="classledger-stream-", dir="/tmp")
    os.makedirs(f"{d}/drop")
    accounts = spark.createDataFrame([("admin", True, 0), ("thay", False, 1), ("co", False, 2)], S.ACCOUNTS)
    classes = spark.createDataFrame([("thay", "CT01", 0), ("co", "CT01", 0)], S.CLASSES)
    header = ["row_no", "account", "MSSV", "Họ và tên", "Ngày sinh", "Giới tính", "Lớp"]
    write_csv(f"{d}/drop/1.csv", header, [(1, "thay", "S1", "Lê An", "2004-01-01", "Nữ", "CT01"),
                                          (2, "co", "S2", "Võ Ba", "2004-01-01", "Nam", "CT09")])
    with pytest.raises(MissingColumns):
        start_sheet_imports(spark, f"{d}/drop", f"{d}/snap", f"{d}/ckpt", kind="roster",
                            headers=header[2:-1], initial=Tables(accounts, classes, spark.createDataFrame([], S.STUDENTS)))
    q = start_sheet_imports(spark, f"{d}/drop", f"{d}/snap", f"{d}/ckpt", kind="roster", headers=header[2:],
                            initial=Tables(accounts, classes, spark.createDataFrame([], S.STUDENTS)),
                            available_now=True)
    q.awaitTermination(120)
    log = spark.read.parquet(f"{d}/snap/_log").collect()
    snap = load(spark, log[0].path)
    assert [(r.account, r.student_id) for r in snap.students.collect()] == [("thay", "S1")]
    rep = spark.read.parquet(f"{d}/snap/_reports/roster").collect()
    assert [(r.account, r.status, r.missing) for r in rep] == [("co", "refused", "CT09")]


def test_many_files_in_one_batch_equal_one_by_one(spark):
    import os
    import time
    d = tempfile.mkdtemp(prefix="classledger-stream-", dir="/tmp")
    accounts = spark.createDataFrame([("admin", True, 0), ("thay", False, 1)], S.ACCOUNTS)
    classes = spark.createDataFrame([("thay", "CT01", 0)], S.CLASSES)
    students = spark.createDataFrame([("thay", "S1", "Lê An", "", "Nam", "CT01", 1.0, 1.0, 1.0, 0),
                                      ("thay", "S2", "Võ Ba", "", "Nam", "CT01", 2.0, 2.0, 2.0, 1)],
                                     S.STUDENTS)
    header = ["row_no", "account", "MSSV", "Lớp", "Điểm quá trình", "Điểm kết thúc"]
    os.makedirs(f"{d}/drop")
    files = [[(1, "thay", "S1", "CT01", 9, 7)], [(1, "thay", "S1", "CT01", None, 3), (2, "thay", "S2", "CT01", 4, 0)],
             [(1, "thay", "S2", "CT01", 5, None)]]
    for i, rows in enumerate(files):
        write_csv(f"{d}/drop/{i}.csv", header, rows)
        os.utime(f"{d}/drop/{i}.csv", (time.time() + i, time.time() + i))
    results = {}
    for per in (1, 10):
        root = f"{d}/snap{per}"
        q = start_sheet_imports(spark, f"{d}/drop", root, f"{d}/ckpt{per}", kind="grades", headers=header[2:],
                                initial=Tables(accounts, classes, students), files_per_trigger=per,
                                available_now=True)
        q.awaitTermination(120)
        log = spark.read.parquet(f"{root}/_log").orderBy("epoch").collect()
        assert len(log) == (3 if per == 1 else 1)
        results[per] = sorted((r.student_id, r.midterm, r.exam, r.final_grade)
                              for r in load(spark, log[-1].path).students.collect())
    assert results[1] == results[10] == [("S1", 9.0, 3.0, 6.0), ("S2", 5.0, 2.0, 3.5)]
    rep = spark.read.parquet(f"{d}/snap10/_reports/grades").collect()
    assert sorted((r.file[-5:], r.updated) for r in rep) == [("0.csv", 1), ("1.csv", 2), ("2.csv", 1)]


def test_a_grade_epoch_merges_its_students_once(spark, monkeypatch):
    import os

    from classledger.streaming import drops
    calls, merge = [], drops.merge_grades
    monkeypatch.setattr(drops, "merge_grades", lambda *a, **k: calls.append(1) or merge(*a, **k))
    accounts = spark.createDataFrame([("admin", True, 0), ("thay", False, 1)], S.ACCOUNTS)
    classes = spark.createDataFrame([("thay", "CT01", 0), ("admin", "CT01", 0)], S.CLASSES)
    students = spark.createDataFrame([(a, f"S{i}", "Lê An", "", "Nam", "CT01", 1.0, 1.0, 1.0, i)
                                      for a in ("thay", "admin") for i in range(3)], S.STUDENTS)
    header = ["row_no", "account", "MSSV", "Lớp", "Điểm quá trình", "Điểm kết thúc"]
    for named, merges in ((["thay", "nobody"], 1), (["thay", "admin"], 2)):   # an admin's sheet is merged for its report alone
        d = tempfile.mkdtemp(prefix="classledger-stream-", dir="/tmp")
        os.makedirs(f"{d}/drop")
        write_csv(f"{d}/drop/1.csv", header, [(i, a, f"S{i}", "CT01", 9, 7) for a in named for i in range(2)])
        calls.clear()
        start_sheet_imports(spark, f"{d}/drop", f"{d}/snap", f"{d}/ckpt", kind="grades", headers=header[2:],
                            initial=Tables(accounts, classes, students), available_now=True).awaitTermination(120)
        log = spark.read.parquet(f"{d}/snap/_log").collect()
        assert len(calls) == merges and [r.updated for r in log] == [2 if merges == 1 else 4]
        report = {r.account: (r.status, r.updated) for r in spark.read.parquet(f"{d}/snap/_reports/grades").collect()}
        assert report == {"thay": ("updated", 2), named[1]: ("refused", 0) if merges == 1 else ("updated", 2)}
        assert load(spark, log[0].path).students.columns == list(S.STUDENT_COLUMNS)
