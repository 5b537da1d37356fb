"""Sheet batches (S1, S2) and table snapshots (S3, S4, S5)."""

import json
import tempfile

import pytest

from classledger import schema as S
from classledger.operators.grades import merge_grades
from classledger.operators.ingest import import_roster
from classledger.sources.sheets import read_sheet
from classledger.sources.snapshots import Tables, load, save, seed

from .fixtures import classes_df


def scratch():
    return tempfile.mkdtemp(prefix="classledger-test-", dir="/tmp")


def test_csv_sheet_keeps_ids_as_text(spark):
    d = scratch()
    with open(f"{d}/roster.csv", "w", encoding="utf-8") as f:
        f.write("row_no,MSSV,Họ Tên,Ngày sinh,Giới tính,Lớp Học Phần,Điểm quá trình,Điểm thi\n")
        f.write("1,21001,Lê Thị An,2004-03-04,Nữ,CT01,8.25,8\n")
        f.write("2,021002,Phạm Đức,,,CT02,,7\n")
        f.write('3,S3,"Vũ\nDung",2004-01-01,Nữ,CT09,1,1\n')
    sh = read_sheet(spark, f"{d}/roster.csv", "csv", account="t1")
    assert all(t == "string" for c, t in sh.dtypes if c != "row_no")
    st, rej = import_roster(spark.createDataFrame([], S.STUDENTS), classes_df(spark),
                            sh.where("row_no < 3"))
    got = sorted((r.student_id, r.full_name, r.gender, r.class_name, r.final_grade) for r in st.collect())
    assert sh.where("row_no = 3").first()["Họ Tên"] == "Vũ\nDung"
    assert got == [("021002", "Phạm Đức", "Nam", "CT02", 3.5), ("21001", "Lê Thị An", "Nữ", "CT01", 8.13)]


def test_json_and_parquet_sheets(spark):
    d = scratch()
    with open(f"{d}/grades.json", "w", encoding="utf-8") as f:
        f.write(json.dumps({"row_no": 1, "account": "t1", "MSSV": 7, "Lớp": "CT01", "Điểm quá trình": 9.5}) + "\n")
    sh = read_sheet(spark, f"{d}/grades.json", "json")
    r = sh.first()
    assert (r.MSSV, r["Điểm quá trình"]) == ("7", "9.5")
    pq = f"{d}/grades.parquet"
    spark.createDataFrame([("S1", "CT01"), ("S2", "CT01")], "MSSV string, `Lớp` string").coalesce(1) \
        .write.parquet(pq)
    sh = read_sheet(spark, pq, "parquet", account="t1")
    assert sorted((x.row_no, x.MSSV) for x in sh.collect()) == [(0, "S1"), (1, "S2")]


def test_sheets_without_row_numbers_are_read_in_file_order(spark):
    d = scratch()
    for name in ("x", "y"):
        with open(f"{d}/{name}.csv", "w") as f:
            f.write("MSSV,Note\n" + "".join(f'{name}{i},"a\nb"\n' for i in range(500)))
    sh = read_sheet(spark, f"{d}/*.csv", "csv", account="t1", sheet_col="sheet")
    rows = sorted((r.sheet, r.row_no, r.MSSV) for r in sh.collect())
    assert [r[2] for r in rows] == [f"{n}{i}" for n in "xy" for i in range(500)]
    for other in ({"fmt": "csv", "multi_line": False}, {"fmt": "json"}):
        with pytest.raises(ValueError):
            read_sheet(spark, f"{d}/x.csv", account="t1", **other)


def test_numeric_cells_read_as_a_sheet_shows_them(spark):
    d = scratch()
    cells = [(20210001.0, "20210001"), (21001.0, "21001"), (0.5, "0.5"), (-7.25, "-7.25"), (12345678.5, "12345678.5"),
             (0.0001, "0.0001"), (-0.0, "0"), (1e15, "1000000000000000"), (float("inf"), "Infinity"),
             (float("nan"), "NaN"), (None, None)]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cells)], "row_no int, x double")
    df.selectExpr("row_no", "x", "cast(x as float) as f", "case when row_no < 4 then cast(x as decimal(12, 3)) end as m",
                  "12 as i").write.parquet(f"{d}/n")
    got = read_sheet(spark, f"{d}/n", "parquet", account="t1").orderBy("row_no").collect()
    assert [r.x for r in got] == [text for _, text in cells]
    assert [r.f for r in got[1:4]] == ["21001", "0.5", "-7.25"]
    assert [r.m for r in got[:5]] == ["20210001", "21001", "0.5", "-7.25", None] and got[0].i == "12"


def test_snapshot_round_trip_skips_admin(spark):
    d = scratch()
    base = seed(spark)
    accounts = base.accounts.unionByName(spark.createDataFrame([("thay", False, 1)], S.ACCOUNTS))
    classes = spark.createDataFrame([("thay", "CT01", 0), ("admin", "A1", 0)], S.CLASSES)
    students = spark.createDataFrame([("thay", "S1", "n", "", "Nam", "CT01", 1.0, 2.0, 1.5, 0),
                                      ("admin", "S9", "m", "", "Nam", "A1", 0.0, 0.0, 0.0, 0)], S.STUDENTS)
    save(Tables(accounts, classes, students), f"{d}/v1")
    v1 = load(spark, f"{d}/v1")
    assert sorted(r.account for r in v1.accounts.collect()) == ["admin", "thay"]
    assert [r.account for r in v1.classes.collect()] == ["thay"]      # admin changes are not kept
    one = load(spark, f"{d}/v1", account="thay")
    assert one.students.count() == 1
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        one.students.explain()
    assert "PartitionFilters: [isnotnull(account_bucket" in buf.getvalue()
    files = {f.split("/account_bucket=")[1].split("/")[0] for f in one.students.inputFiles()}
    assert len(files) == 1                                   # one bucket directory is read
    # a new snapshot with a merge applied; admin keeps the previous rows (none)
    sheet = spark.createDataFrame([(1, "thay", "S1", "CT01", "9", "9")],
                                  "row_no bigint, account string, MSSV string, `Lớp` string, "
                                  "`Điểm quá trình` string, `Điểm kết thúc` string")
    merged = merge_grades(v1.students, sheet, v1.classes).drop("matched")
    save(Tables(v1.accounts, v1.classes, merged), f"{d}/v2", previous=v1)
    v2 = load(spark, f"{d}/v2", account="thay")
    assert v2.students.first().final_grade == 9.0


def test_seed(spark):
    t = seed(spark)
    assert [tuple(r) for r in t.accounts.collect()] == [("admin", True, 0)]
    assert t.classes.count() == 0 and t.students.count() == 0
