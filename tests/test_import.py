"""Worked example 1: roster import (V1-V3, P1, U1, O1)."""

import pytest
from pyspark.sql import functions as F

from classledger.operators.ingest import MissingColumns, import_roster, missing_columns
from classledger.operators.roster import roster_order

from .fixtures import (ROSTER_HEADERS, ROSTER_ROWS, classes_df, empty_students, imported, sheet)


def test_example1_values_and_order(spark):
    st = roster_order(imported(spark))
    rows = st.orderBy("roster_pos").collect()
    assert [r.student_id for r in rows] == ["S05", "S02", "S01", "S04", "S03"]
    got = {r.student_id: (r.gender, r.class_name, r.midterm, r.exam, r.final_grade, r.birth_date)
           for r in rows}
    assert got["S05"] == ("Nam", "CT02", 7.0, 8.0, 7.50, "2004-07-08")
    assert got["S02"] == ("Nữ", "CT01", 8.25, 8.0, 8.13, "2004-03-04")
    assert got["S01"] == ("Nam", "CT01", 8.3, 8.31, 8.30, "2004-01-02")
    assert got["S04"] == ("Nữ", "CT02", 0.0, 9.0, 4.50, "")
    assert got["S03"] == ("Nam", "CT02", 0.0, 7.0, 3.50, "2004-05-06")


def test_unknown_class_rejects_whole_account(spark):
    rows = ROSTER_ROWS + [(6, "S06", "Mai Lan", "2004-01-01", "Nữ", "CT09", "1", "1", None)]
    st, rej = import_roster(empty_students(spark), classes_df(spark), sheet(spark, ROSTER_HEADERS, rows))
    assert st.count() == 0
    r = rej.collect()
    assert [(x.account, x.missing) for x in r] == [("t1", "CT09")]


def test_missing_class_report_first_seen_order(spark):
    rows = [(1, "A", "n a", "d", "Nam", "ZZ", None, None, None),
            (2, "B", "n b", "d", "Nam", "YY", None, None, None),
            (3, "C", "n c", "d", "Nam", "ZZ", None, None, None),
            (4, "D", "n d", "d", "Nam", "CT01 ", None, None, None)]
    _, rej = import_roster(empty_students(spark), classes_df(spark), sheet(spark, ROSTER_HEADERS, rows))
    assert rej.first().missing == "ZZ, YY, CT01 "


def test_missing_columns_reported_all(spark):
    headers = [h for h in ROSTER_HEADERS if h not in ("Giới tính", "Lớp")]
    rows = [tuple(v for h, v in zip(["row_no"] + ROSTER_HEADERS, r) if h not in ("Giới tính", "Lớp"))
            for r in ROSTER_ROWS]
    with pytest.raises(MissingColumns) as e:
        import_roster(empty_students(spark), classes_df(spark), sheet(spark, headers, rows))
    assert e.value.missing == ["Giới tính", "Lớp"]
    assert missing_columns(["MSSV", "Họ Tên", "Ngày tháng năm sinh", "Giới tính", "Lớp Học Phần"]) == []
    assert missing_columns(["mssv"]) == ["MSSV", "Họ và tên", "Ngày sinh", "Giới tính", "Lớp"]


def test_blank_class_is_orphan(spark):
    rows = [(1, "S09", "Hà Vy", "d", "Nữ", None, None, None, None)]
    st, rej = import_roster(empty_students(spark), classes_df(spark), sheet(spark, ROSTER_HEADERS, rows))
    assert rej.count() == 0
    r = st.first()
    assert r.student_id == "S09" and r.class_name is None


def test_import_twice_doubles_and_new_rows_win_ties(spark):
    first = imported(spark)
    st, _ = import_roster(first, classes_df(spark), sheet(spark, ROSTER_HEADERS, ROSTER_ROWS))
    assert st.count() == 10
    ordered = roster_order(st).orderBy("roster_pos").collect()
    # each tie pair: the newer copy (lower ord) comes first
    first_ords = {r.ord for r in first.collect()}
    pairs = [(ordered[i], ordered[i + 1]) for i in range(0, 10, 2)]
    for a, b in pairs:
        assert a.student_id == b.student_id
        assert a.ord not in first_ords and b.ord in first_ords


def test_empty_batch_is_noop(spark):
    empty = sheet(spark, ROSTER_HEADERS, []).where(F.lit(False))
    base = imported(spark)
    st, rej = import_roster(base, classes_df(spark), empty)
    assert st.count() == 5 and rej.count() == 0


def test_several_sheets_equal_one_after_another(spark):
    from classledger.operators.roster import roster_order
    s1 = ROSTER_ROWS[:3]
    s2 = [(1, "S07", "Bùi An", "d", "Nam", "CT01", "1", "2", None),
          (2, "S08", "Đỗ Ánh", "d", "Nữ", "CT09", None, None, None)]      # refused: CT09 unknown
    s3 = [(4, "S09", "Lý An", "d", "Nam", "CT02", "3", "4", None), (9, "S10", "Tô Dung", "d", "Nữ", "CT03", None, "5", None)]
    step = empty_students(spark)
    for rows in (s1, s2, s3):
        step, _ = import_roster(step, classes_df(spark), sheet(spark, ROSTER_HEADERS, rows))
    batch = (sheet(spark, ROSTER_HEADERS, s1).withColumn("sheet_no", F.lit(1))
             .unionByName(sheet(spark, ROSTER_HEADERS, s2).withColumn("sheet_no", F.lit(2)))
             .unionByName(sheet(spark, ROSTER_HEADERS, s3).withColumn("sheet_no", F.lit(3))))
    together, rej = import_roster(empty_students(spark), classes_df(spark), batch, sheet_col="sheet_no")
    assert [(r.sheet_no, r.missing) for r in rej.collect()] == [(2, "CT09")]
    key = lambda df: [r.student_id for r in roster_order(df).orderBy("roster_pos").collect()]
    assert key(together) == key(step)
    assert sorted(map(repr, together.drop("ord").collect())) == sorted(map(repr, step.drop("ord").collect()))


def test_missing_columns_of_several_sheets(spark):
    from classledger.operators.ingest import missing_column_report
    sh = sheet(spark, ROSTER_HEADERS, ROSTER_ROWS)
    full = sh.selectExpr("*", "1 as sheet_no")
    bare = sh.selectExpr("row_no", "account", "`MSSV`", "`Giới tính`", "2 as sheet_no")
    got = missing_column_report(full.unionByName(bare, allowMissingColumns=True), "sheet_no").collect()
    assert [tuple(r) for r in got] == [("t1", 2, "Họ và tên, Ngày sinh, Lớp")]
    assert missing_column_report(full.limit(0), "sheet_no").count() == 0
    assert [r.missing for r in missing_column_report(bare.drop("MSSV")).collect()] == ["MSSV, Họ và tên, Ngày sinh, Lớp"]


def test_a_report_line_is_joined_in_slices(spark):
    from classledger.operators.ingest import missing_class_report
    names = spark.createDataFrame([("t1", f"C{i}", 1000 - i) for i in range(95)] + [("t2", "X", 1)],
                                  "account string, class_name string, first_row int")
    got = {r.account: (r.missing, r.first_row) for r in missing_class_report(names, slice_rows=10).collect()}
    assert got == {"t1": (", ".join(f"C{i}" for i in reversed(range(95))), 906), "t2": ("X", 1)}
