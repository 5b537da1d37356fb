"""Worked-example tables (FIXTURES.md), built as DataFrames."""

from classledger import schema as S

CLASSES = ["CT01", "CT02", "CT03"]

# (row_no, MSSV, Họ và tên, Ngày sinh, Giới tính, Lớp, Điểm quá trình, Điểm kết thúc, Điểm thi)
ROSTER_ROWS = [
    (1, "S01", "Trần Văn Ánh", "2004-01-02", "Nam", "CT01", "8.3", "8.31", None),
    (2, "S02", "Lê Thị An", "2004-03-04", "Nữ", "CT01", "8.25", None, "8"),
    (3, "S03", "Phạm Đức", "2004-05-06", None, "CT02", None, "0", "7"),
    (4, "S04", "Vũ Dung", None, "Nữ", "CT02", "abc", "9", None),
    (5, "S05", "Ngô Ân ", "2004-07-08", "Nam", "CT02", "7,5", "8", None),
]
ROSTER_HEADERS = ["MSSV", "Họ và tên", "Ngày sinh", "Giới tính", "Lớp", "Điểm quá trình",
                  "Điểm kết thúc", "Điểm thi"]

# (row_no, MSSV, Lớp, Điểm quá trình, Điểm kết thúc, Điểm thi)
GRADE_ROWS = [
    (1, " S01 ", "CT01", "9", "7", None),
    (2, "S01", "CT01", "1", "1", None),
    (3, "S02", "CT02", "10", "10", None),
    (4, "S03", "CT02", None, "0", None),
    (5, "S04", "CT02", "0", "0", "6"),
]
GRADE_HEADERS = ["MSSV", "Lớp", "Điểm quá trình", "Điểm kết thúc", "Điểm thi"]


def sheet(spark, headers, rows, account="t1"):
    cols = ", ".join(["row_no bigint", "account string"] + [f"`{h}` string" for h in headers])
    return spark.createDataFrame([(r[0], account, *r[1:]) for r in rows], cols)


def classes_df(spark, names=CLASSES, account="t1"):
    return spark.createDataFrame([(account, n, i) for i, n in enumerate(names)], S.CLASSES)


def empty_students(spark):
    return spark.createDataFrame([], S.STUDENTS)


def imported(spark):
    """Example 1's state after the import."""
    from classledger.operators.ingest import import_roster
    students, rejects = import_roster(empty_students(spark), classes_df(spark),
                                      sheet(spark, ROSTER_HEADERS, ROSTER_ROWS))
    return students
