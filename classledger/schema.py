"""Table schemas and the sheet header vocabulary."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Sheet headers and defaults that must equal the reference's.
# Logical column -> accepted headers, in order of preference.
# ---------------------------------------------------------------------------
H_ID = "MSSV"
H_NAME = ("Họ và tên", "Họ Tên")
H_BIRTH = ("Ngày tháng năm sinh", "Ngày sinh")
H_GENDER = "Giới tính"
H_CLASS = ("Lớp", "Lớp Học Phần")
H_MIDTERM = "Điểm quá trình"
H_EXAM = ("Điểm kết thúc", "Điểm thi")

# Required roster columns, each reported under this canonical name when absent.
REQUIRED_ROSTER = (
    ("MSSV", ("MSSV",)),
    ("Họ và tên", ("Họ và tên", "Họ Tên")),
    ("Ngày sinh", ("Ngày tháng năm sinh", "Ngày sinh")),
    ("Giới tính", ("Giới tính",)),
    ("Lớp", ("Lớp", "Lớp Học Phần")),
)

DEFAULT_GENDER = "Nam"
ADMIN_ACCOUNT = "admin"
ROLE_ADMIN = "Quản trị viên"
ROLE_TEACHER = "Giảng viên"
MIN_SECRET_LENGTH = 8
# ---------------------------------------------------------------------------

ALL_SHEET_HEADERS = (H_ID, *H_NAME, *H_BIRTH, H_GENDER, *H_CLASS, H_MIDTERM, *H_EXAM)

ACCOUNTS = T.StructType([
    T.StructField("account", T.StringType()),
    T.StructField("is_admin", T.BooleanType()),
    T.StructField("ord", T.LongType()),
])

CLASSES = T.StructType([
    T.StructField("account", T.StringType()),
    T.StructField("class_name", T.StringType()),
    T.StructField("ord", T.LongType()),
])

STUDENTS = T.StructType([
    T.StructField("account", T.StringType()),
    T.StructField("student_id", T.StringType()),
    T.StructField("full_name", T.StringType()),
    T.StructField("birth_date", T.StringType()),
    T.StructField("gender", T.StringType()),
    T.StructField("class_name", T.StringType()),
    T.StructField("midterm", T.DoubleType()),
    T.StructField("exam", T.DoubleType()),
    T.StructField("final_grade", T.DoubleType()),
    T.StructField("ord", T.LongType()),
])

STUDENT_COLUMNS = tuple(f.name for f in STUDENTS.fields)


def sheet_schema(headers=ALL_SHEET_HEADERS, with_account: bool = True) -> T.StructType:
    """All-string schema for a roster or grade sheet, plus ``row_no``."""
    fields = [T.StructField("row_no", T.LongType(), False)]
    if with_account:
        fields.append(T.StructField("account", T.StringType()))
    fields += [T.StructField(h, T.StringType()) for h in headers]
    return T.StructType(fields)
