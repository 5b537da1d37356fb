"""Oracle SQL (DuckDB dialect) for every registered query.

Written independently of the Spark code from the same semantics, over the
driver's base tables, which DuckDB sees as views. The scalar rules are SQL
fragments below; the regex texts are the same in both engines.
"""

from __future__ import annotations

from ..functions.grades import NUMERIC_CELL, NUMERIC_PREFIX
from ..functions.text import JS_SPACE_CLASS
from . import catalog as C


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def truthy(x: str) -> str:
    return f"(({x}) IS NOT NULL AND ({x}) <> '')"


def js_or(*xs: str) -> str:
    out = xs[-1]
    for x in reversed(xs[:-1]):
        out = f"(CASE WHEN {truthy(x)} THEN ({x}) ELSE {out} END)"
    return out


def js_trim(x: str) -> str:
    pat = f"^{JS_SPACE_CLASS}+|{JS_SPACE_CLASS}+\\z"
    return f"regexp_replace({x}, {q(pat)}, '', 'g')"


def js_key(x: str) -> str:
    return f"coalesce({js_trim(x)}, 'undefined')"


def parse(x: str) -> str:
    v = f"TRY_CAST(NULLIF(regexp_extract(CAST({x} AS VARCHAR), {q('^' + NUMERIC_PREFIX)}, 1), '') AS DOUBLE)"
    return f"(CASE WHEN {v} IS NULL OR {v} = 0 THEN 0.0 ELSE {v} END)"


def gtruthy(x: str) -> str:
    zero = f"(regexp_matches({x}, {q(NUMERIC_CELL)}) AND TRY_CAST({x} AS DOUBLE) = 0)"
    return f"({truthy(x)} AND NOT coalesce({zero}, false))"


def gor(*xs: str) -> str:
    out = xs[-1]
    for x in reversed(xs[:-1]):
        out = f"(CASE WHEN {gtruthy(x)} THEN ({x}) ELSE {out} END)"
    return out


def fixed2(x: str) -> str:
    d = f"CAST(({x}) AS DOUBLE)"
    r = f"(CASE WHEN {d} * 8.0 = floor({d} * 8.0) THEN round({d}, 2) ELSE CAST(printf('%.2f', {d}) AS DOUBLE) END)"
    return f"(CASE WHEN {r} = 0 THEN 0.0 ELSE {r} END)"


def gnum(x: str) -> str:
    return f"(CASE WHEN ({x}) IS NULL OR isnan({x}) OR ({x}) = 0 THEN 0.0 ELSE ({x}) END)"


def final_of(m: str, e: str) -> str:
    return fixed2(f"({gnum(m)} + {gnum(e)}) / 2.0")


def final_text(a: str, b: str) -> str:
    return fixed2(f"({parse(a)} + {parse(b)}) / 2.0")


def roster_key(name: str) -> str:
    return f"(string_split({name}, ' ')[-1]) COLLATE vi"


STUDENT_COLS = "account, student_id, full_name, birth_date, gender, class_name, midterm, exam, final_grade, ord"

def sheet_account(k: str) -> str:
    return f"CASE WHEN {k} % 97 = 0 THEN 'GUEST' WHEN {k} % 89 = 0 THEN 'DESK' ELSE c.account END"


BASE = f"""
acct_region AS (
  SELECT r_regionkey, r_name, CASE WHEN r_regionkey = 0 THEN 'admin' ELSE r_name END AS account,
         r_regionkey = 0 AS is_admin FROM region),
nations AS (
  SELECT n.n_nationkey, n.n_name, n.n_regionkey, a.account
  FROM nation n JOIN acct_region a ON n.n_regionkey = a.r_regionkey),
accounts_v AS (SELECT account, is_admin, CAST(r_regionkey AS BIGINT) AS ord FROM acct_region),
classes_v AS (SELECT account, n_name AS class_name, CAST(n_nationkey AS BIGINT) AS ord FROM nations
  UNION ALL SELECT account, 'CLASS_EMPTY', CAST(r_regionkey + 1000 AS BIGINT) FROM acct_region
  UNION ALL SELECT 'DESK', 'CLASS_DESK', CAST(2000 AS BIGINT) FROM acct_region WHERE r_regionkey = 0),
cust AS (
  SELECT c.*, n.n_name, n.n_nationkey, n.account FROM customer c JOIN nations n ON c.c_nationkey = n.n_nationkey),
students_raw AS (
  SELECT account, CAST(c_custkey AS VARCHAR) AS student_id, c_name AS full_name,
         CAST(DATE '2000-01-01' + CAST(c_custkey % 3650 AS INTEGER) AS VARCHAR) AS birth_date,
         CASE WHEN c_custkey % 3 = 0 THEN 'Nữ' ELSE 'Nam' END AS gender,
         CASE WHEN c_mktsegment = 'AUTOMOBILE' AND c_custkey % 10 = 0 THEN NULL ELSE n_name END AS class_name,
         c_acctbal / 1000.0 AS midterm, abs(c_acctbal) / 1250.0 AS exam, CAST(c_custkey AS BIGINT) AS ord
  FROM cust),
students_v AS (
  SELECT account, student_id, full_name, birth_date, gender, class_name, midterm, exam,
         {final_of('midterm', 'exam')} AS final_grade, ord FROM students_raw)"""

ROSTERS = """
rosters AS (
  SELECT a.account, CAST(p.p_partkey AS VARCHAR) AS student_id, p.p_name AS full_name,
         p.p_brand AS class_name, CAST(p.p_partkey AS BIGINT) AS ord
  FROM part p JOIN acct_region a ON a.r_regionkey = p.p_partkey % 5)"""

GRADE_SHEET = f"""
gs_base AS (
  SELECT o.o_orderkey AS k, o.o_custkey, o.o_totalprice, {sheet_account('o.o_orderkey')} AS account, o.o_orderstatus AS status,
         CASE WHEN o.o_orderstatus = 'P' THEN 'NATION_X' ELSE c.n_name END AS cls
  FROM orders o JOIN cust c ON o.o_custkey = c.c_custkey),
grade_sheet AS (
  SELECT CAST(k AS BIGINT) AS row_no, account,
    CASE WHEN k % 8 = 0 THEN ' ' || CAST(o_custkey AS VARCHAR) || chr(9)
         WHEN k % 8 = 1 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS "MSSV",
    CASE WHEN k % 6 = 0 THEN NULL ELSE cls END AS "Lớp",
    CASE WHEN k % 12 = 0 THEN NULL ELSE cls || ' ' END AS "Lớp Học Phần",
    CASE WHEN k % 7 = 0 THEN NULL WHEN k % 7 = 1 THEN 'abc'
         WHEN k % 7 = 2 THEN CAST(k % 10 AS VARCHAR) || ',5'
         ELSE CAST(o_totalprice / 50000.0 AS VARCHAR) END AS "Điểm quá trình",
    CASE WHEN k % 5 = 0 THEN '0' WHEN k % 5 = 1 THEN NULL WHEN k % 5 = 2 THEN ''
         ELSE CAST(k % 11 AS VARCHAR) END AS "Điểm kết thúc",
    CASE WHEN k % 3 = 0 THEN NULL ELSE CAST(k % 9 AS VARCHAR) || '.75' END AS "Điểm thi",
    status AS sheet_no
  FROM gs_base)"""

SUPP = """
supp AS (SELECT s.*, n.n_name, n.account FROM supplier s JOIN nations n ON s.s_nationkey = n.n_nationkey)"""

ROSTER_SHEET = SUPP + """,
roster_sheet AS (
  SELECT CAST(s_suppkey AS BIGINT) AS row_no, account,
    CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE 'S' || CAST(s_suppkey AS VARCHAR) END AS "MSSV",
    CASE WHEN s_suppkey % 4 = 0 THEN NULL WHEN s_suppkey % 4 = 1 THEN 'Trần Văn ' || s_name
         WHEN s_suppkey % 4 = 2 THEN 'Lê Thị ' || s_name || ' ' ELSE s_name END AS "Họ và tên",
    'Phạm ' || s_name AS "Họ Tên",
    CASE WHEN s_suppkey % 10 = 0 THEN '01/01/2000' ELSE NULL END AS "Ngày tháng năm sinh",
    CASE WHEN s_suppkey % 5 = 0 THEN NULL
         ELSE CAST(DATE '1990-01-01' + CAST(s_suppkey AS INTEGER) AS VARCHAR) END AS "Ngày sinh",
    CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 3 = 1 THEN 'Nữ' ELSE 'Nam' END AS "Giới tính",
    CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 61 = 0 THEN n_name || ' ' ELSE n_name END AS "Lớp",
    CASE WHEN s_suppkey % 49 = 0 THEN 'NATION_X' WHEN s_suppkey % 14 = 0 THEN NULL ELSE n_name END
      AS "Lớp Học Phần",
    CASE WHEN s_suppkey % 6 = 0 THEN NULL WHEN s_suppkey % 6 = 1 THEN 'abc' WHEN s_suppkey % 6 = 2 THEN '7,5'
         ELSE CAST(s_acctbal / 1000.0 AS VARCHAR) END AS "Điểm quá trình",
    CASE WHEN s_suppkey % 5 = 0 THEN '0' WHEN s_suppkey % 5 = 1 THEN NULL
         ELSE CAST(s_suppkey % 11 AS VARCHAR) END AS "Điểm kết thúc",
    CAST(s_suppkey % 10 AS VARCHAR) || '.5' AS "Điểm thi",
    CAST(s_suppkey % 3 AS INTEGER) AS sheet_no
  FROM supp)"""


ADDED_CLASSES = f"""
nc AS (
  SELECT CAST(s_suppkey AS BIGINT) AS row_no, account,
    CASE WHEN s_suppkey % 10 = 0 THEN '' WHEN s_suppkey % 10 = 1 THEN ' ' WHEN s_suppkey % 10 = 2 THEN NULL
         ELSE 'CLASS_' || CAST(s_suppkey % 7 AS VARCHAR) END AS class_name
  FROM supp),
good_c AS (SELECT * FROM nc WHERE {truthy('class_name')}),
top_c AS (SELECT account, max(ord) AS max_ord FROM classes_v GROUP BY account),
fr_c AS (SELECT account, min(row_no) AS min_row FROM good_c GROUP BY account),
classes_grown AS (
  SELECT account, class_name, ord FROM classes_v
  UNION ALL
  SELECT g.account, g.class_name, CAST(coalesce(top_c.max_ord, 0) + 1 + g.row_no - fr_c.min_row AS BIGINT)
  FROM good_c g JOIN fr_c ON g.account = fr_c.account LEFT JOIN top_c ON g.account = top_c.account)"""


SCREENED = f"""
cand AS (
  SELECT CAST(p_partkey * 3 AS BIGINT) AS row_no, CAST(p_partkey AS VARCHAR) AS account,
         CAST(p_size AS INTEGER) AS secret_length FROM part
  UNION ALL SELECT CAST(p_partkey * 3 + 1 AS BIGINT), p_name, CAST(p_size AS INTEGER) FROM part
  UNION ALL SELECT CAST(p_partkey * 3 + 2 AS BIGINT), p_brand, CAST(p_size AS INTEGER) FROM part
  UNION ALL SELECT CAST(-r_regionkey - 1 AS BIGINT), account, 10 FROM acct_region),
ruled AS (
  SELECT *, CASE WHEN regexp_matches(account, '^[0-9]') THEN 'starts_with_digit'
                 WHEN regexp_matches(account, {q(JS_SPACE_CLASS)}) THEN 'contains_whitespace'
                 WHEN secret_length < 8 THEN 'secret_too_short' END AS rule
  FROM cand),
first_ok AS (SELECT account, min(row_no) AS first_row FROM ruled WHERE rule IS NULL GROUP BY account),
taken AS (SELECT DISTINCT account FROM accounts_v),
screened AS (
  SELECT r.row_no, r.account, r.secret_length,
    CASE WHEN r.rule IS NOT NULL THEN r.rule WHEN t.account IS NOT NULL THEN 'already_exists'
         WHEN r.row_no = f.first_row THEN 'accepted' ELSE 'already_exists' END AS verdict
  FROM ruled r LEFT JOIN first_ok f ON r.account = f.account LEFT JOIN taken t ON r.account = t.account)"""

REGISTERED = SCREENED + """,
reg AS (
  SELECT account, is_admin, ord FROM accounts_v
  UNION ALL
  SELECT account, false, CAST((SELECT coalesce(max(ord), 0) FROM accounts_v) + 1 + row_no
         - (SELECT min(row_no) FROM screened WHERE verdict = 'accepted') AS BIGINT)
  FROM screened WHERE verdict = 'accepted')"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


def merged_sql() -> str:
    return with_(BASE, GRADE_SHEET, f"""
keyed AS (
  SELECT account, row_no, {js_key('"MSSV"')} AS id_key,
         {js_key(js_or('"Lớp"', '"Lớp Học Phần"'))} AS class_key,
         "Điểm quá trình" AS mid, "Điểm kết thúc" AS kt, "Điểm thi" AS thi
  FROM grade_sheet WHERE account IN (SELECT account FROM classes_v)),
first_row AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account, id_key, class_key ORDER BY row_no) AS rn
                 FROM keyed) WHERE rn = 1),
j AS (
  SELECT s.*, f.mid, f.kt, f.thi, f.account IS NOT NULL AS matched
  FROM students_v s LEFT JOIN first_row f
    ON s.account = f.account AND {js_key('s.student_id')} = f.id_key AND {js_key('s.class_name')} = f.class_key),
m AS (
  SELECT account, student_id, full_name, birth_date, gender, class_name,
    CASE WHEN matched AND mid IS NOT NULL THEN {parse('mid')} ELSE midterm END AS midterm,
    CASE WHEN matched AND {gtruthy('kt')} THEN {parse('kt')}
         WHEN matched AND {gtruthy('thi')} THEN {parse('thi')} ELSE exam END AS exam,
    final_grade, ord, matched FROM j),
merged AS (
  SELECT account, student_id, full_name, birth_date, gender, class_name, midterm, exam,
    CASE WHEN matched THEN {final_of('midterm', 'exam')} ELSE final_grade END AS final_grade, ord, matched
  FROM m)""")


def merged_sheets_sql() -> str:
    """Several sheets applied in ``sheet_no`` order: per sheet the first row
    of a key, then the latest present midterm and the latest truthy exam cell."""
    return with_(BASE, GRADE_SHEET, f"""
keyed AS (
  SELECT account, row_no, sheet_no, {js_key('"MSSV"')} AS id_key,
         {js_key(js_or('"Lớp"', '"Lớp Học Phần"'))} AS class_key,
         "Điểm quá trình" AS mid, "Điểm kết thúc" AS kt, "Điểm thi" AS thi
  FROM grade_sheet WHERE account IN (SELECT account FROM classes_v)),
first_row AS (
  SELECT *, CASE WHEN {gtruthy('kt')} THEN kt WHEN {gtruthy('thi')} THEN thi END AS exam_cell
  FROM (SELECT *, row_number() OVER (PARTITION BY account, id_key, class_key, sheet_no ORDER BY row_no) AS rn
        FROM keyed) WHERE rn = 1),
folded AS (
  SELECT account, id_key, class_key,
    arg_max(mid, sheet_no) FILTER (WHERE mid IS NOT NULL) AS mid,
    arg_max(exam_cell, sheet_no) FILTER (WHERE exam_cell IS NOT NULL) AS exam_cell
  FROM first_row GROUP BY account, id_key, class_key),
j AS (
  SELECT s.*, f.mid, f.exam_cell, f.account IS NOT NULL AS matched
  FROM students_v s LEFT JOIN folded f
    ON s.account = f.account AND {js_key('s.student_id')} = f.id_key AND {js_key('s.class_name')} = f.class_key),
m AS (
  SELECT account, student_id, full_name, birth_date, gender, class_name,
    CASE WHEN matched AND mid IS NOT NULL THEN {parse('mid')} ELSE midterm END AS midterm,
    CASE WHEN matched AND exam_cell IS NOT NULL THEN {parse('exam_cell')} ELSE exam END AS exam,
    final_grade, ord, matched FROM j)""") + f"""
SELECT account, student_id, full_name, birth_date, gender, class_name, midterm, exam,
  CASE WHEN matched THEN {final_of('midterm', 'exam')} ELSE final_grade END AS final_grade, ord, matched
FROM m"""


def _sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out["class_counts"] = with_(BASE, """
cnt AS (SELECT account, class_name, count(*) AS n FROM students_v WHERE class_name IS NOT NULL GROUP BY 1, 2)""") + """
SELECT c.account, c.class_name, c.ord, CAST(coalesce(cnt.n, 0) AS BIGINT) AS n_students
FROM classes_v c LEFT JOIN cnt ON c.account = cnt.account AND c.class_name = cnt.class_name"""

    out["grade_merge"] = merged_sql() + "SELECT * FROM merged"
    out["grade_merge_sheets"] = merged_sheets_sql()
    out["grade_merge_count"] = merged_sql() + \
        "SELECT account, CAST(count(*) FILTER (WHERE matched) AS BIGINT) AS updated FROM merged GROUP BY account"

    out["grade_import_report"] = merged_sql().rstrip("\n") + """,
allowed AS (SELECT DISTINCT account FROM classes_v WHERE account IN (SELECT account FROM students_v)),
cnt AS (SELECT account, count(*) FILTER (WHERE matched) AS n FROM merged GROUP BY account),
named AS (SELECT DISTINCT account FROM grade_sheet)
SELECT n.account,
  CASE WHEN a.account IS NULL THEN 'refused' WHEN coalesce(c.n, 0) = 0 THEN 'no_match' ELSE 'updated' END AS status,
  CAST(CASE WHEN a.account IS NULL THEN 0 ELSE coalesce(c.n, 0) END AS BIGINT) AS updated
FROM named n LEFT JOIN allowed a ON n.account = a.account LEFT JOIN cnt c ON n.account = c.account"""
    out["grade_import_report_sheets"] = with_(BASE, GRADE_SHEET, f"""
keyed AS (
  SELECT account, sheet_no, {js_key('"MSSV"')} AS id_key, {js_key(js_or('"Lớp"', '"Lớp Học Phần"'))} AS class_key
  FROM grade_sheet WHERE account IN (SELECT account FROM classes_v)),
sheet_keys AS (SELECT DISTINCT account, sheet_no, id_key, class_key FROM keyed),
cnt AS (
  SELECT k.account, k.sheet_no, count(*) AS n FROM students_v s JOIN sheet_keys k
    ON s.account = k.account AND {js_key('s.student_id')} = k.id_key AND {js_key('s.class_name')} = k.class_key
  GROUP BY k.account, k.sheet_no),
allowed AS (SELECT DISTINCT account FROM classes_v WHERE account IN (SELECT account FROM students_v)),
named AS (SELECT DISTINCT account, sheet_no FROM grade_sheet)""") + """
SELECT n.account, n.sheet_no,
  CASE WHEN a.account IS NULL THEN 'refused' WHEN coalesce(c.n, 0) = 0 THEN 'no_match' ELSE 'updated' END AS status,
  CAST(CASE WHEN a.account IS NULL THEN 0 ELSE coalesce(c.n, 0) END AS BIGINT) AS updated
FROM named n LEFT JOIN allowed a ON n.account = a.account
LEFT JOIN cnt c ON n.account = c.account AND n.sheet_no = c.sheet_no"""
    out["roster_positions"] = with_(BASE, ROSTERS) + f"""
SELECT account, class_name, student_id, full_name,
  CAST(row_number() OVER (PARTITION BY account, class_name ORDER BY {roster_key('full_name')} NULLS FIRST, ord) AS BIGINT) AS pos
FROM rosters"""
    out["roster_order"] = with_(BASE, ROSTERS) + f"""
SELECT account, student_id, full_name,
  CAST(row_number() OVER (PARTITION BY account ORDER BY {roster_key('full_name')} NULLS FIRST, ord) AS BIGINT) AS roster_pos
FROM rosters"""

    t = q(C.STUDENT_TERM)
    out["student_search"] = with_(BASE) + f"""
SELECT account, student_id, full_name, class_name, midterm, exam, final_grade, ord FROM students_v
WHERE contains(lower(full_name), lower({t})) OR contains(lower(student_id), lower({t}))"""

    t = q(C.CLASS_TERM)
    out["class_search"] = with_(BASE) + f"""
SELECT c.account, c.class_name, c.ord FROM classes_v c
WHERE contains(lower(c.class_name), lower({t})) OR EXISTS (
  SELECT 1 FROM students_v s WHERE s.account = c.account AND s.class_name = c.class_name
    AND (contains(lower(s.full_name), lower({t})) OR contains(lower(s.student_id), lower({t}))))"""

    cls = q(C.ROSTER_CLASS)
    out["class_roster"] = with_(BASE) + f"""
SELECT account, class_name, student_id, full_name, birth_date, gender, midterm, exam, final_grade,
  CAST(row_number() OVER (PARTITION BY account, class_name ORDER BY {roster_key('full_name')} NULLS FIRST, ord) AS BIGINT) AS pos
FROM students_v WHERE class_name = {cls}"""
    out["headcount"] = with_(BASE) + f"""
SELECT account, count(*) AS headcount FROM students_v WHERE class_name = {cls} GROUP BY account"""
    out["student_labels"] = with_(BASE) + f"""
SELECT account, class_name, student_id, concat_ws(' - ', full_name, student_id) AS label,
  CAST(row_number() OVER (PARTITION BY account, class_name ORDER BY {roster_key('full_name')} NULLS FIRST, ord) AS BIGINT) AS pos
FROM students_v WHERE class_name IS NOT NULL"""
    out["class_list"] = with_(BASE, SUPP, ADDED_CLASSES) + """
SELECT account, class_name, CAST(row_number() OVER (PARTITION BY account ORDER BY ord) AS BIGINT) AS pos
FROM classes_grown"""

    sheet_class = js_or('"Lớp"', '"Lớp Học Phần"')
    missing = f"""
named AS (SELECT account, row_no, {sheet_class} AS class_name FROM roster_sheet),
missing AS (
  SELECT account, class_name, min(row_no) AS first_row FROM named n
  WHERE {truthy('class_name')} AND NOT EXISTS (
    SELECT 1 FROM classes_v c WHERE c.account = n.account AND c.class_name = n.class_name)
  GROUP BY account, class_name)"""
    out["missing_classes"] = with_(BASE, ROSTER_SHEET, missing) + "SELECT * FROM missing"
    out["missing_class_report"] = with_(BASE, ROSTER_SHEET, missing) + """
SELECT account, string_agg(class_name, ', ' ORDER BY first_row) AS missing, min(first_row) AS first_row
FROM missing GROUP BY account"""
    out["roster_import"] = with_(BASE, ROSTER_SHEET, missing, f"""
acc_rows AS (SELECT * FROM roster_sheet WHERE account NOT IN (SELECT account FROM missing)),
rows_n AS (
  SELECT account, row_no, {js_or('"MSSV"', "''")} AS student_id,
    {js_or('"Họ và tên"', '"Họ Tên"', "''")} AS full_name,
    {js_or('"Ngày tháng năm sinh"', '"Ngày sinh"', "''")} AS birth_date,
    {js_or('"Giới tính"', "'Nam'")} AS gender, {sheet_class} AS class_name,
    {parse('"Điểm quá trình"')} AS midterm, {parse(gor('"Điểm kết thúc"', '"Điểm thi"'))} AS exam
  FROM acc_rows),
fl AS (SELECT account, min(ord) AS min_ord FROM students_v GROUP BY account),
lr AS (SELECT account, max(row_no) AS max_row FROM rows_n GROUP BY account)""") + f"""
SELECT {STUDENT_COLS} FROM students_v
UNION ALL
SELECT r.account, r.student_id, r.full_name, r.birth_date, r.gender, r.class_name, r.midterm, r.exam,
  {final_of('r.midterm', 'r.exam')} AS final_grade,
  CAST(coalesce(fl.min_ord, 1) - 1 - (lr.max_row - r.row_no) AS BIGINT) AS ord
FROM rows_n r JOIN lr ON r.account = lr.account LEFT JOIN fl ON r.account = fl.account"""

    out["roster_import_sheets"] = with_(BASE, ROSTER_SHEET, f"""
named_s AS (SELECT account, sheet_no, row_no, {sheet_class} AS class_name FROM roster_sheet),
refused AS (
  SELECT DISTINCT account, sheet_no FROM named_s n
  WHERE {truthy('class_name')} AND NOT EXISTS (
    SELECT 1 FROM classes_v c WHERE c.account = n.account AND c.class_name = n.class_name)),
acc_rows AS (
  SELECT r.* FROM roster_sheet r
  WHERE NOT EXISTS (SELECT 1 FROM refused f WHERE f.account = r.account AND f.sheet_no = r.sheet_no)),
rows_n AS (
  SELECT account, sheet_no, row_no, {js_or('"MSSV"', "''")} AS student_id,
    {js_or('"Họ và tên"', '"Họ Tên"', "''")} AS full_name,
    {js_or('"Ngày tháng năm sinh"', '"Ngày sinh"', "''")} AS birth_date,
    {js_or('"Giới tính"', "'Nam'")} AS gender, {sheet_class} AS class_name,
    {parse('"Điểm quá trình"')} AS midterm, {parse(gor('"Điểm kết thúc"', '"Điểm thi"'))} AS exam
  FROM acc_rows),
fl AS (SELECT account, min(ord) AS min_ord FROM students_v GROUP BY account),
spans AS (
  SELECT account, sheet_no, max(row_no) AS max_row, max(row_no) - min(row_no) + 1 AS span
  FROM rows_n GROUP BY account, sheet_no),
before AS (
  SELECT *, coalesce(sum(span) OVER (PARTITION BY account ORDER BY sheet_no
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_span
  FROM spans)""") + f"""
SELECT {STUDENT_COLS} FROM students_v
UNION ALL
SELECT r.account, r.student_id, r.full_name, r.birth_date, r.gender, r.class_name, r.midterm, r.exam,
  {final_of('r.midterm', 'r.exam')} AS final_grade,
  CAST(coalesce(fl.min_ord, 1) - 1 - b.before_span - (b.max_row - r.row_no) AS BIGINT) AS ord
FROM rows_n r JOIN before b ON r.account = b.account AND r.sheet_no = b.sheet_no
LEFT JOIN fl ON r.account = fl.account"""

    a, b = "regexp_replace(props, '^[^0-9.+-]*', '')", "(CAST(value AS VARCHAR) || event_type)"
    out["parse_grades"] = f"""
SELECT event_id, {parse(a)} AS midterm, {parse(b)} AS exam, {final_text(a, b)} AS final_grade,
  {gtruthy(a)} AS cell_truthy FROM events"""

    class_keys = """
ckeys AS (SELECT account, n_name AS class_name FROM nations WHERE n_regionkey = 2)"""
    out["delete_classes"] = with_(BASE, SUPP, ADDED_CLASSES, class_keys) + """
SELECT * FROM classes_grown c WHERE NOT EXISTS (
  SELECT 1 FROM ckeys k WHERE k.account = c.account AND k.class_name = c.class_name)"""
    out["delete_classes_students"] = with_(BASE, class_keys) + f"""
SELECT {STUDENT_COLS} FROM students_v s WHERE NOT EXISTS (
  SELECT 1 FROM ckeys k WHERE k.account = s.account AND k.class_name = s.class_name)"""
    out["delete_students"] = with_(BASE, """
skeys AS (SELECT account, CAST(c_custkey AS VARCHAR) AS student_id FROM cust WHERE c_mktsegment = 'MACHINERY')""") + f"""
SELECT {STUDENT_COLS} FROM students_v s WHERE NOT EXISTS (
  SELECT 1 FROM skeys k WHERE k.account = s.account AND k.student_id = s.student_id)"""
    akeys = """
akeys AS (SELECT account FROM acct_region WHERE r_name LIKE 'A%' AND account <> 'admin')"""
    out["delete_accounts"] = with_(BASE, REGISTERED, akeys) + \
        "SELECT * FROM reg WHERE account NOT IN (SELECT account FROM akeys)"
    out["delete_accounts_students"] = with_(BASE, akeys) + \
        f"SELECT {STUDENT_COLS} FROM students_v WHERE account NOT IN (SELECT account FROM akeys)"

    out["delete_accounts_classes"] = with_(BASE, SUPP, ADDED_CLASSES, akeys) + \
        "SELECT * FROM classes_grown WHERE account NOT IN (SELECT account FROM akeys)"

    def replaced(side: str) -> str:
        cols = ", ".join(f"CASE WHEN g.account IS NOT NULL THEN g.{c} ELSE s.{c} END AS {c}" for c in (
            "student_id", "full_name", "birth_date", "gender", "class_name", "midterm", "exam"))
        return f"""
SELECT s.account, {cols},
  CASE WHEN g.account IS NOT NULL THEN {final_of('g.midterm', 'g.exam')} ELSE s.final_grade END AS final_grade,
  s.ord
FROM students_v s LEFT JOIN {side} g ON s.account = g.account AND s.student_id = g.original_id"""

    def edits(new_id: str) -> str:
        return f"""
ed AS (
  SELECT account, CAST(c_custkey AS VARCHAR) AS original_id, {new_id} AS student_id,
    upper(c_name) AS full_name, '1999-09-09' AS birth_date, 'Nữ' AS gender, n_name AS class_name,
    c_acctbal / 500.0 AS midterm, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 9.5 END AS exam
  FROM cust),
dup AS (SELECT account, original_id FROM ed GROUP BY 1, 2 HAVING count(*) > 1),
onto AS (
  SELECT e.* FROM ed e WHERE EXISTS (
    SELECT 1 FROM ed o WHERE o.account = e.account AND o.original_id = e.student_id
      AND e.original_id <> o.original_id)),
bad AS (SELECT account, original_id FROM dup UNION SELECT account, original_id FROM onto
        UNION SELECT account, student_id FROM onto),
good AS (SELECT * FROM ed e WHERE NOT EXISTS (
  SELECT 1 FROM bad b WHERE b.account = e.account AND b.original_id = e.original_id))"""

    key = "CAST(c_custkey AS VARCHAR)"
    renamed = f"CASE WHEN c_custkey % 5 = 0 THEN 'E' || {key} ELSE {key} END"
    out["edit_students"] = with_(BASE, edits(renamed)) + replaced("good")
    out["edit_students_rejects"] = with_(
        BASE, edits(f"CASE WHEN c_custkey % 11 = 0 THEN CAST(c_custkey + 5 AS VARCHAR) ELSE {renamed} END")) + """
SELECT account, original_id, student_id, 'conflicting_edit' AS reason FROM ed e WHERE EXISTS (
  SELECT 1 FROM bad b WHERE b.account = e.account AND b.original_id = e.original_id)"""

    # An edit's next edit is the first later one of the id it gives; the chain is followed one edit at a time.
    out["edit_students_in_order"] = with_(BASE, """
oe AS (
  SELECT CAST(o.o_orderkey AS BIGINT) AS row_no, c.account,
    CASE WHEN o.o_orderkey % 5 = 0 THEN 'E' || CAST(o.o_custkey AS VARCHAR) ELSE CAST(o.o_custkey AS VARCHAR) END AS original_id,
    CASE WHEN o.o_orderkey % 4 = 0 THEN 'E' || CAST(o.o_custkey AS VARCHAR)
         WHEN o.o_orderkey % 4 = 1 THEN CAST(o.o_custkey + 25 AS VARCHAR)
         ELSE CAST(o.o_custkey AS VARCHAR) END AS student_id,
    'Edit ' || CAST(o.o_orderkey AS VARCHAR) AS full_name, '1999-09-09' AS birth_date, 'Nam' AS gender,
    c.n_name AS class_name, o.o_totalprice / 60000.0 AS midterm,
    CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE CAST(o.o_orderkey % 10 AS DOUBLE) END AS exam
  FROM orders o JOIN cust c ON o.o_custkey = c.c_custkey),
nxt AS (
  SELECT e.account, e.row_no, min(o.row_no) AS next_row FROM oe e JOIN oe o
    ON e.account = o.account AND e.student_id = o.original_id AND e.row_no < o.row_no GROUP BY 1, 2),
chain AS (
  SELECT account, original_id, min(row_no) AS row_no FROM oe GROUP BY 1, 2
  UNION ALL
  SELECT c.account, c.original_id, n.next_row FROM chain c JOIN nxt n ON c.account = n.account AND c.row_no = n.row_no),
last AS (SELECT account, original_id, max(row_no) AS row_no FROM chain GROUP BY 1, 2),
fin AS (
  SELECT l.account, l.original_id, e.student_id, e.full_name, e.birth_date, e.gender, e.class_name, e.midterm, e.exam
  FROM last l JOIN oe e ON l.account = e.account AND l.row_no = e.row_no)""").replace("WITH", "WITH RECURSIVE", 1) + replaced("fin")

    entries = with_(BASE, f"""
ent AS (
  SELECT CAST(o.o_orderkey AS BIGINT) AS row_no, {sheet_account('o.o_orderkey')} AS account,
    CASE WHEN o.o_orderstatus = 'P' THEN 'CLASS_EMPTY' ELSE c.n_name END AS class_name,
    CASE WHEN o.o_orderkey % 10 = 0 THEN '' ELSE CAST(o.o_custkey AS VARCHAR) END AS student_id,
    o.o_totalprice / 60000.0 AS midterm, CAST(o.o_orderkey % 10 AS DOUBLE) AS exam
  FROM orders o JOIN cust c ON o.o_custkey = c.c_custkey),
pop AS (SELECT DISTINCT account, class_name FROM students_v WHERE class_name IS NOT NULL),
chk AS (
  SELECT e.*, CASE
    WHEN e.account NOT IN (SELECT account FROM classes_v) THEN 'no_class'
    WHEN {truthy('e.class_name')} AND NOT EXISTS (
      SELECT 1 FROM pop p WHERE p.account = e.account AND p.class_name = e.class_name)
      THEN 'class_has_no_students'
    WHEN NOT {truthy('e.student_id')} THEN 'no_student_chosen' END AS reason
  FROM ent e),
latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account, student_id ORDER BY row_no DESC) AS rn
                 FROM chk WHERE reason IS NULL) WHERE rn = 1)""")
    out["set_grades"] = entries + f"""
SELECT s.account, s.student_id, s.full_name, s.birth_date, s.gender, s.class_name,
  CASE WHEN l.account IS NOT NULL THEN l.midterm ELSE s.midterm END AS midterm,
  CASE WHEN l.account IS NOT NULL THEN l.exam ELSE s.exam END AS exam,
  CASE WHEN l.account IS NOT NULL THEN {final_of('l.midterm', 'l.exam')} ELSE s.final_grade END AS final_grade,
  s.ord
FROM students_v s LEFT JOIN latest l ON s.account = l.account AND s.student_id = l.student_id"""
    out["set_grades_rejects"] = entries + "SELECT row_no, account, student_id, reason FROM chk WHERE reason IS NOT NULL"

    new_students = with_(BASE, SUPP, f"""
ns AS (
  SELECT CAST(s_suppkey AS BIGINT) AS row_no, account,
    CASE WHEN s_suppkey % 11 = 0 THEN '' ELSE 'N' || CAST(s_suppkey AS VARCHAR) END AS student_id,
    CASE WHEN s_suppkey % 13 = 0 THEN NULL ELSE 'Võ ' || s_name END AS full_name,
    CASE WHEN s_suppkey % 17 = 0 THEN '' ELSE '2001-02-03' END AS birth_date,
    CASE WHEN s_suppkey % 2 = 0 THEN 'Nữ' ELSE NULL END AS gender,
    CASE WHEN s_suppkey % 19 = 0 THEN NULL ELSE n_name END AS class_name
  FROM supp),
chk AS (SELECT *, coalesce({truthy('student_id')} AND {truthy('full_name')} AND {truthy('birth_date')}
                          AND {truthy('class_name')}, false) AS ok FROM ns),
good AS (SELECT * FROM chk WHERE ok),
top AS (SELECT account, max(ord) AS max_ord FROM students_v GROUP BY account),
fr AS (SELECT account, min(row_no) AS min_row FROM good GROUP BY account)""")
    out["add_students"] = new_students + f"""
SELECT {STUDENT_COLS} FROM students_v
UNION ALL
SELECT g.account, g.student_id, g.full_name, g.birth_date, {js_or('g.gender', "'Nam'")} AS gender,
  g.class_name, 0.0, 0.0, 0.0, CAST(coalesce(top.max_ord, 0) + 1 + g.row_no - fr.min_row AS BIGINT)
FROM good g JOIN fr ON g.account = fr.account LEFT JOIN top ON g.account = top.account"""
    out["add_students_rejects"] = new_students + \
        "SELECT row_no, account, 'missing_required' AS reason FROM chk WHERE NOT ok"

    out["add_classes"] = with_(BASE, SUPP, ADDED_CLASSES) + """
SELECT * FROM classes_grown"""
    out["screen_accounts"] = with_(BASE, SCREENED) + "SELECT * FROM screened"
    out["account_listing"] = with_(BASE, REGISTERED, """
ncls AS (SELECT account, count(*) AS n FROM classes_v GROUP BY account)""") + """
SELECT CAST(row_number() OVER (ORDER BY r.ord) AS BIGINT) AS no, r.account,
  CASE WHEN r.is_admin THEN 'Quản trị viên' ELSE 'Giảng viên' END AS role,
  CAST(coalesce(n.n, 0) AS BIGINT) AS n_classes
FROM reg r LEFT JOIN ncls n ON r.account = n.account"""
    required = {"MSSV": (["MSSV"], "3, 8"), "Họ và tên": (["Họ và tên", "Họ Tên"], "4, 8"),
                "Ngày sinh": (["Ngày tháng năm sinh", "Ngày sinh"], "5, 8"), "Giới tính": (["Giới tính"], "6, 8")}
    parts = [f"""CASE WHEN count(coalesce({', '.join(f'"{c}"' for c in cols)}))
      FILTER (WHERE no NOT IN ({nos})) = 0 THEN '{canon}' END""" for canon, (cols, nos) in required.items()]
    parts.append("""CASE WHEN count("Lớp") FILTER (WHERE no NOT IN (7, 8)) + count("Lớp Học Phần") FILTER (WHERE no NOT IN (7)) = 0
      THEN 'Lớp' END""")
    out["missing_columns"] = with_(BASE, ROSTER_SHEET, f"""
cut AS (SELECT *, CAST(row_no % 11 AS INTEGER) AS no FROM roster_sheet),
found AS (SELECT account, no AS sheet_no, concat_ws(', ', {', '.join(parts)}) AS missing FROM cut GROUP BY account, no)""") + """
SELECT * FROM found WHERE missing <> ''"""
    out["grade_merge_bucketed"] = out["grade_merge"]
    out["set_grades_bucketed"] = out["set_grades"]
    out["sheet_read_back"] = with_(BASE, GRADE_SHEET) + """
SELECT row_no, account, "MSSV" AS id, "Lớp Học Phần" AS class_name, "Điểm quá trình" AS midterm, "Điểm kết thúc" AS exam
FROM grade_sheet"""
    out["snapshot_students"] = with_(BASE) + f"SELECT {STUDENT_COLS} FROM students_v WHERE account <> 'admin'"
    out["snapshot_update"] = merged_sql() + f"""
SELECT {STUDENT_COLS} FROM students_v WHERE account NOT IN ('admin', 'AMERICA', 'ASIA')
UNION ALL SELECT {STUDENT_COLS} FROM merged WHERE account = 'ASIA'"""
    out["seed_listing"] = with_(BASE, SCREENED.replace("SELECT DISTINCT account FROM accounts_v", "SELECT 'admin' AS account"), """
reg AS (
  SELECT 'admin' AS account, true AS is_admin, CAST(0 AS BIGINT) AS ord
  UNION ALL
  SELECT account, false, CAST(1 + row_no - (SELECT min(row_no) FROM screened WHERE verdict = 'accepted') AS BIGINT)
  FROM screened WHERE verdict = 'accepted')""") + """
SELECT CAST(row_number() OVER (ORDER BY ord) AS BIGINT) AS no, account,
  CASE WHEN is_admin THEN 'Quản trị viên' ELSE 'Giảng viên' END AS role, CAST(0 AS BIGINT) AS n_classes FROM reg"""
    placed = "CAST(row_number() OVER (PARTITION BY account ORDER BY ord) - 1 AS BIGINT) AS ord"
    out["nested_students"] = with_(BASE) + f"SELECT {STUDENT_COLS.replace('ord', placed)} FROM students_v"
    listed = "FROM classes_grown WHERE account IN (SELECT account FROM accounts_v)"
    out["nested_classes"] = with_(BASE, SUPP, ADDED_CLASSES) + f"SELECT account, class_name, {placed} {listed}"
    out["nested_class_sizes"] = with_(BASE, SUPP, ADDED_CLASSES) + \
        f"SELECT account, CAST(count(*) AS BIGINT) AS n_classes {listed} GROUP BY account"

    t = js_trim("birth_date")
    iso = f"TRY_CAST(NULLIF(regexp_extract({t}, '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})(?:[T ].*)?$', 1), '') AS DATE)"
    dmy = f"CAST(TRY_STRPTIME(NULLIF(regexp_extract({t}, '^([0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}})$', 1), ''), '%d/%m/%Y') AS DATE)"
    num = f"TRY_CAST(NULLIF(regexp_extract({t}, '^([0-9]{{1,7}})(?:[.][0-9]*)?$', 1), '') AS INTEGER)"
    out["birth_days"] = with_(BASE, f"""
texts AS (
  SELECT account, student_id, ord AS k, DATE '1899-12-30' + CAST(ord % 40000 AS INTEGER) AS d FROM students_v),
spelt AS (
  SELECT account, student_id, CASE k % 8 WHEN 0 THEN CAST(d AS VARCHAR) WHEN 1 THEN strftime(d, '%-d/%-m/%Y')
    WHEN 2 THEN CAST(k % 40000 AS VARCHAR) WHEN 3 THEN CAST(k % 40000 AS VARCHAR) || '.5 '
    WHEN 4 THEN CAST(d AS VARCHAR) || 'T10:00:00' WHEN 5 THEN '30/2/2004' WHEN 6 THEN '' END AS birth_date FROM texts),
nums AS (SELECT *, {num} AS n FROM spelt)""") + f"""
SELECT account, student_id, birth_date, coalesce({iso}, {dmy},
  CASE WHEN n BETWEEN 1 AND 59 THEN DATE '1899-12-30' + (n + 1) WHEN n BETWEEN 61 AND 2958465 THEN DATE '1899-12-30' + n END)
  AS birth_day FROM nums"""
    return out


ORACLE_SQL: dict[str, str] = _sql()
