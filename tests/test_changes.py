"""Change sets: add students/classes (U2, U3, V5, V6), edits (M4), point grades (M5, V9)."""

from classledger import schema as S
from classledger.operators.changes import add_classes, add_students, edit_students
from classledger.operators.grades import set_grades
from classledger.operators.roster import roster_order

from .fixtures import classes_df, imported

NEW_COLS = "row_no bigint, account string, student_id string, full_name string, birth_date string, " \
           "gender string, class_name string"
EDIT_COLS = "account string, original_id string, student_id string, full_name string, " \
            "birth_date string, gender string, class_name string, midterm double, exam double"


def test_add_students_checks_and_appends(spark):
    new = spark.createDataFrame([(1, "t1", "S10", "Ngô An", "2004-01-01", None, "CT03"),
                                 (2, "t1", "", "X Y", "2004-01-01", "Nữ", "CT03"),
                                 (3, "t1", "S11", "Đỗ An", "", "Nữ", "CT03")], NEW_COLS)
    st, rej = add_students(imported(spark), new)
    assert sorted(r.row_no for r in rej.collect()) == [2, 3]
    r = st.where("student_id = 'S10'").first()
    assert (r.gender, r.midterm, r.exam, r.final_grade) == ("Nam", 0.0, 0.0, 0.0)
    assert r.ord > max(x.ord for x in imported(spark).collect())
    # appended row loses the tie on 'An' against the stored S02
    order = [x.student_id for x in roster_order(st).orderBy("roster_pos").collect()]
    assert order.index("S02") < order.index("S10")


def test_add_classes_skips_blank_keeps_duplicates(spark):
    new = spark.createDataFrame([(1, "t1", ""), (2, "t1", " "), (3, "t1", "CT01"), (4, "t1", None)],
                                "row_no bigint, account string, class_name string")
    got = [r.class_name for r in add_classes(classes_df(spark), new).orderBy("ord").collect()]
    assert got == ["CT01", "CT02", "CT03", " ", "CT01"]


def test_edit_replaces_every_copy_and_keeps_order(spark):
    base = imported(spark)
    copy = spark.createDataFrame([("t1", "S01", "Trần Văn Ánh", "", "Nam", "CT03", 0.0, 0.0, 0.0, 100)],
                                 S.STUDENTS)
    ed = spark.createDataFrame([("t1", "S01", "S01X", "Trần Văn Ánh", "2004-01-02", "Nam", "CT01", 10.0, None)],
                               EDIT_COLS)
    st, rej = edit_students(base.unionByName(copy), ed)
    rows = st.where("student_id = 'S01X'").collect()
    assert len(rows) == 2 and rej.count() == 0
    assert {r.ord for r in rows} == {next(x.ord for x in base.collect() if x.student_id == "S01"), 100}
    assert all((r.class_name, r.midterm, r.exam, r.final_grade) == ("CT01", 10.0, None, 5.0) for r in rows)


def test_conflicting_edits_are_refused(spark):
    ed = spark.createDataFrame([
        ("t1", "S01", "S02", "a", "", "Nam", "CT01", 1.0, 1.0),
        ("t1", "S02", "S09", "b", "", "Nam", "CT01", 2.0, 2.0),
        ("t1", "S03", "S03", "c", "", "Nam", "CT02", 3.0, 3.0),
        ("t1", "S04", "S04", "d", "", "Nam", "CT02", 4.0, 4.0),
        ("t1", "S04", "S04", "e", "", "Nam", "CT02", 5.0, 5.0)], EDIT_COLS)
    st, rej = edit_students(imported(spark), ed)
    assert sorted(r.original_id for r in rej.collect()) == ["S01", "S02", "S04", "S04"]
    assert st.where("student_id = 'S03'").first().final_grade == 3.0


def test_set_grades(spark):
    entries = spark.createDataFrame([
        ("t1", "CT01", "S02", 9.0, 9.0, 1),
        ("t1", "CT01", "S02", 7.0, 0.0, 2),      # last entry wins, zeros are written
        ("t1", "CT03", "S01", 1.0, 1.0, 3),      # class without students
        ("t1", "CT02", "", 1.0, 1.0, 4),         # no student chosen
        ("t2", "CT01", "S01", 1.0, 1.0, 5)],     # account without classes
        "account string, class_name string, student_id string, midterm double, exam double, row_no bigint")
    st, rej = set_grades(imported(spark), classes_df(spark), entries)
    assert sorted((r.row_no, r.reason) for r in rej.collect()) == [
        (3, "class_has_no_students"), (4, "no_student_chosen"), (5, "no_class")]
    r = st.where("student_id = 'S02'").first()
    assert (r.midterm, r.exam, r.final_grade) == (7.0, 0.0, 3.5)
