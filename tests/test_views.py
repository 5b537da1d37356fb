"""Worked example 3: dashboard counts, search, labels and deletes on example 1."""

import pytest

from classledger import schema as S
from classledger.operators.changes import delete_classes, delete_students
from classledger.operators.roster import class_counts, class_list, class_roster, headcount, student_labels
from classledger.operators.search import search_classes, search_students

from .fixtures import classes_df, imported


def test_class_counts(spark):
    got = [(r.class_name, r.n_students) for r in
           class_counts(classes_df(spark), imported(spark)).orderBy("ord").collect()]
    assert got == [("CT01", 2), ("CT02", 3), ("CT03", 0)]


def test_duplicate_class_shows_twice(spark):
    cl = classes_df(spark, names=["CT01", "CT02", "CT01"])
    got = sorted((r.class_name, r.n_students) for r in class_counts(cl, imported(spark)).collect())
    assert got == [("CT01", 2), ("CT01", 2), ("CT02", 3)]


@pytest.mark.parametrize("term,want", [
    ("an", ["S02"]), ("ĐỨC", ["S03"]), ("s0", ["S01", "S02", "S03", "S04", "S05"]), ("", []),
    ("%", []), ("Ân", ["S05"]),
])
def test_student_search(spark, term, want):
    got = sorted(r.student_id for r in search_students(imported(spark), term).collect())
    assert got == want


def test_decomposed_accents_do_not_match(spark):
    import unicodedata
    term = unicodedata.normalize("NFD", "Ánh")
    assert search_students(imported(spark), term).count() == 0


@pytest.mark.parametrize("term,want", [
    ("an", ["CT01"]), ("ct0", ["CT01", "CT02", "CT03"]), ("", ["CT01", "CT02", "CT03"]), ("zz", []),
])
def test_class_search(spark, term, want):
    got = sorted(r.class_name for r in search_classes(classes_df(spark), imported(spark), term).collect())
    assert got == want


def test_labels_of_ct01(spark):
    rows = student_labels(imported(spark)).where("class_name = 'CT01'").orderBy("pos").collect()
    assert [r.label for r in rows] == ["Lê Thị An - S02", "Trần Văn Ánh - S01"]


def test_class_roster_and_headcount(spark):
    rows = class_roster(imported(spark), "CT02").orderBy("pos").collect()
    assert [r.student_id for r in rows] == ["S05", "S04", "S03"]
    assert [r.pos for r in rows] == [1, 2, 3]
    assert headcount(imported(spark), "CT02").first().headcount == 3


def test_class_list_in_insertion_order(spark):
    assert [r.class_name for r in class_list(classes_df(spark)).orderBy("pos").collect()] == \
        ["CT01", "CT02", "CT03"]


def test_delete_class_cascades(spark):
    cl, st = delete_classes(classes_df(spark), imported(spark),
                            spark.createDataFrame([("t1", "CT02")], "account string, class_name string"))
    assert sorted(r.class_name for r in cl.collect()) == ["CT01", "CT03"]
    assert sorted(r.student_id for r in st.collect()) == ["S01", "S02"]


def test_delete_class_keeps_orphans(spark):
    extra = spark.createDataFrame([("t1", "S09", "Hà Vy", "", "Nữ", None, 0.0, 0.0, 0.0, 99)], S.STUDENTS)
    _, st = delete_classes(classes_df(spark), imported(spark).unionByName(extra),
                           spark.createDataFrame([("t1", "CT02")], "account string, class_name string"))
    assert sorted(r.student_id for r in st.collect()) == ["S01", "S02", "S09"]


def test_delete_student_all_copies(spark):
    base = imported(spark)
    keys = spark.createDataFrame([("t1", "S01")], "account string, student_id string")
    assert delete_students(base, keys).count() == 4
    copy = spark.createDataFrame([("t1", "S01", "Trần Văn Ánh", "", "Nam", "CT03", 0.0, 0.0, 0.0, 100)],
                                 S.STUDENTS)
    left = delete_students(base.unionByName(copy), keys)
    assert sorted(r.student_id for r in left.collect()) == ["S02", "S03", "S04", "S05"]
