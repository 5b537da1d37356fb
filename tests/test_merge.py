"""Worked example 2: grade merge (M6, J2, A4, V4, V10)."""

from classledger.operators.grades import merge_counts, merge_grades

from .fixtures import GRADE_HEADERS, GRADE_ROWS, classes_df, imported, sheet


def test_example2(spark):
    merged = merge_grades(imported(spark), sheet(spark, GRADE_HEADERS, GRADE_ROWS), classes_df(spark))
    got = {r.student_id: (r.midterm, r.exam, r.final_grade, r.matched) for r in merged.collect()}
    assert got == {
        "S01": (9.0, 7.0, 8.00, True),
        "S02": (8.25, 8.0, 8.13, False),
        "S03": (0.0, 7.0, 3.50, True),
        "S04": (0.0, 6.0, 3.00, True),
        "S05": (7.0, 8.0, 7.50, False),
    }
    assert [(r.account, r.updated) for r in merge_counts(merged).collect()] == [("t1", 3)]


def test_no_match_changes_nothing(spark):
    base = imported(spark)
    merged = merge_grades(base, sheet(spark, GRADE_HEADERS, [GRADE_ROWS[2]]), classes_df(spark))
    assert merge_counts(merged).first().updated == 0
    assert sorted(merged.drop("matched").collect()) == sorted(base.collect())


def test_merge_is_idempotent_and_keeps_row_count(spark):
    s = sheet(spark, GRADE_HEADERS, GRADE_ROWS)
    once = merge_grades(imported(spark), s, classes_df(spark)).drop("matched")
    twice = merge_grades(once, s, classes_df(spark)).drop("matched")
    assert once.count() == 5
    assert sorted(once.collect()) == sorted(twice.collect())


def test_account_without_classes_takes_nothing(spark):
    no_classes = classes_df(spark, names=[])
    merged = merge_grades(imported(spark), sheet(spark, GRADE_HEADERS, GRADE_ROWS), no_classes)
    assert merge_counts(merged).first().updated == 0


def test_orphan_matches_sheet_row_without_class(spark):
    from classledger.operators.ingest import import_roster
    from .fixtures import ROSTER_HEADERS, empty_students
    st, _ = import_roster(empty_students(spark), classes_df(spark),
                          sheet(spark, ROSTER_HEADERS, [(1, "S09", "Hà Vy", "d", "Nữ", None, None, None, None)]))
    g = sheet(spark, GRADE_HEADERS, [(1, "S09", None, "5", "6", None)])
    r = merge_grades(st, g, classes_df(spark)).first()
    assert (r.midterm, r.exam, r.final_grade, r.matched) == (5.0, 6.0, 5.5, True)


def test_import_report(spark):
    from classledger.operators.grades import grade_import_report
    g = sheet(spark, GRADE_HEADERS, GRADE_ROWS).unionByName(
        sheet(spark, GRADE_HEADERS, [GRADE_ROWS[2]], account="t2")).unionByName(
        sheet(spark, GRADE_HEADERS, [GRADE_ROWS[2]], account="t3"))
    cl = classes_df(spark).unionByName(classes_df(spark, account="t2"))
    st = imported(spark).unionByName(imported(spark).withColumn("account", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("t2")))
    got = sorted(tuple(r) for r in grade_import_report(st, cl, g).collect())
    assert got == [("t1", "updated", 3), ("t2", "no_match", 0), ("t3", "refused", 0)]


def test_several_sheets_equal_one_after_another(spark):
    from pyspark.sql import functions as F
    base = imported(spark)
    cl = classes_df(spark)
    s1 = sheet(spark, GRADE_HEADERS, GRADE_ROWS)
    s2 = sheet(spark, GRADE_HEADERS, [(1, "S01", "CT01", None, "0", "5"), (2, "S02", "CT01", "1", "", None),
                                      (3, "S05", "CT02", None, None, None), (4, "S04", "CT02", "2", "abc", "9")])
    s3 = sheet(spark, GRADE_HEADERS, [(1, "S02", "CT01", None, "6", None), (2, "S03", "CT02", "4", None, None)])
    step = base
    for sh in (s1, s2, s3):
        step = merge_grades(step, sh, cl).drop("matched")
    batch = (s1.withColumn("sheet_no", F.lit(1)).unionByName(s2.withColumn("sheet_no", F.lit(2)))
               .unionByName(s3.withColumn("sheet_no", F.lit(3))))
    together = merge_grades(base, batch, cl, sheet_col="sheet_no")
    assert sorted(map(repr, together.drop("matched").collect())) == sorted(map(repr, step.collect()))
    assert together.where("matched").count() == 5


def test_report_per_sheet(spark):
    from pyspark.sql import functions as F
    from classledger.operators.grades import grade_import_report
    s1 = sheet(spark, GRADE_HEADERS, GRADE_ROWS).withColumn("sheet_no", F.lit(1))
    s2 = sheet(spark, GRADE_HEADERS, [GRADE_ROWS[2]]).withColumn("sheet_no", F.lit(2))
    rep = grade_import_report(imported(spark), classes_df(spark), s1.unionByName(s2), sheet_col="sheet_no")
    assert sorted(tuple(r) for r in rep.collect()) == [("t1", 1, "updated", 3), ("t1", 2, "no_match", 0)]


def test_observed_update_count(spark):
    from classledger.operators.grades import observe_updates
    merged, obs = observe_updates(merge_grades(imported(spark), sheet(spark, GRADE_HEADERS, GRADE_ROWS),
                                               classes_df(spark)))
    merged.write.format("noop").mode("overwrite").save()
    assert obs.get["updated"] == 3
