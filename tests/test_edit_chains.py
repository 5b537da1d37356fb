"""Ordered edits: equal to applying them one at a time."""

import random

from classledger import schema as S
from classledger.operators.edit_chains import edit_students_in_order, last_edits

EDITS = ("account string, row_no long, original_id string, student_id string, full_name string, birth_date string, "
         "gender string, class_name string, midterm double, exam double")


def edit(account, row_no, original, new, grade=1.0):
    return (account, row_no, original, new, f"edit {row_no}", None, "Nam", "C", grade, None)


def student(account, sid, ord_):
    return (account, sid, f"name {ord_}", "", "Nam", "C", 0.0, 0.0, 0.0, ord_)


def serial(students, edits):
    """The rows after each edit in turn replaces every row with its original id."""
    rows = [list(s) for s in students]
    for account, _, original, new, name, birth, gender, cls, mid, exam in sorted(edits, key=lambda e: e[1] or 0):
        for r in rows:
            if original is not None and _ is not None and r[0] == account and r[1] == original:
                r[1:9] = [new, name, birth, gender, cls, mid, exam, round(((mid or 0) + (exam or 0)) / 2, 2)]
    return sorted(map(tuple, rows), key=str)


def check(spark, students, edits, **settings):
    st = spark.createDataFrame(students, S.STUDENTS)
    got = edit_students_in_order(st, spark.createDataFrame(edits, EDITS).repartition(3), **settings)
    assert sorted(map(tuple, got.collect()), key=str) == serial(students, edits)


def test_chains_swaps_and_merged_ids(spark):
    students = [student("t1", i, n) for n, i in enumerate(["A", "B", "C", "D", "A", None, "Z"])] + [student("t2", "A", 9)]
    check(spark, students, [edit("t1", 1, "A", "B"), edit("t1", 2, "B", "C"), edit("t1", 3, "C", "C"), edit("t1", 4, "D", "A")])
    check(spark, students, [edit("t1", 1, "A", "T"), edit("t1", 2, "B", "A"), edit("t1", 3, "T", "B")])    # a swap
    check(spark, students, [edit("t1", 3, "A", "B"), edit("t1", 1, "B", "Q"), edit("t1", 2, "A", None)])    # a null id ends
    check(spark, students, [edit("t1", 1, None, "X"), edit("t1", 2, "nobody", "A"), edit("t2", 1, "A", "A")])
    check(spark, students, [])


def test_a_long_chain_and_one_id_edited_by_all(spark):
    students = [student("t1", f"s{i}", i) for i in range(5)]
    check(spark, students, [edit("t1", i, f"s{i}", f"s{i + 1}") for i in range(300)])
    check(spark, students, [edit("t1", i, "s0", "s0", float(i % 10)) for i in range(300)])
    check(spark, students, [edit("t1", i, "s0", "s0", float(i % 10)) for i in range(300)], min_hot_rows=10)   # numbered in slices


def test_random_batches_equal_serial_application(spark):
    rng = random.Random(2)
    for _ in range(3):
        ids = [f"s{i}" for i in range(12)]
        students = [student(rng.choice(["t1", "t2"]), rng.choice(ids), n) for n in range(30)]
        rows = rng.sample(range(1000), 120)
        check(spark, students, [edit(rng.choice(["t1", "t2"]), r, rng.choice(ids), rng.choice(ids), float(r % 11)) for r in rows])


def test_rounds_grow_with_the_logarithm_of_the_chain(spark, monkeypatch):
    from classledger.operators import edit_chains
    rounds = []
    write = edit_chains.materialise
    monkeypatch.setattr(edit_chains, "materialise", lambda df, label: rounds.append(label) or write(df, label))
    edits = spark.createDataFrame([edit("t1", i, f"s{i}", f"s{i + 1}") for i in range(500)], EDITS)
    assert {r.original_id: r.row_no for r in last_edits(edits).collect()}["s0"] == 499
    assert rounds.count("edit-chains") <= 12        # 1,000 events


def test_edits_that_keep_their_id_take_no_rounds(spark, monkeypatch):
    from classledger.operators import edit_chains
    rounds, write = [], edit_chains.materialise
    monkeypatch.setattr(edit_chains, "materialise", lambda df, label: rounds.append(label) or write(df, label))
    rows = [edit("t1", i, f"s{i % 3}", f"s{i % 3}") for i in range(300)] + [edit("t1", 300, "s0", "s9"), edit("t1", 301, "s9", "s9")]
    assert {r.original_id: r.row_no for r in last_edits(spark.createDataFrame(rows, EDITS)).collect()} == {
        "s0": 301, "s1": 298, "s2": 299, "s9": 301}
    assert rounds.count("edit-chains") == 1     # the links; none is open


def test_hot_ids_that_edits_leave_and_reach(spark):
    rng = random.Random(5)
    students = [student("t1", f"s{i}", i) for i in range(6)]
    rows = [edit("t1", i, rng.choice(["s0", "s0", "s1", "s2", "s3"]), rng.choice(["s0", "s0", "s1", "s4", None]), float(i % 9)) for i in range(150)]
    check(spark, students, rows, min_hot_rows=10)
    check(spark, students, rows)


def test_edits_that_come_twice_end(spark):
    rows = [edit("t1", 1, "A", "B"), edit("t1", 2, "B", "C"), edit("t1", 3, "C", "C"), edit(None, 4, "A", "Q")]
    got = {tuple(r) for r in last_edits(spark.createDataFrame(rows * 2, EDITS)).collect()}
    assert got == {("t1", "A", 3), ("t1", "B", 3), ("t1", "C", 3)}
