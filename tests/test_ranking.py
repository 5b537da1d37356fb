"""Positions within groups: equal to a window row_number, also with one huge group and NULL groups."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from classledger.operators.ranking import first_by_row, hot_groups, positions_within


def skewed(spark, n=6000):
    rnd = random.Random(3)
    rows = []
    for i in range(n):
        g = "hot" if i % 3 == 0 else (None if i % 17 == 0 else f"g{rnd.randint(0, 40)}")
        rows.append((g, rnd.choice(["An", "Ánh", "Ba", "ba", ""]), i))
    return spark.createDataFrame(rows, "g string, name string, ord long")


def test_positions_equal_window(spark):
    df = skewed(spark)
    key = F.collate(F.col("name"), "vi")
    got = positions_within(df, ["g"], [key, "ord"], out="pos", num_partitions=7, min_hot_rows=10)
    want = df.withColumn("pos", F.row_number().over(Window.partitionBy("g").orderBy(key, "ord")))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    # the hot group is spread over several slices rather than one task
    slices = (df.repartitionByRange(7, "g", key, "ord").where(F.col("g") == "hot")
                .select(F.spark_partition_id().alias("p")).distinct().count())
    assert slices > 1


def test_hot_groups_are_found_and_bounded(spark):
    df = skewed(spark)
    hot = [r.g for r in hot_groups(df, ["g"], 7, min_rows=10).collect()]
    assert hot_groups(df, ["g"], 7).count() == 0          # small groups are never split
    assert hot == ["hot"]
    uniform = spark.createDataFrame([(f"g{i % 50}", i) for i in range(2000)], "g string, ord long")
    assert hot_groups(uniform, ["g"], 8, min_rows=10).count() == 0
    got = positions_within(uniform, ["g"], ["ord"], num_partitions=8, min_hot_rows=10)
    assert sorted((r.ord // 50 + 1, r.pos) for r in got.collect()) == \
        sorted((i // 50 + 1, i // 50 + 1) for i in range(2000))


def test_null_group_can_be_hot(spark):
    rows = [(None, i) for i in range(300)] + [(f"g{i % 30}", 1000 + i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, ord long")
    got = {(r.g, r.ord): r.pos for r in positions_within(df, ["g"], ["ord"], num_partitions=4, min_hot_rows=10).collect()}
    assert all(got[(None, i)] == i + 1 for i in range(300))
    assert all(got[(f"g{i % 30}", 1000 + i)] == i // 30 + 1 for i in range(300))


def test_global_positions(spark):
    df = skewed(spark, 500)
    got = positions_within(df, [], ["ord"], out="pos", num_partitions=5, min_hot_rows=10)
    assert sorted((r.ord + 1, r.pos) for r in got.collect()) == [(i, i) for i in range(1, 501)]


def test_first_by_row(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("b", 2, None), ("b", 5, "z")],
                               "k string, r long, v string")
    first = {r.k: (r.r, r.v) for r in first_by_row(df, ["k"], "r", ["v"]).collect()}
    last = {r.k: (r.r, r.v) for r in first_by_row(df, ["k"], "r", ["v"], last=True).collect()}
    assert first == {"a": (1, "y"), "b": (2, None)}
    assert last == {"a": (3, "x"), "b": (5, "z")}
