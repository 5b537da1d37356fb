"""A class holding a third of all rows (derived from lineitem): positions equal a plain window,
and no slice of the hot class holds much more than its share."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from classledger.functions import roster_sort_key
from classledger.operators.ranking import hot_groups, positions_within

from .conftest import SF_ORACLE


def skewed_roster(spark):
    li = spark.read.parquet(f"{SF_ORACLE}/lineitem.parquet")
    return li.select(
        F.lit("acct").alias("account"),
        F.when(F.col("l_orderkey") % 3 == 0, F.lit("HOT"))
         .otherwise(F.concat(F.lit("C"), (F.col("l_orderkey") % 200).cast("string"))).alias("class_name"),
        F.concat(F.lit("Nguyễn "), F.col("l_returnflag"), F.col("l_linestatus")).alias("full_name"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))


def test_hot_class_positions_and_slice_sizes(spark):
    df = skewed_roster(spark)
    n = 8
    key = roster_sort_key("full_name")
    assert [r.class_name for r in hot_groups(df, ["account", "class_name"], n, min_rows=1000).collect()] == ["HOT"]
    got = positions_within(df, ["account", "class_name"], [key, "ord"], num_partitions=n, min_hot_rows=1000)
    want = df.withColumn("pos", F.row_number().over(Window.partitionBy("account", "class_name").orderBy(key, "ord")))
    diff = got.select("class_name", "ord", "pos").exceptAll(want.select("class_name", "ord", "pos"))
    assert diff.count() == 0 and got.count() == want.count()
    # slice sizes of the hot class: range partitioning spreads it over all n slices
    hot = df.where(F.col("class_name") == "HOT")
    sizes = [r["count"] for r in hot.repartitionByRange(n, "account", "class_name", key, "ord")
             .groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == n and max(sizes) <= 2 * hot.count() / n
