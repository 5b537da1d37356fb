"""Students as a bucketed table, so that merges join without shuffling them.

The rows are hashed by (account, trimmed id) into a fixed number of buckets once,
when they are written, and sorted within a bucket. A grade merge joins on the
account, the id and the class, a point grade on the account and the id: both
contain the bucket key, so Spark reads a bucket as a partition and does not
exchange the students again; a bucket is sorted where it is read, from rows
already in order. The batch's side is written into the same buckets.

A bucket cannot be split in a join, so ids that hold more rows than others by
far (``hot``: more than 1/n of the rows and ``min_hot_rows``) stay in a plain table
beside it, whose joins the adaptive skew split takes.

Joins on more columns than the bucket key are only planned this way with
``spark.sql.requireAllClusterKeysForCoPartition`` off; writing or opening a
bucketed table sets it for the session. With it on the results are the same.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import js_string_key
from ..operators.ranking import MIN_HOT_ROWS, hot_groups

BUCKET_KEY = ["account", "_id_key"]
SORT_KEY = ["account", "_id_key", "_class_key"]
DEFAULT_BUCKETS = 1024


@dataclass
class BucketedStudents:
    """``bucketed`` has the students' columns and both keys; ``hot`` holds the rows of hot ids, without buckets."""

    bucketed: DataFrame
    hot: DataFrame
    buckets: int

    def all(self) -> DataFrame:
        """Every student, as one table."""
        return self.bucketed.select(*S.STUDENT_COLUMNS).unionByName(self.hot.select(*S.STUDENT_COLUMNS))


def _join_by_buckets(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def write_buckets(df: DataFrame, path: str, buckets: int, sort: list[str], key: list[str] = BUCKET_KEY) -> DataFrame:
    """Write ``df`` at ``path`` hashed by ``key`` into buckets, one file each, and open it."""
    name = f"classledger_{uuid.uuid4().hex}"
    (df.repartition(buckets, *key).write.format("parquet").option("path", path)
       .bucketBy(buckets, *key).sortBy(*sort).saveAsTable(name))
    _join_by_buckets(df.sparkSession)
    return df.sparkSession.table(name)


def open_buckets(spark: SparkSession, path: str, schema: T.StructType, buckets: int, sort: list[str],
                 key: list[str] = BUCKET_KEY) -> DataFrame:
    """A table that :func:`write_buckets` wrote, perhaps by another application."""
    name = f"classledger_{uuid.uuid4().hex}"
    names = lambda cols: ", ".join(f"`{c}`" for c in cols)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    place = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({names(key)}) SORTED BY ({names(sort)}) "
              f"INTO {int(buckets)} BUCKETS LOCATION '{place}'")
    _join_by_buckets(spark)
    return spark.table(name)


STORED = T.StructType(S.STUDENTS.fields + [T.StructField("_id_key", T.StringType()), T.StructField("_class_key", T.StringType())])


def write_students(students: DataFrame, path: str, buckets: int = DEFAULT_BUCKETS,
                   min_hot_rows: int = MIN_HOT_ROWS) -> BucketedStudents:
    """Write students at ``path`` as a bucketed table and the rows of hot ids beside it."""
    spark = students.sparkSession
    keyed = students.select(*S.STUDENT_COLUMNS, js_string_key("student_id").alias("_id_key"),
                            js_string_key("class_name").alias("_class_key"))
    # Fewer than n ids are hot, whatever the data: a proven bound.
    hot = hot_groups(keyed, BUCKET_KEY, min_rows=min_hot_rows)
    hot = F.broadcast(hot.select(F.col("account").alias("_a"), F.col("_id_key").alias("_i")))
    same = keyed["account"].eqNullSafe(hot["_a"]) & keyed["_id_key"].eqNullSafe(hot["_i"])
    table = write_buckets(keyed.join(hot, same, "left_anti"), f"{path}/buckets", buckets, SORT_KEY)
    keyed.join(hot, same, "left_semi").write.parquet(f"{path}/hot")
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.json(f"{path}/_meta")
    return BucketedStudents(table, spark.read.schema(STORED).parquet(f"{path}/hot"), buckets)


def open_students(spark: SparkSession, path: str) -> BucketedStudents:
    """Students that :func:`write_students` wrote at ``path``."""
    buckets = spark.read.schema("buckets int").json(f"{path}/_meta").first().buckets
    return BucketedStudents(open_buckets(spark, f"{path}/buckets", STORED, buckets, SORT_KEY),
                            spark.read.schema(STORED).parquet(f"{path}/hot"), buckets)
