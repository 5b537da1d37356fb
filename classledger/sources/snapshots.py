"""Table snapshots: load one or all accounts, write a new snapshot, seed.

Each snapshot is a directory with ``accounts/``, ``classes/`` and
``students/`` Parquet tables, partitioned by ``account_bucket`` — a hash of
the account into a fixed number of buckets, recorded in ``_meta``. With
millions of accounts, one directory per account would mean millions of
directories and tiny files; buckets keep the layout bounded while loading one
account still prunes to a single bucket directory.

``save`` never rewrites a snapshot in place: it writes a new directory, so an
account left with no rows cannot keep a stale partition and a failed job
leaves the previous snapshot intact. ``update_accounts`` changes a few accounts
of a snapshot in place and rewrites only their buckets.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..operators.joins import broadcast_if_small
from ..session import materialise

DEFAULT_BUCKETS = 1024
#: True on the one row that a rewritten bucket holds beside its data, so that a bucket left without data is
#: overwritten too: a dynamic overwrite leaves alone every partition that the new rows do not name.
MARKER = "_marker"
META_SCHEMA = T.StructType([T.StructField("buckets", T.IntegerType())])


@dataclass
class Tables:
    accounts: DataFrame
    classes: DataFrame
    students: DataFrame


def account_bucket(account: Column, buckets: int) -> Column:
    """Bucket of an account: a stable 64-bit hash modulo ``buckets``."""
    return F.pmod(F.xxhash64(account), F.lit(buckets)).cast("int")


def seed(spark: SparkSession) -> Tables:
    """The initial state: one admin account with no classes or students (no secret is kept)."""
    return Tables(spark.createDataFrame([(S.ADMIN_ACCOUNT, True, 0)], S.ACCOUNTS),
                  spark.createDataFrame([], S.CLASSES),
                  spark.createDataFrame([], S.STUDENTS))


def _buckets(spark: SparkSession, path: str) -> int:
    return spark.read.schema(META_SCHEMA).json(f"{path}/_meta").first().buckets


SCHEMAS = {"accounts": S.ACCOUNTS, "classes": S.CLASSES, "students": S.STUDENTS}


def _stored(spark: SparkSession, path: str, where=None) -> Tables:
    """The tables at ``path``, of the buckets that ``where`` (a condition on account_bucket) keeps."""
    def read(name, schema):
        full = T.StructType(schema.fields + [T.StructField(MARKER, T.BooleanType()),
                                             T.StructField("account_bucket", T.IntegerType())])
        df = spark.read.schema(full).parquet(f"{path}/{name}")
        if where is not None:
            df = df.where(where)
        return df.where(~F.coalesce(F.col(MARKER), F.lit(False))).select(*[f.name for f in schema.fields])
    return Tables(**{name: read(name, schema) for name, schema in SCHEMAS.items()})


def load(spark: SparkSession, path: str, account: str | None = None) -> Tables:
    """Load a snapshot; with ``account`` only that account's bucket directory is read."""
    if account is None:
        return _stored(spark, path)
    t = _stored(spark, path, F.col("account_bucket") == account_bucket(F.lit(account), _buckets(spark, path)))
    return Tables(*(df.where(F.col("account") == F.lit(account)) for df in (t.accounts, t.classes, t.students)))


def update_accounts(spark: SparkSession, path: str, accounts: DataFrame, change: Callable[[Tables], Tables],
                    skip_admin: bool = True, max_records_per_file: int = 5_000_000) -> list[int]:
    """Apply ``change`` to some accounts of the snapshot at ``path``, rewriting only their buckets.

    ``accounts`` names them (column ``account``). ``change`` gets their tables and
    returns the new ones; rows of other accounts that it returns are left out.
    Only the buckets of these accounts are read, and only they are written, by a
    dynamic partition overwrite; the other accounts in them keep their rows. An
    account or a whole bucket that is left without rows is cleared. With
    ``skip_admin`` admin accounts keep theirs.

    The new rows are written aside before the first bucket is replaced, so a
    failure until then changes nothing. The three tables are replaced one after
    the other: one driver updates a snapshot at a time, and an update that
    failed between them is run again. Returns the buckets.
    """
    buckets = _buckets(spark, path)
    names = materialise(accounts.where(F.col("account").isNotNull()).select("account").distinct(), "touched-accounts")
    # At most as many numbers as there are buckets.
    touched = sorted(r.b for r in names.select(account_bucket(F.col("account"), buckets).alias("b")).distinct().collect())
    if not touched:
        return []
    old = _stored(spark, path, F.col("account_bucket").isin(touched))
    if skip_admin:
        names = names.join(old.accounts.where("is_admin").select("account"), "account", "left_anti")
    names = broadcast_if_small(names)
    mine = lambda df: df.join(names, "account", "left_semi")
    after = change(Tables(mine(old.accounts), mine(old.classes), mine(old.students)))
    written = {}
    for name, schema in SCHEMAS.items():
        cols = [f.name for f in schema.fields]
        rows = (getattr(old, name).join(names, "account", "left_anti").select(*cols)
                .unionByName(mine(getattr(after, name)).select(*cols)))
        written[name] = materialise(rows, f"touched-{name}")
    for name, df in written.items():
        stored = df.withColumns({MARKER: F.lit(False), "account_bucket": account_bucket(F.col("account"), buckets)})
        marks = spark.createDataFrame([(b,) for b in touched], "account_bucket int").withColumn(MARKER, F.lit(True))
        (stored.unionByName(marks, allowMissingColumns=True).hint("rebalance", "account_bucket")
               .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
               .option("maxRecordsPerFile", max_records_per_file).partitionBy("account_bucket").parquet(f"{path}/{name}"))
    return touched


def save(tables: Tables, path: str, previous: Tables | None = None, skip_admin: bool = True,
         max_records_per_file: int = 5_000_000, mode: str = "errorifexists",
         buckets: int = DEFAULT_BUCKETS) -> None:
    """Write ``tables`` as a new snapshot at ``path``.

    With ``skip_admin`` (the default), admin accounts keep their rows from
    ``previous`` (or none): their changes last only for the session. ``mode``
    stays ``errorifexists`` unless the caller owns ``path`` (a versioned folder
    that nothing reads yet, as the streaming importer's replays do).
    """
    spark = tables.accounts.sparkSession
    admins = broadcast_if_small(materialise(tables.accounts.where(F.col("is_admin")).select("account"), "admins"))

    def keep(new: DataFrame, old: DataFrame | None) -> DataFrame:
        if not skip_admin:
            return new
        out = new.join(admins, "account", "left_anti")
        if old is not None:
            out = out.unionByName(old.join(admins, "account", "left_semi"), allowMissingColumns=True)
        return out

    out = Tables(tables.accounts,
                 keep(tables.classes, previous.classes if previous else None),
                 keep(tables.students, previous.students if previous else None))
    for name, df in (("accounts", out.accounts), ("classes", out.classes), ("students", out.students)):
        # Rebalance by bucket: each bucket's rows meet in few writer tasks (few
        # files per bucket), and AQE splits a bucket that holds a hot account
        # across several tasks instead of one.
        (df.withColumn("account_bucket", account_bucket(F.col("account"), buckets))
           .hint("rebalance", "account_bucket")
           .write.mode(mode).option("maxRecordsPerFile", max_records_per_file)
           .partitionBy("account_bucket").parquet(f"{path}/{name}"))
    spark.createDataFrame([(buckets,)], META_SCHEMA).coalesce(1).write.mode(mode).json(f"{path}/_meta")
