"""Continuous sheet imports: each dropped file is one import, applied in arrival order.

The reference imports a sheet when a user picks a file. Here a file source
watches a drop folder; ``foreachBatch`` applies the grade merge (M6) or the
roster import (M7) to the current snapshot and writes the next snapshot.

* Several files per micro-batch (``maxFilesPerTrigger``), applied as one
  import after another in file order (modification time, then path): the
  operators take a sheet-order column and give exactly the sequential result,
  so a micro-batch writes one snapshot for many sheets.
* Snapshots are ``<root>/v<number>``; a log table ``<root>/_log`` records which
  stream's epoch (kind and checkpoint folder) made each. A replayed epoch of
  the same stream is skipped, so a restart after a failure never applies a
  sheet twice, and streams that share a root never skip each other's epochs.
  One driver process writes to a root at a time.
* Outcomes per account and file (updated / no_match / refused with the
  number of students updated, or the missing classes of a refused roster)
  are written to ``<root>/_reports``, one folder per epoch.
"""

from __future__ import annotations

import threading

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import schema as S
from ..operators.grades import SHEETS, grade_import_report, merge_grades, observe_updates
from ..operators.ingest import MissingColumns, import_roster, missing_columns
from ..operators.joins import broadcast_if_small
from ..session import materialise
from ..sources.snapshots import Tables, load, save

# One row for each snapshot: its number under the root, and which stream's epoch made it.
LOG_SCHEMA = T.StructType([T.StructField("snapshot", T.LongType()), T.StructField("stream", T.StringType()),
                           T.StructField("epoch", T.LongType()), T.StructField("path", T.StringType()),
                           T.StructField("updated", T.LongType())])  # students that a grade epoch updated
_roots: dict[str, threading.Lock] = {}
SHEET = "_sheet"   # sheet order inside a micro-batch: (file modification time, file path)


def _log(spark: SparkSession, root: str) -> DataFrame | None:
    """The log, or None only if there is no such folder yet; any other failure is raised."""
    try:
        return spark.read.schema(LOG_SCHEMA).parquet(f"{root}/_log")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _latest(log: DataFrame | None):
    """(number, path) of the newest logged snapshot, or None."""
    if log is None:
        return None
    row = log.agg(F.max("snapshot").alias("n"), F.max_by("path", "snapshot").alias("p")).first()
    return None if row.p is None else (row.n, row.p)


def _logged(log: DataFrame | None, stream: str, epoch: int) -> bool:
    return log is not None and not log.where((F.col("stream") == stream) & (F.col("epoch") == epoch)).isEmpty()


def _grade_report(spark: SparkSession, tables: Tables, batch: DataFrame, path: str) -> DataFrame:
    """Outcome per account and file, counted from the snapshot just written.

    Admin accounts are not in it (their changes last for the session only); the
    few that the batch names are merged again on their own.
    """
    columns = ["account", "matched", SHEETS]
    merged = spark.read.parquet(f"{path}/students").select(*columns)
    admins = tables.accounts.where("is_admin").join(batch.select("account").distinct(), "account", "left_semi")
    admins = broadcast_if_small(materialise(admins.select("account"), "batch-admins"))
    if not admins.isEmpty():
        own = lambda df: df.join(admins, "account", "left_semi")
        merged = merged.unionByName(merge_grades(own(tables.students), own(batch), tables.classes, SHEET, True).select(*columns))
    report = grade_import_report(tables.students, tables.classes, batch, merged, sheet_col=SHEET)
    return report.select("account", F.col(f"{SHEET}.file_path").alias("file"), "status", "updated")


def _apply(kind: str, root: str, initial: Tables | None, stream: str):
    def apply(batch: DataFrame, epoch: int) -> None:
        with _roots.setdefault(root, threading.Lock()):  # streams that share a root take turns
            one_import(batch, epoch)

    def one_import(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        log = _log(spark, root)
        if _logged(log, stream, epoch) or batch.isEmpty():
            return
        prev = _latest(log)
        tables = load(spark, prev[1]) if prev else initial
        if tables is None:
            raise ValueError("no snapshot yet: pass initial tables")
        if kind == "grades":
            merged = merge_grades(tables.students, batch, tables.classes, sheet_col=SHEET, keep_sheets=True)
            merged, seen = observe_updates(merged, f"grade_merge_{epoch}")
            new = Tables(tables.accounts, tables.classes, merged)
        else:
            students, report = import_roster(tables.students, tables.classes, batch, sheet_col=SHEET)
            seen = None
            report = report.select("account", F.col(f"{SHEET}.file_path").alias("file"),
                                   F.lit("refused").alias("status"), "missing")
            new = Tables(tables.accounts, tables.classes, students)
        number = prev[0] + 1 if prev else 0
        path = f"{root}/v{number:012d}"
        # The folder is only read once the epoch is logged, so a replay after
        # a failure mid-write may overwrite what it left behind.
        save(new, path, previous=tables, mode="overwrite")
        if seen is not None:
            # The students were merged once, for the snapshot; it also holds which
            # sheets named each student, so the report is counted from two of its columns.
            report = _grade_report(spark, tables, batch, path)
        # One folder per epoch, overwritten on replay: reports are never doubled.
        report.write.mode("overwrite").parquet(f"{root}/_reports/{kind}/epoch={number}")
        updated = seen.get["updated"] if seen is not None else None
        spark.createDataFrame([(number, stream, epoch, path, updated)], LOG_SCHEMA).write.mode("append").parquet(f"{root}/_log")
    return apply


def start_sheet_imports(spark: SparkSession, drop_dir: str, root: str, checkpoint: str,
                        kind: str = "grades", fmt: str = "csv", headers=S.ALL_SHEET_HEADERS,
                        initial: Tables | None = None, files_per_trigger: int = 100,
                        available_now: bool = False) -> StreamingQuery:
    """Start importing sheet files that appear in ``drop_dir`` into snapshots under ``root``.

    Files carry ``row_no`` and ``account`` columns plus sheet headers, all read
    as text. ``initial`` seeds the first snapshot. With ``available_now`` the
    query processes what is there and stops (batch-like runs and tests).
    """
    if kind not in ("grades", "roster"):
        raise ValueError("kind is 'grades' or 'roster'")
    if kind == "roster":
        # The headers are declared once for the whole stream: check them (V1) up front.
        missing = missing_columns(list(headers))
        if missing:
            raise MissingColumns(missing)
    reader = (spark.readStream.schema(S.sheet_schema(headers)).format(fmt)
                   .option("maxFilesPerTrigger", files_per_trigger))
    if fmt == "csv":
        reader = reader.options(header=True, enforceSchema=False, multiLine=True, mode="FAILFAST")
    stream = reader.load(drop_dir).withColumn(
        SHEET, F.struct(F.col("_metadata.file_modification_time").alias("file_modification_time"),
                        F.col("_metadata.file_path").alias("file_path")))
    writer = (stream.writeStream.foreachBatch(_apply(kind, root, initial, f"{kind}:{checkpoint}"))
                    .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
