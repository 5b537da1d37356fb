"""Session construction and the few settings the operators rely on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "classledger") -> SparkSession:
    """A session for the operators in this package.

    On a cluster, pass nothing: the cluster's master, shuffle sizing, UI and
    ``spark.checkpoint.dir`` are used as configured; only adaptive execution
    with skew-join splitting is asked for (Spark's default). With a local
    ``master`` (tests, bench) the UI is off, the shuffle width is small and a
    scratch checkpoint folder is chosen when none is set.
    """
    builder = (SparkSession.builder.appName(app_name)
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true"))
    if master:
        builder = (builder.master(master).config("spark.ui.enabled", "false")
                          .config("spark.ui.showConsoleProgress", "false"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is; a machine-local folder is only ever chosen when nothing is configured
    (local tests).
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        current = tempfile.mkdtemp(prefix="classledger-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", current)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet under the session's checkpoint folder and read it back.

    Used where a result must be computed exactly once (range slices), or where
    a small batch-derived side is both size-checked and joined: the written
    table cuts the lineage, so a lost executor never recomputes the work.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/classledger/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)
