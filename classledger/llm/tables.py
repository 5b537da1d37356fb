"""The driver's tables, and written intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession

from ..session import materialise

__all__ = ["map_arrow", "materialise", "read", "ship_package", "tokenizer_path"]

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's source to the executors, once for each application (as --py-files does)."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="classledger-")) / "classledger_source.zip"
    with zipfile.ZipFile(target, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``df.mapInArrow`` whose tasks can import this package."""
    ship_package(df.sparkSession)
    return df.mapInArrow(function, schema)


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table, so that the scan reads no others."""
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet").select(*columns)


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies; called in tasks too, as each machine has its own copy."""
    if os.path.dirname(name):
        return str(PurePosixPath(name))
    import public_tokenizers

    return public_tokenizers.path(name)
