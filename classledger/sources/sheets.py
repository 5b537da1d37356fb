"""Roster and grade sheet batches read as all-text DataFrames.

A sheet's first line is its header; every cell is read as text (a numeric
id such as 21001 must stay ``"21001"``, never ``"21001.0"``). File order is
carried by a ``row_no`` column, which first-match and prepend semantics need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def number_text(x: Column) -> Column:
    """A numeric cell as a spreadsheet shows it: ``21001``, ``0.5``, ``20210001``; never ``21001.0`` or ``2.0E7``.

    NULL, NaN and infinite values, and magnitudes from 1e20 or under 1e-6, are as Spark's cast gives them.
    """
    size = F.abs(x.cast("double"))
    whole = x.try_cast("decimal(38,0)").cast("string")
    digits = F.regexp_replace(x.cast("string").try_cast("decimal(38,17)").cast("string"), "0+$", "")
    return (F.when(size == 0, F.lit("0"))
             .when((size < 1e20) & (F.floor(size) == size), whole)
             .when((size >= 1e-6) & (size < 1e20), digits)
             .otherwise(x.cast("string")))


def _variant_cell(cell: Column) -> Column:
    """A JSON cell as text: a number as a sheet shows it, text as it stands, a null as NULL."""
    kind = F.schema_of_variant(cell)
    # Exact numbers come without trailing zeros; those with an exponent are doubles.
    return (F.when(kind == "DOUBLE", number_text(cell.try_cast("double")))
             .otherwise(cell.try_cast("string")))


def _json_cells(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with every cell as text, numbers told from text by their kind in the file."""
    headers = spark.read.option("primitivesAsString", True).json(path).columns
    rows = spark.read.option("singleVariantColumn", "_row").json(path)
    # As a map, so that a header may hold any character.
    rows = rows.select(F.col("_row").try_cast("map<string, variant>").alias("_row"))
    return rows.select(*[_variant_cell(F.col("_row")[h]).alias(h) for h in headers])


def write_sheet(sheet: DataFrame, path: str, numbers: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """Write a sheet as JSON lines; cells of the ``numbers`` columns that are plain numbers are written as numbers.

    A number has no text of its own: ``007`` comes back as ``7`` from such a
    column, while the other columns come back as they are. NULL cells are left out.
    """
    plain = r"^-?[0-9]+(\.[0-9]+)?$"
    cells = []
    for f in sheet.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in numbers:
            c = F.when(c.cast("string").rlike(plain), c.cast("string").try_cast("double").cast("variant")).otherwise(c.cast("string").cast("variant"))
        cells.append(c.alias(f.name))
    sheet.select(F.to_json(F.struct(*cells))).write.mode(mode).text(path)


def read_sheet(spark: SparkSession, path: str, fmt: str = "csv", account: str | None = None,
               sheet_col: str | None = None, multi_line: bool = True) -> DataFrame:
    """Read a sheet batch (CSV with a header line, JSON lines or Parquet) as text columns.

    ``row_no`` keeps the order of rows within a file. Without such a column it
    is numbered here: by the row index of a Parquet file, and for CSV in
    reading order (rising within a file, not without gaps). A CSV file is then
    read by one task, as quoted line breaks (``multi_line``) need anyway;
    ``multi_line=False`` splits large files, and like JSON lines it needs a
    ``row_no`` column. A number in a JSON cell reads as a spreadsheet shows it
    (``20210001.0`` as ``20210001``), a text cell as it stands. ``sheet_col`` names a column for the file's path, which
    tells several sheets apart. ``account`` fills the tenant column when the
    batch does not carry one. A malformed CSV row fails the batch.
    """
    if fmt == "csv":
        # No inference: the header names the columns, every cell stays a string.
        df = (spark.read.option("header", True).option("inferSchema", False)
                   .option("multiLine", multi_line).option("mode", "FAILFAST").csv(path))
    elif fmt == "json":
        df = _json_cells(spark, path)
    elif fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"unsupported sheet format {fmt!r}")
    if "row_no" in df.columns:
        row_no = F.col("row_no").cast("long")
    elif fmt == "parquet":
        row_no = F.col("_metadata.row_index")
    elif fmt == "csv" and multi_line:
        row_no = F.monotonically_increasing_id()  # a file is never split, so its rows are numbered in order
    else:
        raise ValueError("a sheet batch that is read in splits needs a row_no column to keep file order")
    cols = [row_no.alias("row_no")]
    for f in df.schema.fields:
        cell = F.col(f"`{f.name}`")
        if f.name == "row_no":
            continue
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            cols.append(number_text(cell).alias(f.name))
        elif isinstance(f.dataType, T.StringType):
            cols.append(cell)
        else:
            cols.append(cell.cast("string").alias(f.name))
    if sheet_col is not None:
        cols.append(F.col("_metadata.file_path").alias(sheet_col))
    df = df.select(*cols)
    if account is not None:
        df = df.withColumn("account", F.lit(account))
    elif "account" not in df.columns:
        raise ValueError("a sheet batch needs an account column or an account argument")
    return df
