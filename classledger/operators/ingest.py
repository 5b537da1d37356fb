"""Roster sheet import: header check, referential check, normalisation, prepend."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import final_grade_of, grade_or, js_or, parse_grade, truthy
from ..session import materialise
from .joins import broadcast_when, fits_broadcast


class MissingColumns(ValueError):
    """The sheet lacks required headers; the whole batch is refused."""

    def __init__(self, missing: list[str]):
        super().__init__(", ".join(missing))
        self.missing = missing


def missing_columns(columns: list[str]) -> list[str]:
    """Required headers absent from ``columns``, under their canonical names, in check order.

    Exact, case-sensitive match on the header line (no job is run).
    """
    present = set(columns)
    return [canon for canon, options in S.REQUIRED_ROSTER if not any(o in present for o in options)]


def missing_column_report(sheets: DataFrame, sheet_col: str | None = None) -> DataFrame:
    """One line per account (and sheet) of a batch whose rows lack a required column, with the names joined.

    In a batch of several sheets, read as one table, a sheet has a header if
    some row of it has a cell there. ``(account, sheet, missing)``; sheets with all
    columns, and a batch without rows, give no line. One partial aggregation
    with a flag for each required column, however many rows a sheet has.
    """
    by = ["account"] + ([sheet_col] if sheet_col else [])
    has = {canon: F.bool_or(F.coalesce(*[_cell(sheets, o) for o in options], F.lit(None).cast("string")).isNotNull())
           for canon, options in S.REQUIRED_ROSTER}
    flags = sheets.groupBy(*by).agg(*[c.alias(f"_{k}") for k, c in enumerate(has.values())])
    absent = F.array_compact(F.array(*[F.when(~F.col(f"_{k}"), F.lit(canon)) for k, canon in enumerate(has)]))
    return flags.select(*by, F.array_join(absent, ", ").alias("missing")).where(F.col("missing") != "")


def _cell(sheet: DataFrame, name: str):
    return F.col(f"`{name}`") if name in sheet.columns else F.lit(None).cast("string")


def sheet_class(sheet: DataFrame):
    """The class cell as read by the import: ``Lớp || Lớp Học Phần`` (untrimmed)."""
    return js_or(_cell(sheet, S.H_CLASS[0]), _cell(sheet, S.H_CLASS[1]))


def sheet_summary(sheet: DataFrame, sheet_col: str | None = None) -> DataFrame:
    """One row for each (account, sheet, class cell): its first and last row number, written once.

    All that an import must know of a batch before it can number the rows: the
    named classes, the accounts, and each sheet's span. A class named by most
    rows costs one row per task before the shuffle.
    """
    by = ["account"] + ([sheet_col] if sheet_col else [])
    named = sheet.select(*by, "row_no", sheet_class(sheet).alias("class_name"))
    return materialise(named.groupBy(*by, "class_name").agg(F.min("row_no").alias("first_row"),
                                                            F.max("row_no").alias("last_row")), "sheet-summary")


def missing_classes(classes: DataFrame, sheet: DataFrame, sheet_col: str | None = None,
                    summary: DataFrame | None = None, small: bool | None = None) -> DataFrame:
    """Distinct classes named in the sheet but unknown to the account, with their first row.

    Blank classes are skipped; names are compared exactly (no trim). One row
    per ``(account, class_name)`` (per sheet too, with ``sheet_col``); order
    them by ``first_row`` for the report. ``summary`` is the sheet's
    :func:`sheet_summary`, when the caller has it, and ``small`` whether it fits a broadcast.
    """
    summary = sheet_summary(sheet, sheet_col) if summary is None else summary
    named = summary.where(truthy("class_name")).drop("last_row")
    # Only the classes the sheet names are looked up: a semi-join of the named
    # pairs cuts the classes table down before the anti-join.
    if small is None:
        small = fits_broadcast(named)
    pairs = broadcast_when(small, named.select("account", "class_name").distinct())
    known = classes.select("account", "class_name").join(pairs, ["account", "class_name"], "left_semi")
    return named.join(known, ["account", "class_name"], "left_anti")


#: Sheet rows whose names one task sorts and joins for a report line.
REPORT_SLICE = 10_000


def missing_class_report(missing: DataFrame, sheet_col: str | None = None, slice_rows: int = REPORT_SLICE) -> DataFrame:
    """One line per refused account (and sheet): its missing classes joined in first-seen order.

    The names are joined in two levels: those first seen in one range of
    ``slice_rows`` rows to a string, then an account's strings to its line. A row
    names one class, so no task sorts more than a range's names of one account.
    """
    by = ["account"] + ([sheet_col] if sheet_col else [])
    ordered = lambda at, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, text))),
                                                        lambda x: x[text]), ", ")
    parts = (missing.withColumn("_part", F.floor(F.col("first_row") / slice_rows))
                    .groupBy(*by, "_part").agg(ordered("first_row", "class_name").alias("_text"), F.min("first_row").alias("first_row")))
    return parts.groupBy(*by).agg(ordered("_part", "_text").alias("missing"), F.min("first_row").alias("first_row"))


def normalise_roster(sheet: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Sheet rows as students: aliases, defaults ('' / 'Nam' / 0) and the final grade.

    ``keep`` names extra columns carried through unchanged.
    """
    c = lambda name: _cell(sheet, name)
    mid = parse_grade(c(S.H_MIDTERM))
    exam = parse_grade(grade_or(c(S.H_EXAM[0]), c(S.H_EXAM[1])))
    out = sheet.select(
        "account", "row_no", *keep,
        js_or(c(S.H_ID), F.lit("")).alias("student_id"),
        js_or(c(S.H_NAME[0]), c(S.H_NAME[1]), F.lit("")).alias("full_name"),
        js_or(c(S.H_BIRTH[0]), c(S.H_BIRTH[1]), F.lit("")).alias("birth_date"),
        js_or(c(S.H_GENDER), F.lit(S.DEFAULT_GENDER)).alias("gender"),
        sheet_class(sheet).alias("class_name"),
        mid.alias("midterm"), exam.alias("exam"))
    return out.withColumn("final_grade", final_grade_of("midterm", "exam"))


def _no_rejects(sheet: DataFrame, sheet_col: str | None) -> DataFrame:
    by = ["account"] + ([sheet_col] if sheet_col else [])
    return sheet.select(*by, F.lit("").alias("missing")).limit(0)


def import_roster(students: DataFrame, classes: DataFrame, sheet: DataFrame,
                  sheet_col: str | None = None):
    """Import a roster sheet into every account it names, all or nothing per account.

    Returns ``(students, rejects)``. Raises :class:`MissingColumns` when the
    header line lacks a required column. An account whose rows name an
    unknown class takes none of its rows; ``rejects`` lists those accounts
    with the missing classes. Accepted rows are placed *before* the account's
    current rows (``ord`` below its minimum), in sheet order, so the roster
    order ``(given name, ord)`` lets new rows win ties, as a prepend followed
    by a stable sort does. ``row_no`` is the row's position in its sheet and
    is unique within an account's sheet.

    With ``sheet_col`` the batch holds several sheets, applied in that
    column's order as one import after another: the check refuses an
    (account, sheet) pair, and a later sheet's rows go before an earlier
    sheet's.
    """
    missing = missing_columns(sheet.columns)
    if missing:
        if sheet.isEmpty():  # an empty batch does nothing, whatever its header line
            return students.select(*S.STUDENT_COLUMNS), _no_rejects(sheet, sheet_col)
        raise MissingColumns(missing)
    by = ["account"] + ([sheet_col] if sheet_col else [])
    # One reduction of the batch tells which classes it names, which accounts
    # and sheets are refused, and how far each sheet's rows span; the sheet is
    # read a second time only for the rows themselves. Every side below has at
    # most a row for each row of the written summary, whose size is checked.
    summary = sheet_summary(sheet, sheet_col)
    small = fits_broadcast(summary)
    unknown = missing_classes(classes, sheet, sheet_col, summary, small)
    rejects = missing_class_report(unknown, sheet_col)
    refused = broadcast_when(small, unknown.select(*by).distinct())
    spans = summary.join(refused, by, "left_anti").groupBy(*by).agg(
        F.max("last_row").alias("_max_row"), (F.max("last_row") - F.min("first_row") + 1).alias("_span"))
    # Per-account marks, only for the accounts in the batch: a semi-join drops
    # other accounts' rows before the aggregation.
    batch_accounts = broadcast_when(small, spans.select("account").distinct())
    floor = broadcast_when(small, students.join(batch_accounts, "account", "left_semi")
                                          .groupBy("account").agg(F.min("ord").alias("_min_ord")))
    # Each accepted sheet takes a block of ords below the blocks of the sheets
    # applied before it; within its block, rows keep sheet order.
    earlier = (Window.partitionBy("account").orderBy(sheet_col if sheet_col else F.lit(0))
                     .rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("_before", F.coalesce(F.sum("_span").over(earlier), F.lit(0)))
    marks = broadcast_when(small, spans.join(floor, "account", "left"))
    rows = normalise_roster(sheet, keep=tuple(by[1:]))
    ordered = (rows.join(marks, by)
                   .withColumn("ord", (F.coalesce(F.col("_min_ord"), F.lit(1)) - F.lit(1) - F.col("_before")
                                       - (F.col("_max_row") - F.col("row_no"))).cast("long")))
    new = ordered.select(*S.STUDENT_COLUMNS)
    return students.select(*S.STUDENT_COLUMNS).unionByName(new), rejects
