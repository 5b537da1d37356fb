"""Grade sheet merge (first match), point grades and their checks."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import final_grade_of, grade_truthy, js_or, js_string_key, parse_grade, truthy
from .joins import broadcast_if_small, broadcast_when, fits_broadcast
from ..session import materialise
from .ranking import first_by_row

if TYPE_CHECKING:
    from ..sources.bucketed import BucketedStudents


def _cell(sheet: DataFrame, name: str):
    """A sheet column, or NULL when the sheet has no such header."""
    return F.col(f"`{name}`") if name in sheet.columns else F.lit(None).cast("string")


KEYS = ["account", "_id_key", "_class_key"]


def sheet_first_rows(sheet: DataFrame, classes: DataFrame | None = None, sheet_col: str | None = None):
    """The first row of each (account, trimmed id, trimmed class) key in each sheet.

    Returns ``(keyed, first)``: the keyed sheet rows and, per key and sheet
    (``_sheet``), the midterm cell and the exam cell that row contributes (the
    first truthy of its two exam cells). Accounts without classes are dropped
    when ``classes`` is given (the import is refused there).
    """
    mid, (kt, thi) = S.H_MIDTERM, S.H_EXAM
    keyed = sheet.select(
        "account", "row_no",
        (F.col(sheet_col) if sheet_col else F.lit(0)).alias("_sheet"),
        js_string_key(_cell(sheet, S.H_ID)).alias("_id_key"),
        js_string_key(js_or(_cell(sheet, S.H_CLASS[0]), _cell(sheet, S.H_CLASS[1]))).alias("_class_key"),
        _cell(sheet, mid).alias("_mid"), _cell(sheet, kt).alias("_kt"), _cell(sheet, thi).alias("_thi"))
    if classes is not None:
        keyed = keyed.join(classes.select("account").distinct(), "account", "left_semi")
    first = first_by_row(keyed, KEYS + ["_sheet"], "row_no", ["_mid", "_kt", "_thi"])
    first = first.withColumn("_exam", F.when(grade_truthy("_kt"), F.col("_kt"))
                                       .when(grade_truthy("_thi"), F.col("_thi")))
    return keyed, first.select(*KEYS, "_sheet", "_mid", "_exam")


def _student_keys(students: DataFrame) -> DataFrame:
    return students.withColumns({"_id_key": js_string_key("student_id"),
                                 "_class_key": js_string_key("class_name")})


def merge_grades(students: DataFrame, sheet: DataFrame, classes: DataFrame | None = None,
                 sheet_col: str | None = None, keep_sheets: bool = False) -> DataFrame:
    """Merge a grade sheet into the students table; adds ``matched``.

    Each student takes the *first* sheet row (by ``row_no``) of its account
    whose trimmed id and trimmed class equal its own; a missing value compares
    as the text ``undefined`` on both sides. Value rules: midterm is the sheet
    cell when present (0 included), exam the first truthy of the two exam
    cells, else the stored value; every matched row gets a new final grade.

    With ``sheet_col`` the batch holds several sheets, applied in that
    column's order exactly as one import after another: matching does not
    depend on the order, and each value rule overwrites only when its cell is
    there, so the latest sheet with a present midterm (or a truthy exam cell)
    wins. With ``keep_sheets`` too, ``matched_sheets`` lists the sheets that
    name the student.

    Accounts with no class (when ``classes`` is given) take no sheet rows: the
    import is refused there. An account with no student has nothing to match.
    """
    # The sheet is a batch: its first rows are written once (the sheet is read
    # once, and its lineage ends there); when provably small, the students
    # table is streamed past a broadcast of them and never shuffled.
    first = broadcast_if_small(materialise(merge_cells(sheet, classes, sheet_col), "sheet-first"))
    return _merged(_student_keys(students), first, students.columns, SHEETS if sheet_col and keep_sheets else None)


#: Column of a merge of several sheets: the sheets that hold the student's key.
SHEETS = "matched_sheets"


def merge_cells(sheet: DataFrame, classes: DataFrame | None = None, sheet_col: str | None = None) -> DataFrame:
    """What a sheet, or a batch of sheets in order, gives each key: ``_mid`` and ``_exam`` cells and ``_hit``.

    With ``sheet_col`` also ``matched_sheets``: the sheets that name the key,
    each once, so their number bounds it.
    """
    _, first = sheet_first_rows(sheet, classes, sheet_col)
    cells = [F.col("_mid"), F.col("_exam"), F.lit(True).alias("_hit")]
    if sheet_col:
        first = first.groupBy(*KEYS).agg(
            F.max_by("_mid", F.when(F.col("_mid").isNotNull(), F.col("_sheet"))).alias("_mid"),
            F.max_by("_exam", F.when(F.col("_exam").isNotNull(), F.col("_sheet"))).alias("_exam"),
            F.collect_set("_sheet").alias(SHEETS))
        cells.append(F.col(SHEETS))
    return first.select(*KEYS, *cells)


def _merged(keyed: DataFrame, first: DataFrame, columns: list[str], sheets: str | None = None) -> DataFrame:
    j = keyed.join(first, KEYS, "left")
    matched = F.coalesce(F.col("_hit"), F.lit(False))
    new_mid = F.when(matched & F.col("_mid").isNotNull(), parse_grade("_mid")).otherwise(F.col("midterm"))
    new_exam = F.when(matched & F.col("_exam").isNotNull(), parse_grade("_exam")).otherwise(F.col("exam"))
    out = j.withColumns({"midterm": new_mid, "exam": new_exam})
    out = out.withColumn("final_grade", F.when(matched, final_grade_of("midterm", "exam"))
                                         .otherwise(F.col("final_grade")))
    return out.select(*columns, matched.alias("matched"), *([sheets] if sheets else []))


def merge_grades_by_bucket(students: BucketedStudents, sheet: DataFrame, path: str, classes: DataFrame | None = None,
                           sheet_col: str | None = None) -> DataFrame:
    """:func:`merge_grades` for bucketed students and a sheet too large to broadcast.

    The sheet's cells are written at ``path`` in the students' buckets, so the
    join reads both sides bucket by bucket: no student row is exchanged. Rows of
    hot ids are merged as usual.
    """
    from ..sources.bucketed import SORT_KEY, write_buckets

    cells = merge_cells(sheet, classes, sheet_col)
    first = write_buckets(cells, path, students.buckets, SORT_KEY)
    columns = list(S.STUDENT_COLUMNS)
    # Rows of hot ids meet the same files read without their buckets, which a skewed join may split.
    plain = sheet.sparkSession.read.parquet(path)
    return _merged(students.bucketed, first.hint("merge"), columns).unionByName(_merged(students.hot, plain, columns))


def observe_updates(merged: DataFrame, name: str = "grade_merge"):
    """Attach an ``Observation`` counting matched students to a merge result.

    Returns ``(merged, observation)``; once an action runs on the returned
    DataFrame (e.g. writing the new snapshot), ``observation.get["updated"]``
    holds the count without a second pass over the students.
    """
    from pyspark.sql import Observation
    obs = Observation(name)
    return merged.observe(obs, F.count_if(F.col("matched")).alias("updated")), obs


def merge_counts_by_sheet(merged: DataFrame, sheet_col: str) -> DataFrame:
    """Students updated by each sheet of a batch, per ``(account, sheet)``, from a merge result (matched ones only)."""
    hits = merged.where("matched").select("account", F.explode(SHEETS).alias(sheet_col))
    return hits.groupBy("account", sheet_col).agg(F.count(F.lit(1)).alias("updated"))


def merge_counts(merged: DataFrame) -> DataFrame:
    """Number of students updated by a merge, per account (zero included)."""
    return merged.groupBy("account").agg(F.count_if(F.col("matched")).cast("long").alias("updated"))


def grade_import_allowed(classes: DataFrame, students: DataFrame) -> DataFrame:
    """Accounts that hold at least one class and at least one student."""
    return (classes.select("account").distinct()
                   .join(students.select("account").distinct(), "account", "left_semi"))


def checked_entries(students: DataFrame, classes: DataFrame, entries: DataFrame):
    """The latest valid entry of each id, the rejected entries with their reason, and the checked batch; see :func:`set_grades`."""
    if "row_no" not in entries.columns:
        raise ValueError("point grades need a row_no column: of several entries for one id the last wins")
    # The (account, class) pairs that the entries name, written once; each side
    # below has at most a row for each pair, whose size is checked.
    chosen = materialise(entries.select("account", "class_name").distinct(), "entry-classes")
    small = fits_broadcast(chosen)
    wanted = broadcast_when(small, chosen)
    populated = broadcast_when(small, (
        students.where(F.col("class_name").isNotNull())
                .join(wanted, ["account", "class_name"], "left_semi")
                .groupBy("account", "class_name").agg(F.lit(True).alias("_populated"))))
    named = broadcast_when(small, chosen.select("account").distinct())
    has_class = broadcast_when(small, classes.join(named, "account", "left_semi")
                                             .groupBy("account").agg(F.lit(True).alias("_has_class")))
    reason = (F.when(F.col("_has_class").isNull(), F.lit("no_class"))
               .when(truthy("class_name") & F.col("_populated").isNull(), F.lit("class_has_no_students"))
               .when(~truthy("student_id"), F.lit("no_student_chosen")))
    # The checked batch is written once: rejects and the latest entries are read from it.
    checked = materialise(entries.join(has_class, "account", "left")
                                 .join(populated, ["account", "class_name"], "left")
                                 .select(*entries.columns, reason.alias("reason")), "checked-entries")
    rejects = checked.where(F.col("reason").isNotNull())
    valid = checked.where(F.col("reason").isNull())
    latest = first_by_row(valid, ["account", "student_id"], "row_no", ["midterm", "exam"], last=True)
    latest = latest.select("account", "student_id", F.col("midterm").alias("_mid"),
                           F.col("exam").alias("_exam"), F.lit(True).alias("_hit"))
    return latest, rejects, checked


def set_grades(students: DataFrame, classes: DataFrame, entries: DataFrame):
    """Apply point grades ``(account, class_name, student_id, midterm, exam, row_no)``.

    Checks, first failing wins: the account has no class; the chosen class has
    no student; no student chosen. A valid entry overwrites midterm and exam of
    *every* row with that id in the account (the class is not part of the key);
    of several entries for one id the last (by ``row_no``) wins.
    Returns ``(students, rejects)``.
    """
    latest, rejects, checked = checked_entries(students, classes, entries)
    # A batch that fits bounds its latest entries; of a larger one they are written and checked themselves.
    latest = F.broadcast(latest) if fits_broadcast(checked) else broadcast_if_small(materialise(latest, "latest-entries"))
    return _with_entries(students, latest, ["account", "student_id"], students.columns), rejects


def set_grades_by_bucket(students: BucketedStudents, classes: DataFrame, entries: DataFrame, path: str):
    """:func:`set_grades` for bucketed students and more entries than a broadcast holds; see :func:`merge_grades_by_bucket`."""
    from ..sources.bucketed import BUCKET_KEY, write_buckets

    latest, rejects, _ = checked_entries(students.all(), classes, entries)
    latest = latest.withColumn("_id_key", js_string_key("student_id"))
    side = write_buckets(latest, path, students.buckets, BUCKET_KEY)
    on, columns = [*BUCKET_KEY, "student_id"], list(S.STUDENT_COLUMNS)
    plain = entries.sparkSession.read.parquet(path)
    out = _with_entries(students.bucketed, side.hint("merge"), on, columns)
    return out.unionByName(_with_entries(students.hot, plain, on, columns)), rejects


def _with_entries(students: DataFrame, latest: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    j = students.join(latest, on, "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    out = j.withColumns({"midterm": F.when(hit, F.col("_mid")).otherwise(F.col("midterm")),
                         "exam": F.when(hit, F.col("_exam")).otherwise(F.col("exam"))})
    out = out.withColumn("final_grade", F.when(hit, final_grade_of("midterm", "exam"))
                                         .otherwise(F.col("final_grade")))
    return out.select(*columns)


# Outcome of a grade import per account.
IMPORT_UPDATED = "updated"
IMPORT_NO_MATCH = "no_match"
IMPORT_REFUSED = "refused"


def grade_import_report(students: DataFrame, classes: DataFrame, sheet: DataFrame,
                        merged: DataFrame | None = None, sheet_col: str | None = None) -> DataFrame:
    """Outcome of a grade import for every account named in the sheet (and every sheet).

    ``refused`` when the account has no class or no student (nothing is
    read); ``no_match`` when no student matched (state unchanged, a warning);
    else ``updated`` with the number of students changed. Pass the result of
    :func:`merge_grades` as ``merged`` (with ``keep_sheets`` for several sheets)
    to count from it instead of merging again; with ``sheet_col`` each sheet of the batch gets its own line.
    """
    by = ["account"] + ([sheet_col] if sheet_col else [])
    allowed = grade_import_allowed(classes, students).withColumn("_ok", F.lit(True))
    if merged is None or sheet_col and SHEETS not in merged.columns:
        merged = merge_grades(students, sheet, classes, sheet_col, keep_sheets=True)
    counts = merge_counts_by_sheet(merged, sheet_col) if sheet_col else merge_counts(merged)
    named = sheet.select(*by).distinct()
    j = named.join(allowed, "account", "left").join(counts, by, "left")
    n = F.coalesce(F.col("updated"), F.lit(0)).cast("long")
    status = (F.when(F.col("_ok").isNull(), F.lit(IMPORT_REFUSED))
               .when(n == 0, F.lit(IMPORT_NO_MATCH))
               .otherwise(F.lit(IMPORT_UPDATED)))
    return j.select(*by, status.alias("status"),
                    F.when(F.col("_ok").isNull(), F.lit(0).cast("long")).otherwise(n).alias("updated"))
