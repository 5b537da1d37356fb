"""Birth dates as typed dates.

Stored birth dates are text as the sheet or the form gave them: an ISO date from
a date field, a day/month/year date as the sheets' users write it, or the serial
day number a spreadsheet keeps for a date cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import _col, js_trim

# Day 0 of spreadsheet serial numbers, and the largest serial number (9999-12-31).
# Day numbers up to 60 lie before or on the spreadsheets' 29 February 1900, which never was.
SERIAL_EPOCH = "1899-12-30"
LAST_SERIAL = 2_958_465
FICTIONAL_DAY = 60


def birth_date_value(c) -> Column:
    """The date a birth-date text means, NULL if it means none.

    ``yyyy-mm-dd`` (a time after it is dropped), ``d/m/yyyy``, or a serial day
    number with or without a fraction of the day. A day that is no day of its
    month gives NULL, as do other texts. Serial numbers up to 60 are a day off in
    spreadsheets, which count a 29 February 1900: 1 to 59 are moved, 60 is NULL.
    """
    text = js_trim(_col(c))
    iso = F.regexp_extract(text, r"^([0-9]{4}-[0-9]{2}-[0-9]{2})(?:[T ].*)?$", 1).try_cast("date")
    dmy = F.regexp_replace(F.regexp_extract(text, r"^([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})$", 1),
                           r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$", "$3-$2-$1").try_cast("date")
    day = F.regexp_extract(text, r"^([0-9]{1,7})(?:\.[0-9]*)?$", 1).try_cast("int")
    moved = F.when((day >= 1) & (day < FICTIONAL_DAY), day + 1).when((day > FICTIONAL_DAY) & (day <= LAST_SERIAL), day)
    serial = F.date_add(F.lit(SERIAL_EPOCH).cast("date"), moved)
    return F.coalesce(iso, dmy, serial)


def with_birth_dates(students: DataFrame) -> DataFrame:
    """Students with ``birth_day`` (a date) beside the stored text."""
    return students.withColumn("birth_day", birth_date_value("birth_date"))
