"""Grade parsing and the two-decimal final grade.

``parse_grade`` reads the longest numeric prefix of a cell the way the
script-language ``parseFloat(x) || 0`` does; ``to_fixed2`` rounds the exact
binary value half away from zero, as ``Number.prototype.toFixed(2)`` does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import JS_SPACE_CLASS, truthy

# Numeric prefix grammar (optional sign, Infinity or a decimal
# literal with optional exponent) after leading whitespace.
NUMERIC_PREFIX = (JS_SPACE_CLASS + r"*([+-]?(?:Infinity|(?:[0-9]+\.?[0-9]*|\.[0-9]+)"
                  r"(?:[eE][+-]?[0-9]+)?))")
# A cell that is entirely a plain number, i.e. what a spreadsheet stores as a number.
NUMERIC_CELL = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _positive_zero(v: Column) -> Column:
    """Fold -0.0 into 0.0 (IEEE: -0.0 + 0.0 = +0.0) while referencing ``v`` once."""
    return v + F.lit(0.0)


def parse_grade(c) -> Column:
    """``parseFloat(x) || 0`` on a text or numeric column, as DOUBLE.

    The prefix regex runs once per cell: an empty prefix fails the cast and
    becomes 0 through ``coalesce``.
    """
    c = _col(c)
    prefix = F.regexp_extract(c.cast("string"), "^" + NUMERIC_PREFIX, 1)
    return _positive_zero(F.coalesce(prefix.try_cast("double"), F.lit(0.0)))


def grade_truthy(c) -> Column:
    """Truthiness of a grade cell read as text.

    A blank cell is falsy; a cell holding a plain number is falsy when that
    number is zero (a spreadsheet stores it as the number 0); any other text
    is truthy.
    """
    c = _col(c)
    numeric_zero = c.rlike(NUMERIC_CELL) & (c.try_cast("double") == F.lit(0.0))
    return truthy(c) & ~F.coalesce(numeric_zero, F.lit(False))


def grade_or(*cols) -> Column:
    """``a || b || …`` over grade cells: first truthy cell, else the last one."""
    cols = [_col(c) for c in cols]
    out = cols[-1]
    for c in reversed(cols[:-1]):
        out = F.when(grade_truthy(c), c).otherwise(out)
    return out


def to_fixed2(x) -> Column:
    """Round to two decimals as ``toFixed(2)`` does, returned as DOUBLE.

    A true binary tie at two decimals can only sit on a multiple of 1/8, which
    has at most three decimals, so ``round`` (half up) is exact there; every
    other value is rounded from its exact binary expansion by ``format_number``.
    """
    x = _col(x)
    scaled = x * F.lit(8.0)
    exact_eighth = scaled == F.floor(scaled)
    # Not a number and the infinities stay as they are; format_number has no text for them.
    rounded = F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), x).when(exact_eighth, F.round(x, 2)).otherwise(
        F.call_function("format_number", x, F.lit("0.00")).cast("double"))
    return _positive_zero(rounded)


def final_grade(midterm, exam) -> Column:
    """Mean of the two grades, each read as ``parseFloat(x) || 0``, to two decimals."""
    q = parse_grade(midterm)
    t = parse_grade(exam)
    return to_fixed2((q + t) / F.lit(2.0))


def grade_number(c) -> Column:
    """``parseFloat(x) || 0`` for a column that is already DOUBLE (no text round trip)."""
    c = _col(c)
    return F.when(c.isNull() | F.isnan(c) | (c == F.lit(0.0)), F.lit(0.0)).otherwise(c)


def final_grade_of(midterm, exam) -> Column:
    """Final grade from two DOUBLE grade columns."""
    return to_fixed2((grade_number(midterm) + grade_number(exam)) / F.lit(2.0))
