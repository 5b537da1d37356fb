"""Text predicates and keys (trim, truthiness, search, roster sort key).

All are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values:
# - the whitespace class of the ECMAScript WhiteSpace and LineTerminator
#   productions (TAB, LF, VT, FF, CR, BOM and every Unicode space/line/
#   paragraph separator), written so Java and RE2 read it the same;
# - the locale whose collation orders given names (Vietnamese).
JS_SPACE_CLASS = r"[\t\n\x0B\f\r\x{FEFF}\p{Z}]"
ROSTER_COLLATION = "vi"

_TRIM_PATTERN = rf"^{JS_SPACE_CLASS}+|{JS_SPACE_CLASS}+\z"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def truthy(c) -> Column:
    """A text cell that is present and not empty."""
    c = _col(c)
    return c.isNotNull() & (c != F.lit(""))


def js_or(*cols) -> Column:
    """``a || b || … || last``: the first truthy text, else the last operand as is."""
    cols = [_col(c) for c in cols]
    out = cols[-1]
    for c in reversed(cols[:-1]):
        out = F.when(truthy(c), c).otherwise(out)
    return out


def js_trim(c) -> Column:
    """Trim with the script language's notion of whitespace (Spark ``trim`` only drops U+0020)."""
    return F.regexp_replace(_col(c), _TRIM_PATTERN, "")


def js_string_key(c) -> Column:
    """``String(x).trim()``: a missing value becomes the text ``undefined``."""
    return F.coalesce(js_trim(c), F.lit("undefined"))


def contains_ci(c, term: str) -> Column:
    """Case-insensitive, accent-sensitive substring test; ``lower(term)`` is folded at plan time."""
    return F.contains(F.lower(_col(c)), F.lower(F.lit(term)))


def starts_with_digit(c) -> Column:
    return _col(c).rlike("^[0-9]")


def contains_whitespace(c) -> Column:
    return _col(c).rlike(JS_SPACE_CLASS)


def given_name_key(full_name) -> Column:
    """Last space-separated token of the name; a trailing space gives ``''``."""
    return F.element_at(F.split(_col(full_name), " "), -1)


def roster_sort_key(full_name) -> Column:
    """Given name under Vietnamese collation: the primary roster order key."""
    return F.collate(given_name_key(full_name), ROSTER_COLLATION)
