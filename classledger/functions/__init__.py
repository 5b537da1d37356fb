"""Column expressions with the exact scalar semantics the gradebook needs."""

from .text import (contains_ci, contains_whitespace, given_name_key, js_or, js_trim,
                   js_string_key, roster_sort_key, starts_with_digit, truthy)
from .grades import (final_grade, final_grade_of, grade_number, grade_or, grade_truthy,
                     parse_grade, to_fixed2)

__all__ = [
    "contains_ci", "contains_whitespace", "given_name_key", "js_or", "js_trim", "js_string_key",
    "roster_sort_key", "starts_with_digit", "truthy", "final_grade", "grade_truthy", "grade_or",
    "parse_grade", "to_fixed2", "final_grade_of", "grade_number",
]
