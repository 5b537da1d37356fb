"""Scalar rules: trim, truthiness, numeric prefix parse, two-decimal rounding, sort key."""

import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from classledger.functions import (contains_whitespace, final_grade, given_name_key, grade_or,
                                   grade_truthy, js_or, js_trim, parse_grade, roster_sort_key,
                                   starts_with_digit, to_fixed2)


def one(spark, expr, value, dtype="string"):
    return spark.createDataFrame([(value,)], f"x {dtype}").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("text,want", [
    ("8.5abc", 8.5), ("7,5", 7.0), ("1e", 1.0), (".5", 0.5), ("abc", 0.0), ("", 0.0), (None, 0.0),
    ("NaN", 0.0), ("  12", 12.0), ("\t  3.25", 3.25), ("-0", 0.0), ("+4", 4.0), ("1e2x", 100.0),
    ("5.", 5.0), ("Infinity", float("inf")), ("-Infinity", float("-inf")), ("0x10", 0.0),
])
def test_parse_grade(spark, text, want):
    assert one(spark, parse_grade, text) == want


@pytest.mark.parametrize("text,want", [
    (" a\t", "a"), ("\ufeff b\u00a0", "b"), ("\u3000c d\u000b", "c d"), ("", ""), ("x", "x"),
    ("\u2028y\u2029", "y"), ("\u0085z", "\u0085z"),
])
def test_js_trim(spark, text, want):
    assert one(spark, js_trim, text) == want


@pytest.mark.parametrize("text,want", [
    (None, False), ("", False), ("0", False), ("0.0", False), ("-0", False), ("00", False),
    ("abc", True), ("7", True), ("0,5", True), (" 0", True), ("0\n", True),
])
def test_grade_truthy(spark, text, want):
    assert one(spark, grade_truthy, text) == want


def test_js_or_and_grade_or(spark):
    df = spark.createDataFrame([(None, "b"), ("", "b"), ("a", "b"), ("", None)], "a string, b string")
    assert [r.o for r in df.select(js_or("a", "b").alias("o")).collect()] == ["b", "b", "a", None]
    df = spark.createDataFrame([("0", "7"), ("abc", "7"), (None, "0"), ("9", None)], "a string, b string")
    assert [r.o for r in df.select(grade_or("a", "b").alias("o")).collect()] == ["7", "abc", "0", "9"]


def exact_to_fixed2(x: float) -> float:
    return float(Decimal(x).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP))


def test_to_fixed2_matches_exact_model(spark):
    rnd = random.Random(7)
    vals = [rnd.randint(0, 20000) / 1000 for _ in range(3000)]
    vals += [(rnd.randint(0, 1000) + rnd.randint(0, 1000) / 100) / 2 for _ in range(3000)]
    vals += [rnd.uniform(-50, 50) for _ in range(2000)]
    vals += [8.125, 8.305, 0.125, 2.675, 1.005, -8.125, -2.675, 0.0, 10.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r.y for r in df.select(to_fixed2("x").alias("y")).collect()]
    want = [exact_to_fixed2(v) + 0.0 for v in vals]
    bad = [(v, g, w) for v, g, w in zip(vals, got, want) if g != w]
    assert not bad, bad[:5]


def test_final_grade_examples(spark):
    df = spark.createDataFrame([("8.3", "8.31"), ("8.25", "8"), ("7,5", "8"), ("abc", "9")],
                               "a string, b string")
    got = [r.f for r in df.select(final_grade("a", "b").alias("f")).collect()]
    assert got == [8.30, 8.13, 7.50, 4.50]


def test_given_name_key_and_collation(spark):
    names = ["x Đức", "x Dung", "x ba", "x Ba", "x Ân", "x Ăn", "x Ánh", "x An", "Ngô Ân "]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "n string, i long")
    assert one(spark, given_name_key, "Ngô Ân ") == ""
    order = [r.n for r in df.orderBy(roster_sort_key("n"), "i").collect()]
    assert order == ["Ngô Ân ", "x An", "x Ánh", "x Ăn", "x Ân", "x ba", "x Ba", "x Dung", "x Đức"]


def test_account_name_rules(spark):
    df = spark.createDataFrame([("1a",), ("a b",), ("a\u00a0b",), ("ab",), ("\u0663x",)], "x string")
    got = [(r.d, r.w) for r in df.select(starts_with_digit("x").alias("d"),
                                         contains_whitespace("x").alias("w")).collect()]
    assert got == [(True, False), (False, True), (False, True), (False, False), (False, False)]


def test_negative_zero_is_folded(spark):
    import math
    assert math.copysign(1.0, one(spark, parse_grade, "-0")) == 1.0
    assert math.copysign(1.0, one(spark, to_fixed2, -0.001, "double")) == 1.0
    assert one(spark, to_fixed2, -0.006, "double") == -0.01


def test_final_grade_grid_matches_exact_model(spark):
    from classledger.functions import final_grade_of
    pairs = spark.range(0, 201 * 201).select((F.floor(F.col("id") / 201) * 0.05).alias("q"),
                                             ((F.col("id") % 201) * 0.05).alias("t"))   # 40,401 pairs
    rows = pairs.select("q", "t", final_grade_of("q", "t").alias("f")).collect()
    bad = [(r.q, r.t, r.f) for r in rows if r.f != exact_to_fixed2((r.q + r.t) / 2) + 0.0]
    assert not bad, bad[:5]
