"""Worked example 4: account screening (V7, V8), listing (P6, A5, O3), deletion (M3, V11)."""

from classledger import schema as S
from classledger.operators.accounts import (account_listing, delete_accounts, register_accounts,
                                            screen_accounts)


def accounts(spark):
    return spark.createDataFrame([("admin", True, 0)], S.ACCOUNTS)


def candidates(spark):
    rows = [(1, "1teacher", 4), (2, "co giao", 9), (3, "thay", 7), (4, "admin", 8), (5, "thay", 8),
            (6, "thay", 12), (7, "Admin", 8)]
    return spark.createDataFrame(rows, "row_no bigint, account string, secret_length int")


def test_example4(spark):
    got = [(r.row_no, r.verdict) for r in
           screen_accounts(accounts(spark), candidates(spark)).orderBy("row_no").collect()]
    assert got == [(1, "starts_with_digit"), (2, "contains_whitespace"), (3, "secret_too_short"),
                   (4, "already_exists"), (5, "accepted"), (6, "already_exists"), (7, "accepted")]


def test_listing_after_registration(spark):
    reg = register_accounts(accounts(spark), screen_accounts(accounts(spark), candidates(spark)))
    classes = spark.createDataFrame([("thay", "CT01", 0), ("thay", "CT02", 1)], S.CLASSES)
    got = [tuple(r) for r in account_listing(reg, classes).orderBy("no").collect()]
    assert got == [(1, "admin", "Quản trị viên", 0), (2, "thay", "Giảng viên", 2),
                   (3, "Admin", "Giảng viên", 0)]


def test_delete_accounts_protects_admin_and_cascades(spark):
    reg = register_accounts(accounts(spark), screen_accounts(accounts(spark), candidates(spark)))
    classes = spark.createDataFrame([("thay", "CT01", 0), ("admin", "A1", 0)], S.CLASSES)
    students = spark.createDataFrame([("thay", "S1", "n", "", "Nam", "CT01", 0.0, 0.0, 0.0, 0)], S.STUDENTS)
    keys = spark.createDataFrame([("admin",), ("thay",)], "account string")
    a, c, s = delete_accounts(reg, classes, students, keys)
    assert sorted(r.account for r in a.collect()) == ["Admin", "admin"]
    assert [r.account for r in c.collect()] == ["admin"]
    assert s.count() == 0
