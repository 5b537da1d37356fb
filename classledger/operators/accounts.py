"""Accounts: registration screening, listing and cascading deletion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import contains_whitespace, starts_with_digit
from ..session import materialise
from .joins import broadcast_if_small, broadcast_when, fits_broadcast
from .ranking import positions_within

# Verdict codes, in the order the checks run.
R_DIGIT = "starts_with_digit"
R_SPACE = "contains_whitespace"
R_SHORT = "secret_too_short"
R_EXISTS = "already_exists"
ACCEPTED = "accepted"


def screen_accounts(accounts: DataFrame, candidates: DataFrame) -> DataFrame:
    """Verdict for each registration ``(row_no, account, secret_length)``.

    Rules in order, first failing wins: starts with a digit, contains
    whitespace, secret shorter than 8, name already taken (exact, case
    sensitive). Within the batch the first rule-passing row of a name (by
    ``row_no``) is accepted and later ones find the name taken, as serial
    registration does. Only a secret *length* ever enters the engine.
    """
    rule = (F.when(starts_with_digit("account"), F.lit(R_DIGIT))
             .when(contains_whitespace("account"), F.lit(R_SPACE))
             .when(F.coalesce(F.col("secret_length"), F.lit(0)) < F.lit(S.MIN_SECRET_LENGTH), F.lit(R_SHORT)))
    ruled = candidates.withColumn("_rule", rule)
    # One row per name, with its first rule-passing row (a name repeated by a
    # third of the batch is reduced map-side), written once: the batch is read
    # for it and for the verdicts, and the written names are what is checked.
    names = materialise(ruled.groupBy("account").agg(
        F.min(F.when(F.col("_rule").isNull(), F.col("row_no"))).alias("_first_row")), "candidate-names")
    small = fits_broadcast(names)
    wanted = broadcast_when(small, names.select("account"))
    taken = broadcast_when(small, accounts.join(wanted, "account", "left_semi").select("account")
                                          .distinct().withColumn("_taken", F.lit(True)))
    known = broadcast_when(small, names.join(taken, "account", "left"))
    verdict = (F.when(F.col("_rule").isNotNull(), F.col("_rule"))
                .when(F.col("_taken"), F.lit(R_EXISTS))
                .when(F.col("row_no") == F.col("_first_row"), F.lit(ACCEPTED))
                .otherwise(F.lit(R_EXISTS)))
    j = ruled.join(known, "account", "left")
    return j.select("row_no", "account", "secret_length", verdict.alias("verdict"))


def register_accounts(accounts: DataFrame, screened: DataFrame) -> DataFrame:
    """Append accepted registrations as empty, non-admin accounts after the existing ones."""
    acc = screened.where(F.col("verdict") == F.lit(ACCEPTED))
    # Two scalar subqueries, each evaluated once: no join is needed.
    top = accounts.select(F.coalesce(F.max("ord"), F.lit(0)).alias("_m")).scalar()
    first = acc.select(F.min("row_no").alias("_r")).scalar()
    new = acc.select("account", F.lit(False).alias("is_admin"),
                     (top + F.lit(1) + F.col("row_no") - first).cast("long").alias("ord"))
    return accounts.select("account", "is_admin", "ord").unionByName(new)


def account_listing(accounts: DataFrame, classes: DataFrame) -> DataFrame:
    """Running number, account, role label and number of classes per account."""
    n_classes = classes.groupBy("account").agg(F.count(F.lit(1)).alias("_n"))
    numbered = positions_within(accounts, [], ["ord"], out="no")
    role = F.when(F.col("is_admin"), F.lit(S.ROLE_ADMIN)).otherwise(F.lit(S.ROLE_TEACHER))
    return (numbered.join(n_classes, "account", "left")
                    .select("no", "account", role.alias("role"),
                            F.coalesce(F.col("_n"), F.lit(0)).cast("long").alias("n_classes")))


def deletable(keys: DataFrame) -> DataFrame:
    """The delete set without the protected ``admin`` account (by name)."""
    return keys.select("account").where(F.col("account") != F.lit(S.ADMIN_ACCOUNT)).distinct()


def delete_accounts(accounts: DataFrame, classes: DataFrame, students: DataFrame, keys: DataFrame):
    """Delete accounts with their classes and students; ``admin`` is never deleted.

    Returns ``(accounts, classes, students)``.
    """
    k = broadcast_if_small(deletable(keys))
    return (accounts.join(k, "account", "left_anti"),
            classes.join(k, "account", "left_anti"),
            students.join(k, "account", "left_anti"))
