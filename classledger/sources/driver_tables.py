"""The gradebook tables as views over the driver's TPC-H-style tables.

Mapping (every view reads whole tables; nothing is sampled or capped):

* accounts  = region; region 0 is the protected ``admin`` account.
* classes   = nation, owned by its region's account, one class without students
  for each account, and a class of the account ``DESK``, which has no student.
* students  = customer in its nation's class; some AUTOMOBILE customers have no
  class (orphans).
* rosters   = part as students of class ``p_brand`` (two-word names, many
  given-name ties), owned by account ``p_partkey % 5``.
* grade_sheet  = orders as grade sheet rows (``row_no`` = ``o_orderkey``), with
  blank, alias, zero, padded and unknown-class cells; some rows belong to
  ``DESK``, some to ``GUEST``, which has no class; ``sheet_no`` (the order
  status) splits it into sheets applied in turn.
* roster_sheet = supplier rows as a roster sheet with alias columns;
  ``sheet_no`` (``s_suppkey % 3``) splits it into three sheets.
* new_students / new_classes = supplier rows as additions, some blank.
* edits = customers, one edit each; edits_in_order = orders as edits of the
  order's customer, with renames that later edits meet; grade_entries = orders
  (some of ``GUEST``); account_candidates = three registrations per part plus
  the region names; birth_texts = customers' birth dates in several spellings.

Every derived cell is written with the same integer arithmetic in the
oracle SQL (``classledger.plans.oracle``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import final_grade_of


_TABLES: dict[tuple[int, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A lazy DataFrame over one driver table, reused within a session.

    Only the plan is kept (no data is cached): it spares repeated footer reads
    when one query reads the same table several times.
    """
    key = (id(spark), f"{sf_dir}/{name}.parquet")
    df = _TABLES.get(key)
    if df is None or df.sparkSession is not spark:
        df = spark.read.parquet(key[1])
        _TABLES[key] = df
    return df


def _s(c) -> F.Column:
    return F.col(c).cast("string")


def _mod(c: str, m: int) -> F.Column:
    return F.col(c) % F.lit(m)


def _account_of_region() -> F.Column:
    return F.when(F.col("r_regionkey") == F.lit(0), F.lit(S.ADMIN_ACCOUNT)).otherwise(F.col("r_name"))


def _nations(spark, sf_dir) -> DataFrame:
    """nation with its owning account."""
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return (nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
                  .select("n_nationkey", "n_name", _account_of_region().alias("account")))


EMPTY_CLASS = "CLASS_EMPTY"
GUEST, DESK = "GUEST", "DESK"  # accounts without a class, and with a class but no student


def accounts(spark, sf_dir) -> DataFrame:
    r = table(spark, sf_dir, "region")
    return r.select(_account_of_region().alias("account"),
                    (F.col("r_regionkey") == F.lit(0)).alias("is_admin"),
                    F.col("r_regionkey").cast("long").alias("ord"))


def classes(spark, sf_dir) -> DataFrame:
    """Every nation, and one class without students for each account."""
    named = _nations(spark, sf_dir).select("account", F.col("n_name").alias("class_name"),
                                           F.col("n_nationkey").cast("long").alias("ord"))
    empty = table(spark, sf_dir, "region").select(_account_of_region().alias("account"), F.lit(EMPTY_CLASS).alias("class_name"),
                                                  (F.col("r_regionkey") + 1000).cast("long").alias("ord"))
    desk = table(spark, sf_dir, "region").where(F.col("r_regionkey") == 0).select(
        F.lit(DESK).alias("account"), F.lit("CLASS_DESK").alias("class_name"), F.lit(2000).cast("long").alias("ord"))
    return named.unionByName(empty).unionByName(desk)


def _sheet_account(k: str) -> F.Column:
    """The account of a sheet row: some rows are of accounts that an import refuses."""
    return F.when(_mod(k, 97) == 0, F.lit(GUEST)).when(_mod(k, 89) == 0, F.lit(DESK)).otherwise(F.col("account"))


def _customers(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal",
                                                "c_mktsegment")
    n = _nations(spark, sf_dir)
    return c.join(n, c["c_nationkey"] == n["n_nationkey"])


def students(spark, sf_dir) -> DataFrame:
    c = _customers(spark, sf_dir)
    orphan = (F.col("c_mktsegment") == F.lit("AUTOMOBILE")) & (_mod("c_custkey", 10) == F.lit(0))
    out = c.select(
        "account",
        _s("c_custkey").alias("student_id"),
        F.col("c_name").alias("full_name"),
        F.date_add(F.lit("2000-01-01").cast("date"), _mod("c_custkey", 3650).cast("int"))
         .cast("string").alias("birth_date"),
        F.when(_mod("c_custkey", 3) == F.lit(0), F.lit("Nữ")).otherwise(F.lit("Nam")).alias("gender"),
        F.when(orphan, F.lit(None).cast("string")).otherwise(F.col("n_name")).alias("class_name"),
        (F.col("c_acctbal") / F.lit(1000.0)).alias("midterm"),
        (F.abs(F.col("c_acctbal")) / F.lit(1250.0)).alias("exam"),
        F.col("c_custkey").cast("long").alias("ord"))
    return out.withColumn("final_grade", final_grade_of("midterm", "exam")).select(*S.STUDENT_COLUMNS)


def rosters(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    j = p.join(r, _mod("p_partkey", 5) == r["r_regionkey"])
    return j.select(_account_of_region().alias("account"), _s("p_partkey").alias("student_id"),
                    F.col("p_name").alias("full_name"), F.lit("").alias("birth_date"),
                    F.lit("Nam").alias("gender"), F.col("p_brand").alias("class_name"),
                    F.lit(0.0).alias("midterm"), F.lit(0.0).alias("exam"),
                    F.lit(0.0).alias("final_grade"), F.col("p_partkey").cast("long").alias("ord"))


def grade_sheet(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = _nations(spark, sf_dir)
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, F.col("c_nationkey") == n["n_nationkey"])
    k = "o_orderkey"
    cls = F.when(F.col("o_orderstatus") == F.lit("P"), F.lit("NATION_X")).otherwise(F.col("n_name"))
    mssv = (F.when(_mod(k, 8) == 0, F.concat(F.lit(" "), _s("o_custkey"), F.lit("\t")))
             .when(_mod(k, 8) == 1, F.lit(None).cast("string"))
             .otherwise(_s("o_custkey")))
    mid = (F.when(_mod(k, 7) == 0, F.lit(None).cast("string"))
            .when(_mod(k, 7) == 1, F.lit("abc"))
            .when(_mod(k, 7) == 2, F.concat(_mod(k, 10).cast("string"), F.lit(",5")))
            .otherwise((F.col("o_totalprice") / F.lit(50000.0)).cast("string")))
    kt = (F.when(_mod(k, 5) == 0, F.lit("0"))
           .when(_mod(k, 5) == 1, F.lit(None).cast("string"))
           .when(_mod(k, 5) == 2, F.lit(""))
           .otherwise(_mod(k, 11).cast("string")))
    thi = F.when(_mod(k, 3) == 0, F.lit(None).cast("string")).otherwise(
        F.concat(_mod(k, 9).cast("string"), F.lit(".75")))
    return j.select(
        F.col(k).cast("long").alias("row_no"), _sheet_account(k).alias("account"),
        mssv.alias(S.H_ID),
        F.when(_mod(k, 6) == 0, F.lit(None).cast("string")).otherwise(cls).alias(S.H_CLASS[0]),
        F.when(_mod(k, 12) == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(cls, F.lit(" "))).alias(S.H_CLASS[1]),
        mid.alias(S.H_MIDTERM), kt.alias(S.H_EXAM[0]), thi.alias(S.H_EXAM[1]),
        F.col("o_orderstatus").alias("sheet_no"))


def _suppliers(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    n = _nations(spark, sf_dir)
    return s.join(n, s["s_nationkey"] == n["n_nationkey"])


def roster_sheet(spark, sf_dir) -> DataFrame:
    j = _suppliers(spark, sf_dir)
    k = "s_suppkey"
    null = F.lit(None).cast("string")
    name = (F.when(_mod(k, 4) == 0, null)
             .when(_mod(k, 4) == 1, F.concat(F.lit("Trần Văn "), F.col("s_name")))
             .when(_mod(k, 4) == 2, F.concat(F.lit("Lê Thị "), F.col("s_name"), F.lit(" ")))
             .otherwise(F.col("s_name")))
    lop = (F.when(_mod(k, 7) == 0, null)
            .when(_mod(k, 61) == 0, F.concat(F.col("n_name"), F.lit(" ")))
            .otherwise(F.col("n_name")))
    lhp = (F.when(_mod(k, 49) == 0, F.lit("NATION_X"))
            .when(_mod(k, 14) == 0, null)
            .otherwise(F.col("n_name")))
    return j.select(
        F.col(k).cast("long").alias("row_no"), "account",
        F.when(_mod(k, 9) == 0, null).otherwise(F.concat(F.lit("S"), _s(k))).alias(S.H_ID),
        name.alias(S.H_NAME[0]),
        F.concat(F.lit("Phạm "), F.col("s_name")).alias(S.H_NAME[1]),
        F.when(_mod(k, 10) == 0, F.lit("01/01/2000")).otherwise(null).alias(S.H_BIRTH[0]),
        F.when(_mod(k, 5) == 0, null).otherwise(
            F.date_add(F.lit("1990-01-01").cast("date"), F.col(k).cast("int")).cast("string"))
         .alias(S.H_BIRTH[1]),
        F.when(_mod(k, 3) == 0, null).when(_mod(k, 3) == 1, F.lit("Nữ")).otherwise(F.lit("Nam"))
         .alias(S.H_GENDER),
        lop.alias(S.H_CLASS[0]), lhp.alias(S.H_CLASS[1]),
        F.when(_mod(k, 6) == 0, null).when(_mod(k, 6) == 1, F.lit("abc"))
         .when(_mod(k, 6) == 2, F.lit("7,5"))
         .otherwise((F.col("s_acctbal") / F.lit(1000.0)).cast("string")).alias(S.H_MIDTERM),
        F.when(_mod(k, 5) == 0, F.lit("0")).when(_mod(k, 5) == 1, null)
         .otherwise(_mod(k, 11).cast("string")).alias(S.H_EXAM[0]),
        F.concat(_mod(k, 10).cast("string"), F.lit(".5")).alias(S.H_EXAM[1]),
        _mod(k, 3).cast("int").alias("sheet_no"))


def header_sheets(spark, sf_dir) -> DataFrame:
    """The roster sheet cut into eleven sheets, some of which lack required columns under all their names."""
    gone = {S.H_ID: (3, 8), S.H_NAME[0]: (4, 8), S.H_NAME[1]: (4, 8), S.H_BIRTH[0]: (5, 8), S.H_BIRTH[1]: (5, 8),
            S.H_GENDER: (6, 8), S.H_CLASS[0]: (7, 8), S.H_CLASS[1]: (7,)}
    sheet = roster_sheet(spark, sf_dir).withColumn("sheet_no", _mod("row_no", 11).cast("int"))
    return sheet.withColumns({h: F.when(~F.col("sheet_no").isin(*nos), F.col(f"`{h}`")) for h, nos in gone.items()})


def new_students(spark, sf_dir) -> DataFrame:
    j = _suppliers(spark, sf_dir)
    k = "s_suppkey"
    null = F.lit(None).cast("string")
    return j.select(
        F.col(k).cast("long").alias("row_no"), "account",
        F.when(_mod(k, 11) == 0, F.lit("")).otherwise(F.concat(F.lit("N"), _s(k))).alias("student_id"),
        F.when(_mod(k, 13) == 0, null).otherwise(F.concat(F.lit("Võ "), F.col("s_name"))).alias("full_name"),
        F.when(_mod(k, 17) == 0, F.lit("")).otherwise(F.lit("2001-02-03")).alias("birth_date"),
        F.when(_mod(k, 2) == 0, F.lit("Nữ")).otherwise(null).alias("gender"),
        F.when(_mod(k, 19) == 0, null).otherwise(F.col("n_name")).alias("class_name"))


def new_classes(spark, sf_dir) -> DataFrame:
    j = _suppliers(spark, sf_dir)
    k = "s_suppkey"
    name = (F.when(_mod(k, 10) == 0, F.lit(""))
             .when(_mod(k, 10) == 1, F.lit(" "))
             .when(_mod(k, 10) == 2, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("CLASS_"), _mod(k, 7).cast("string"))))
    return j.select(F.col(k).cast("long").alias("row_no"), "account", name.alias("class_name"))


def edits(spark, sf_dir) -> DataFrame:
    c = _customers(spark, sf_dir)
    k = "c_custkey"
    return c.select(
        "account", _s(k).alias("original_id"),
        F.when(_mod(k, 5) == 0, F.concat(F.lit("E"), _s(k))).otherwise(_s(k)).alias("student_id"),
        F.upper(F.col("c_name")).alias("full_name"), F.lit("1999-09-09").alias("birth_date"),
        F.lit("Nữ").alias("gender"), F.col("n_name").alias("class_name"),
        (F.col("c_acctbal") / F.lit(500.0)).alias("midterm"),
        F.when(_mod(k, 7) == 0, F.lit(None).cast("double")).otherwise(F.lit(9.5)).alias("exam"))


def edits_in_order(spark, sf_dir) -> DataFrame:
    """Every order as an edit of its customer: the id is kept, moved to another customer's, or made an ``E`` id and later edited so."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    j = o.join(_customers(spark, sf_dir), o["o_custkey"] == F.col("c_custkey"))
    k = "o_orderkey"
    renamed = F.concat(F.lit("E"), _s("o_custkey"))
    return j.select(
        F.col(k).cast("long").alias("row_no"), "account",
        F.when(_mod(k, 5) == 0, renamed).otherwise(_s("o_custkey")).alias("original_id"),
        F.when(_mod(k, 4) == 0, renamed).when(_mod(k, 4) == 1, (F.col("o_custkey") + F.lit(25)).cast("string"))
         .otherwise(_s("o_custkey")).alias("student_id"),
        F.concat(F.lit("Edit "), _s(k)).alias("full_name"), F.lit("1999-09-09").alias("birth_date"),
        F.lit("Nam").alias("gender"), F.col("n_name").alias("class_name"),
        (F.col("o_totalprice") / F.lit(60000.0)).alias("midterm"),
        F.when(_mod(k, 7) == 0, F.lit(None).cast("double")).otherwise(_mod(k, 10).cast("double")).alias("exam"))


def birth_texts(spark, sf_dir) -> DataFrame:
    """Students whose birth dates are ISO dates, day/month/year, day numbers, blank, and texts that are no date."""
    k = F.col("ord")
    day = F.date_add(F.lit("1899-12-30").cast("date"), (k % 40000).cast("int"))
    text = (F.when(k % 8 == 0, day.cast("string"))
             .when(k % 8 == 1, F.date_format(day, "d/M/yyyy"))
             .when(k % 8 == 2, (k % 40000).cast("string"))
             .when(k % 8 == 3, F.concat((k % 40000).cast("string"), F.lit(".5 ")))
             .when(k % 8 == 4, F.concat(day.cast("string"), F.lit("T10:00:00")))
             .when(k % 8 == 5, F.lit("30/2/2004")).when(k % 8 == 6, F.lit("")))
    return students(spark, sf_dir).withColumn("birth_date", text)


def grade_entries(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = _nations(spark, sf_dir)
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, F.col("c_nationkey") == n["n_nationkey"])
    k = "o_orderkey"
    return j.select(
        F.col(k).cast("long").alias("row_no"), _sheet_account(k).alias("account"),
        F.when(F.col("o_orderstatus") == F.lit("P"), F.lit(EMPTY_CLASS)).otherwise(F.col("n_name"))
         .alias("class_name"),
        F.when(_mod(k, 10) == 0, F.lit("")).otherwise(_s("o_custkey")).alias("student_id"),
        (F.col("o_totalprice") / F.lit(60000.0)).alias("midterm"),
        _mod(k, 10).cast("double").alias("exam"))


def account_candidates(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    three = F.col("p_partkey") * F.lit(3)
    digit = p.select(three.alias("row_no"), _s("p_partkey").alias("account"), "p_size")
    space = p.select((three + 1).alias("row_no"), F.col("p_name").alias("account"), "p_size")
    brand = p.select((three + 2).alias("row_no"), F.col("p_brand").alias("account"), "p_size")
    taken = r.select((-F.col("r_regionkey") - 1).cast("long").alias("row_no"),
                     _account_of_region().alias("account"), F.lit(10).alias("p_size"))
    out = digit.unionByName(space).unionByName(brand).unionByName(taken)
    return out.select(F.col("row_no").cast("long").alias("row_no"), "account",
                      F.col("p_size").cast("int").alias("secret_length"))


def class_delete_keys(spark, sf_dir) -> DataFrame:
    """Every class of region 2."""
    n = table(spark, sf_dir, "nation").where(F.col("n_regionkey") == F.lit(2)).select("n_nationkey")
    return _nations(spark, sf_dir).join(n, "n_nationkey", "left_semi").select(
        "account", F.col("n_name").alias("class_name"))


def student_delete_keys(spark, sf_dir) -> DataFrame:
    """Every MACHINERY customer."""
    c = _customers(spark, sf_dir).where(F.col("c_mktsegment") == F.lit("MACHINERY"))
    return c.select("account", _s("c_custkey").alias("student_id"))


def account_delete_keys(spark, sf_dir) -> DataFrame:
    """Every region whose name starts with A (region 0 is ``admin`` and stays)."""
    r = table(spark, sf_dir, "region").where(F.col("r_name").startswith("A"))
    return r.select(_account_of_region().alias("account"))
