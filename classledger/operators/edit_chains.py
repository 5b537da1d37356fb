"""Edits of one batch applied in order, as one after another would be.

An edit replaces every row whose id is its original id by its own values, the
new id included, so a later edit of the batch may meet the new id: chains such
as A to B, then B to C, repeated edits of one id, and two ids made one. Which
edit a row ends with is found by pointer doubling, not by applying edits in turn.

An edit that keeps its id changes no path: rows under an id stay there until the
id's next edit that leaves it, or end with the id's last edit. So only leaving
edits are linked, each to the next leaving edit of the id that it gives, found
by one ordered pass over the takes of an id and the rows put there (for a hot id
by numbers, which are given in slices). Each round then doubles how far the open
links point, so a chain of n leaving edits takes log2(n) joins on unique keys,
and an edit whose end is known is only looked up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .joins import broadcast_if_small
from .ranking import MIN_HOT_ROWS, _width, positions_within

LIFE = ["account", "id"]


def _next_by_pass(events: DataFrame) -> DataFrame:
    """(account, row_no, to_row, last) of each put: the next take that leaves the id, and the id's last take, both later than the put."""
    # From the last event back, so that the frame only grows; at an equal row_no a put does not see the take.
    later = Window.partitionBy(*LIFE).orderBy(F.desc("row_no"), F.desc("puts")).rowsBetween(Window.unboundedPreceding, 0)
    seen = events.select("account", "row_no", "puts", F.min(F.when(F.col("leaves"), F.col("row_no"))).over(later).alias("to_row"),
                         F.max(F.when(~F.col("puts"), F.col("row_no"))).over(later).alias("last"))
    return seen.where("puts").drop("puts")


def _next_by_number(events: DataFrame, lives: DataFrame, min_hot_rows: int) -> DataFrame:
    """As :func:`_next_by_pass`, for ids with very many events: the next take is found by its number among the id's takes.

    A put's place among leaving takes and puts, less its number among the puts, is how many leaving takes came before it.
    """
    number = lambda df, out: positions_within(df, LIFE, ["row_no", "puts", "seq"], out=out, min_hot_rows=min_hot_rows)
    both = materialise(events.where("puts OR leaves").withColumn("seq", F.monotonically_increasing_id()), "edit-hot-events")
    placed = materialise(number(both, "place"), "edit-hot-places")
    puts = number(placed.where("puts"), "nth").select(*LIFE, "row_no", (F.col("place") - F.col("nth") + 1).alias("k"))
    takes = number(placed.where(~F.col("puts")), "k").select(*LIFE, "k", F.col("row_no").alias("to_row"))
    last = F.broadcast(lives.select(*LIFE, "last_take"))  # fewer hot ids than the shuffle width
    return (puts.join(takes, [*LIFE, "k"], "left").join(last, LIFE, "left")
            .select("account", "row_no", "to_row", F.when(F.col("last_take") > F.col("row_no"), F.col("last_take")).alias("last")))


def last_edits(edits: DataFrame, min_hot_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """(account, original_id, row_no): the edit that rows of this id end with, for every id that some edit takes.

    ``edits`` has account, original_id, student_id and row_no, which is unique
    within an account. Rows of ids without an edit are not listed.
    """
    usable = (edits.where(F.col("account").isNotNull() & F.col("original_id").isNotNull() & F.col("row_no").isNotNull())
              .withColumn("leaves", ~F.col("original_id").eqNullSafe(F.col("student_id"))))
    takes = usable.select("account", F.col("original_id").alias("id"), "row_no", F.lit(False).alias("puts"), "leaves")
    puts = usable.where("leaves").select("account", F.col("student_id").alias("id"), "row_no", F.lit(True).alias("puts"),
                                         F.lit(False).alias("leaves"))
    events = takes.unionByName(puts.where(F.col("id").isNotNull()))
    lives = materialise(events.groupBy(*LIFE).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("leaves"), F.col("row_no"))).alias("first_leave"),
        F.max(F.when(~F.col("puts"), F.col("row_no"))).alias("last_take")), "edit-lives")
    width = _width(events, None)
    total = lives.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = lives.where((F.col("n") * F.lit(width) > total) & (F.col("n") > min_hot_rows))
    if hot.isEmpty():
        found = _next_by_pass(events)
    else:
        keys = F.broadcast(hot.select(*LIFE))  # fewer than the shuffle width
        found = _next_by_pass(events.join(keys, LIFE, "left_anti")).unionByName(
            _next_by_number(events.join(keys, LIFE, "left_semi"), hot, min_hot_rows))
    # Edits to a NULL id have no put: their rows end with them. A row_no that comes again is one edit.
    nowhere = usable.where(F.col("student_id").isNull()).select("account", "row_no", F.lit(None).cast("long").alias("to_row"),
                                                                F.lit(None).cast("long").alias("last"))
    links = found.unionByName(nowhere).groupBy("account", "row_no").agg(F.min("to_row").alias("to_row"), F.max("last").alias("last"))
    links = links.withColumn("last", F.coalesce("last", "row_no"))
    state = materialise(links, "edit-chains")
    ended, open_ = state.where(F.col("to_row").isNull()), state.where(F.col("to_row").isNotNull())
    while not open_.isEmpty():
        ahead = ended.unionByName(open_).select("account", F.col("row_no").alias("to_row"), F.col("to_row").alias("far_row"),
                                                F.col("last").alias("far_last"))
        state = materialise(open_.drop("last").join(ahead, ["account", "to_row"]).select(
            "account", "row_no", F.col("far_row").alias("to_row"), F.col("far_last").alias("last")), "edit-chains")
        ended = ended.unionByName(state.where(F.col("to_row").isNull()))
        open_ = state.where(F.col("to_row").isNotNull())
    starts = lives.where(F.col("last_take").isNotNull())
    ends = ended.select("account", F.col("row_no").alias("first_leave"), "last")
    return starts.join(ends, ["account", "first_leave"], "left").select(
        "account", F.col("id").alias("original_id"), F.coalesce("last", "last_take").alias("row_no"))


def edit_students_in_order(students: DataFrame, edits: DataFrame, min_hot_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """Students after all ``edits`` (account, row_no, original_id and a student's fields), applied by ``row_no``.

    Equal to applying them one at a time: every row with the edit's original id
    takes the edit's values (NULLs too), stored order is kept, the final grade
    is computed anew. A NULL original id matches nothing; an edit to a NULL id
    ends its chain. No batch is refused.
    """
    from .changes import EDIT_FIELDS, replace_students

    if "row_no" not in edits.columns:
        raise ValueError("edits in order need a row_no column")
    batch = materialise(edits.select("account", "row_no", "original_id", *EDIT_FIELDS), "edit-batch")
    ends = last_edits(batch, min_hot_rows).withColumnRenamed("original_id", "_orig")
    values = batch.select("account", "row_no", *[F.col(c).alias(f"_e_{c}") for c in EDIT_FIELDS])
    side = materialise(ends.join(values, ["account", "row_no"]).drop("row_no").withColumn("_hit", F.lit(True)), "edits")
    return replace_students(students, broadcast_if_small(side))
