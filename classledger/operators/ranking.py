"""Positions within groups that hold up when one group is huge.

``row_number().over(Window.partitionBy(g).orderBy(o))`` puts every row of a
group in one task; a class holding a third of all students would then be one
task. So groups are first sized (a partial aggregation): a group holding more
than 1/n of all rows is *hot* (there are fewer than n such groups, n being
the shuffle width, a proven bound for broadcasting their keys). Ordinary
groups are numbered by a plain window, each bounded by total/n rows. Rows of
hot groups are range-partitioned on the full key ``(g, o)`` instead, so a hot
group is cut into contiguous slices over many tasks; each slice is numbered
locally, a small table of slice sizes gives the offset of every slice within
its group, and a join adds the offset back.

The sliced rows are written once, as a Parquet table under
``spark.checkpoint.dir``, and both the slice-size table and the final join
read that table. Computing the range partitioning twice would not be safe:
its bounds come from a seeded sample, and two samples may cut differently.
Writing the table also cuts the lineage, so a lost executor never forces the
sort to be redone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .joins import fits_rows


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _width(df: DataFrame, num_partitions: int | None) -> int:
    return num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


# A group below this many rows is numbered in one task whatever its share.
MIN_HOT_ROWS = 1_000_000


def hot_groups(df: DataFrame, group_cols: list[str], num_partitions: int | None = None,
               min_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """Groups holding more than max(1/n of the rows, ``min_rows``) rows, written once.

    There are fewer than n of them, whatever the data.
    """
    n = _width(df, num_partitions)
    sizes = df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.select(F.sum("_n")).scalar()
    hot = (F.col("_n") * F.lit(n) > total) & (F.col("_n") > F.lit(min_rows))
    return materialise(sizes.where(hot).select(*group_cols), "hot-groups")


def _window_positions(df: DataFrame, group_cols, order_cols, out: str) -> DataFrame:
    w = Window.partitionBy(*group_cols).orderBy(*[_as_col(c) for c in order_cols])
    return df.withColumn(out, F.row_number().over(w).cast("long"))


def _sliced_positions(df: DataFrame, group_cols, order_cols, out: str, n: int) -> DataFrame:
    keys = [_as_col(c) for c in group_cols] + [_as_col(c) for c in order_cols]
    sliced = materialise(
        df.repartitionByRange(n, *keys)
          .sortWithinPartitions(*keys)
          .withColumn("_slice", F.spark_partition_id())
          .withColumn("_seq", F.monotonically_increasing_id()),
        "slices")
    # One row per (slice, group): its first sequence number and its size. At
    # most #groups + #slices rows; only hot groups (fewer than n) or the one
    # global group come here, so under 2n rows: a proven broadcast bound. It
    # is read from the written slices, so it is the same however often it is
    # computed.
    runs = (sliced.groupBy("_slice", *group_cols)
                  .agg(F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_n")))
    before = Window.partitionBy(*group_cols).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1)
    runs = runs.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    runs = F.broadcast(runs.select("_slice", *[F.col(g).alias(f"_g_{i}") for i, g in enumerate(group_cols)],
                                   "_first", "_offset"))
    cond = sliced["_slice"] == runs["_slice"]
    for i, g in enumerate(group_cols):
        cond = cond & sliced[g].eqNullSafe(runs[f"_g_{i}"])
    joined = sliced.join(runs, cond, "inner")
    pos = (F.col("_seq") - F.col("_first") + F.col("_offset") + F.lit(1)).cast("long")
    return joined.select(*[sliced[c] for c in df.columns], pos.alias(out))


def positions_within(df: DataFrame, group_cols: list[str], order_cols: list,
                     out: str = "pos", num_partitions: int | None = None,
                     min_hot_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """Add ``out``: 1-based position of each row within ``group_cols`` by ``order_cols``.

    ``order_cols`` must be a total order inside each group (end it with a
    unique column such as ``ord``); groups may contain NULLs. With no group
    columns the position is global: one group, sliced once it holds more
    than ``min_hot_rows`` rows. Runs the group-size job eagerly, and the
    slicing jobs only when a group is hot; the returned DataFrame is lazy.
    """
    n = _width(df, num_partitions)
    if not group_cols:
        if fits_rows(df, min_hot_rows):
            return _window_positions(df, [], order_cols, out)
        return _sliced_positions(df, [], order_cols, out, n)
    hot = hot_groups(df, group_cols, n, min_hot_rows)
    if hot.isEmpty():
        return _window_positions(df, group_cols, order_cols, out)
    # Fewer than n hot groups: a proven bound, broadcast without a check.
    hot = F.broadcast(hot.select(*[F.col(g).alias(f"_h_{i}") for i, g in enumerate(group_cols)]))
    cond = None
    for i, g in enumerate(group_cols):
        part = df[g].eqNullSafe(hot[f"_h_{i}"])
        cond = part if cond is None else cond & part
    cold = _window_positions(df.join(hot, cond, "left_anti"), group_cols, order_cols, out)
    warm = _sliced_positions(df.join(hot, cond, "left_semi"), group_cols, order_cols, out, n)
    return cold.unionByName(warm)


def first_by_row(df: DataFrame, key_cols: list[str], order_col: str, value_cols: list[str],
                 last: bool = False) -> DataFrame:
    """One row per key: the values of the row with the smallest (or largest) ``order_col``.

    A partial + final aggregation: a key that holds many rows is reduced on
    the map side before anything is shuffled.
    """
    pick = F.max_by if last else F.min_by
    packed = F.struct(*[F.col(c) for c in value_cols])
    agg = (df.groupBy(*key_cols)
             .agg(pick(packed, F.col(order_col)).alias("_v"),
                  (F.max if last else F.min)(order_col).alias(order_col)))
    return agg.select(*key_cols, order_col, *[F.col("_v")[c].alias(c) for c in value_cols])
