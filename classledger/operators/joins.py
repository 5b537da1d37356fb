"""Join helpers: a broadcast that is only taken behind a checked size bound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Largest side ever broadcast on an explicit check: rows and bytes of cell
# payload (string/binary lengths plus 8 bytes per other cell).
BROADCAST_ROW_LIMIT = 2_000_000
BROADCAST_BYTE_LIMIT = 64 * 1024 * 1024


def _cell_bytes(c: Column, kind: T.DataType) -> Column:
    """Payload of one cell: text and binary by length, structs by their fields, arrays and maps as their text."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
    if isinstance(kind, T.StructType):
        out = F.lit(8).cast("long")
        for f in kind.fields:
            out = out + _cell_bytes(c.getField(f.name), f.dataType)
        return out
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.coalesce(F.octet_length(F.to_json(c)), F.lit(0)).cast("long") * 8
    return F.lit(8).cast("long")


def _payload_bytes(df: DataFrame) -> Column:
    parts = [_cell_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]
    out = parts[0] if parts else F.lit(0).cast("long")
    for p in parts[1:]:
        out = out + p
    return out


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROW_LIMIT,
                   max_bytes: int = BROADCAST_BYTE_LIMIT) -> bool:
    """Whether ``df`` provably holds at most ``max_rows`` rows and ``max_bytes`` of payload.

    One aggregate without a limit: every task sends one row with its count and
    bytes, so nothing but those rows meets in the last task.
    """
    r = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(_payload_bytes(df)), F.lit(0)).alias("b")).first()
    return r.n <= max_rows and r.b <= max_bytes


def fits_rows(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` provably holds at most ``max_rows`` rows (one partial count for each task)."""
    return df.count() <= max_rows


def broadcast_when(ok: bool, *dfs: DataFrame):
    """Broadcast hints on ``dfs`` when a single size check ``ok`` bounds them all."""
    out = tuple(F.broadcast(d) if ok else d for d in dfs)
    return out if len(out) > 1 else out[0]


def broadcast_if_small(df: DataFrame, bound_by: DataFrame | None = None,
                       max_rows: int = BROADCAST_ROW_LIMIT, max_bytes: int = BROADCAST_BYTE_LIMIT) -> DataFrame:
    """Hint a broadcast of ``df`` only behind a checked size bound.

    ``bound_by`` may name a cheaper DataFrame that is provably at least as
    large (e.g. the input of an aggregation). Beyond the bound ``df`` is
    returned untouched and the join stays a shuffle join (AQE may still turn
    it into a broadcast from measured shuffle sizes).
    """
    if fits_broadcast(bound_by if bound_by is not None else df, max_rows, max_bytes):
        return F.broadcast(df)
    return df
