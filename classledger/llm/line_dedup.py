"""Operator 12: lines that several documents repeat, found by a pair of Bloom filters.

A line's key is the line without white space at both ends, A-Z lowered; keys of
fewer than ``min_chars`` code points are never dropped. The steps:

1. ``line_keys``: the distinct long keys of each text as 128-bit digests, written
   once (16 bytes a line); no later step before the last reads a text.
2. ``twice_seen``: a once-seen and a twice-seen Bloom filter over all keys of
   all rows. A filter is cut into segments of ``SEGMENT`` bits; a task sends, for
   each segment, the places it has set as 2-byte numbers, marked once or twice,
   so a line in a third of all rows costs a task a few bytes. Where segments
   meet, a place that two tasks have set, or one task twice, is twice-seen.
3. ``suspects``: the keys whose places are all twice-seen. Only these shuffle.
   The filter, ``BITS_PER_KEY`` bits for each key, is broadcast when its checked
   size allows it, else joined by segment.
4. ``confirmed``: the suspects that at least ``min_documents`` documents hold,
   counted exactly, with the largest document that holds each.
5. The drop list of each row meets the row's text again, and the lines go.

Two different keys of one corpus share a digest with odds of 2**-128 a pair. The
filter only chooses what is counted: its size changes no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import broadcast_if_small
from .tables import map_arrow, materialise, ship_package
from .words import pieces

MIN_CHARS = 20
MIN_DOCUMENTS = 3
SEGMENT = 1 << 16
BITS_PER_KEY = 10
SPACES = b" \t\n\x0b\x0c\r"
KEYS = "_row long, doc_id long, keys array<struct<a: long, b: long>>"
_KEY_TYPE = pa.struct([("a", pa.int64()), ("b", pa.int64())])


def _long_keys(text: bytes, min_chars: int) -> list[bytes]:
    """Digest of each line's key, empty for a key that is too short."""
    out = []
    for line in text.lower().split(b"\n"):  # lowers A-Z only, as these are bytes
        key = line.strip(SPACES)
        short = len(key) < min_chars or (not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars)
        out.append(b"" if short else hashlib.blake2b(key, digest_size=16).digest())
    return out


def _structs(digests: list[bytes]) -> pa.Array:
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return pa.StructArray.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], fields=list(_KEY_TYPE))


def line_keys(rows: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``KEYS`` of each row (_row, doc_id, text) that has a long key."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in pieces(batch.column(2)):
                raw = data.tobytes()
                found, keep, ends = [], [], [0]
                for row, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
                    keys = set(_long_keys(raw[a:b], min_chars)) - {b""}
                    if keys:
                        found += sorted(keys)
                        keep.append(at + row)
                        ends.append(len(found))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _structs(found))
                index = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(1).take(index), lists],
                                                 ["_row", "doc_id", "keys"])

    return map_arrow(rows, keyed, KEYS)


def _segment(a: Column, segments: int) -> Column:
    return F.pmod(F.shiftrightunsigned(a, 32), F.lit(segments))


def _places(a: Column) -> tuple[Column, Column]:
    return a.bitwiseAND(0xFFFF).cast("int"), F.shiftrightunsigned(a, 16).bitwiseAND(0xFFFF).cast("int")


def twice_seen(keys: DataFrame, segments: int) -> DataFrame:
    """(segment, bits): the twice-seen filter's segments that have a place set."""

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = batch.column(0).flatten().field(0).to_numpy(zero_copy_only=False).view(np.uint64)
            segment = (a >> np.uint64(32)) % np.uint64(segments)
            places = np.concatenate([segment * np.uint64(SEGMENT) + (a & np.uint64(0xFFFF)),
                                     segment * np.uint64(SEGMENT) + ((a >> np.uint64(16)) & np.uint64(0xFFFF))])
            place, times = np.unique(places, return_counts=True)
            for mark in (1, 2):  # the once-seen places, then the twice-seen ones
                chosen = place[(times > 1) == (mark == 2)]
                owner = (chosen // np.uint64(SEGMENT)).astype(np.int64)
                starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
                low = (chosen % np.uint64(SEGMENT)).astype("<u2").tobytes()
                ends = np.append(starts[1:], len(owner))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(owner[starts]), pa.array(np.full(len(starts), mark, np.int32)),
                     pa.array([low[2 * s:2 * e] for s, e in zip(starts, ends)], pa.binary())], ["segment", "mark", "places"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(SEGMENT, bool), np.zeros(SEGMENT, bool)
        for batch in batches:
            for mark, low in zip(batch["mark"].to_pylist(), batch["places"].to_pylist()):
                at = np.frombuffer(low, "<u2")
                twice[at] |= once[at] | (mark == 2)
                once[at] = True
            segment = batch["segment"][:1]
        yield pa.RecordBatch.from_arrays([segment, pa.array([np.packbits(twice, bitorder="little").tobytes()])], ["segment", "bits"])

    sent = map_arrow(keys.select("keys"), filled, "segment long, mark int, places binary")
    ship_package(keys.sparkSession)
    return sent.groupBy("segment").applyInArrow(met, "segment long, bits binary")


def suspects(keys: DataFrame, segments: int) -> DataFrame:
    """(_row, doc_id, a, b) of every key whose places are all set in the twice-seen filter."""
    seen = broadcast_if_small(materialise(twice_seen(keys, segments), "twice-seen"))
    flat = (keys.select("_row", "doc_id", F.explode("keys").alias("k"))
                .select("_row", "doc_id", F.col("k.a").alias("a"), F.col("k.b").alias("b"))
                .withColumn("segment", _segment(F.col("a"), segments)))

    def is_set(place: Column) -> Column:
        byte = F.substring("bits", F.shiftright(place, 3) + 1, F.lit(1))
        value = F.conv(F.hex(byte), 16, 10).cast("int")
        return F.call_function("shiftright", value, place.bitwiseAND(7)).bitwiseAND(1) == 1

    first, second = _places(F.col("a"))
    return flat.join(seen, "segment").where(is_set(first) & is_set(second)).select("_row", "doc_id", "a", "b")


def confirmed(found: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(a, b, keeper) of the keys that ``min_documents`` documents hold; keeper is the largest of these."""
    return (found.select("a", "b", "doc_id").distinct()
            .groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"))
            .where(F.col("n") >= min_documents).select("a", "b", "keeper"))


def drop_lists(rows: DataFrame, min_chars: int, min_documents: int) -> DataFrame:
    """(_row, gone): the keys that each row's document loses."""
    keys = materialise(line_keys(rows, min_chars), "line-keys")
    count = keys.select(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    segments = max(1, -(-int(count * BITS_PER_KEY) // SEGMENT))
    found = materialise(suspects(keys, segments), "line-suspects")
    keepers = broadcast_if_small(materialise(confirmed(found, min_documents), "line-keepers"))
    lost = found.join(keepers, ["a", "b"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    # A row's keys are distinct, so its list is no longer than its text; equal rows share one list.
    return lost.groupBy("_row").agg(F.collect_set(F.struct("a", "b")).alias("gone"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS,
                id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) of each row, its text without the repeated lines.

    A key that at least ``min_documents`` documents hold is dropped with all its
    lines from all of them except the one with the largest id, which keeps every
    line of it; lines that stay are joined by a line feed. A document is an id:
    rows that share an id count once, and each is treated alike. A null id is one
    document, smaller than any other. A null or empty text is one empty line;
    its text comes back empty. A very long text is worked on whole by one task,
    a line at a time. An empty table gives an empty result; further columns,
    whatever their names, are not read.

    No group is gathered: keys meet as counts (partial aggregation), drop lists
    are as long as one text at most, and a line of a third of all rows is a hot
    key of joins only, which a checked broadcast or the adaptive skew split takes.
    """
    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    rows = rows.withColumn("_row", F.xxhash64("doc_id", "text")).select("_row", "doc_id", "text")
    # The lists grow with the texts, so they meet them by a merge join at every size.
    gone = materialise(drop_lists(rows, min_chars, min_documents), "line-drops").hint("merge")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            for at, to, data, offsets in pieces(batch.column(1)):
                raw = data.tobytes()
                lines, dropped, texts = [], [], []
                for row, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
                    text = raw[a:b]
                    n, lost = text.count(b"\n") + 1, 0
                    if lists[at + row].is_valid:
                        keys = lists[at + row].values
                        pairs = np.stack([keys.field(0).to_numpy(), keys.field(1).to_numpy()], axis=1)
                        bad = {p.tobytes() for p in pairs}
                        kept = [line for line, key in zip(text.split(b"\n"), _long_keys(text, min_chars)) if key not in bad]
                        lost, text = n - len(kept), b"\n".join(kept)
                    lines.append(n)
                    dropped.append(lost)
                    texts.append(text)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()),
                     pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_lines", "n_dropped", "text"])

    met = rows.join(gone, "_row", "left").select("doc_id", "text", "gone")
    return map_arrow(met, cut, "doc_id long, n_lines long, n_dropped long, text string")
