"""Operator 3: repeated passages by hashes of windows, grouped by minimizer.

This replaces suffix trees partitioned by prefixes: no suffix is compared, and
"tree", "leaf" and "suffix" below stand for groups, places and starts of equal
window hashes. Maximal repeats are not emitted.

A window is ``size`` consecutive words of one text; each word of a window that
also starts earlier in the corpus is removed. Only suffixes that can share
that much with another one are sorted into trees:

1. Every window has a seed, the least of its ``seed``-word runs by hash (the
   leftmost of equals), so equal windows have equal seeds at equal offsets.
   Seeds that the corpus has once are dropped, and their suffixes with them.
2. The suffixes left are split by prefixes of variable length: a group is one
   seed, or, where a seed occurs more than ``heavy`` times, one whole window.
3. In a group the suffixes form a tree cut at ``size`` words. Its nodes at that
   depth with two leaves or more are the repeats; all leaves but the earliest
   are marked. Groups of seeds fit in memory, and a task streams through them
   in sorted order; groups of whole windows may have any number of leaves and
   are reduced by partial aggregation instead.

Marked windows that touch join to the maximal repeats that are cut out. Copies
of a whole text are set apart before: all words of the later ones are removed
if there is a window in them at all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import map_arrow
from .words import Words, inside, pieces, split_words, windows

SIZE = 20
SEED = 8
HEAVY = 50_000
NO_ID = -(1 << 63)
REMOVED = "doc_id long, n_words long, n_removed long, kept_sha256 string, text string"


def seed_places(words: Words, size: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the seed run at each word, starts of the windows, place of each window's seed)."""
    runs, _ = windows(words, seed)
    starts = np.flatnonzero(inside(words, size))
    span = size - seed + 1
    least = runs.copy()
    have = 1
    while have * 2 <= span:
        least[:-have] = np.minimum(least[:-have], least[have:])
        have *= 2
    low = np.minimum(least[starts], least[starts + span - have])
    place = np.full(len(starts), -1, np.int64)
    for j in range(span - 1, -1, -1):
        hit = runs[starts + j] == low
        place[hit] = starts[hit] + j
    return runs, starts, place


def _run_bounds(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of windows with one seed place; places only grow."""
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else place
    return first, np.append(first[1:], len(place)) - 1 if len(place) else place


def seeds(texts: DataFrame, size: int, seed: int) -> DataFrame:
    """(seed, k, at) of each text: its windows' seeds and the words they start at; once for each text and task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys = batch.column(0).to_numpy()
            new = np.zeros(len(keys), bool)
            for i, key in enumerate(keys.tolist()):
                if key not in seen:
                    seen.add(key)
                    new[i] = True
            keys, column = keys[new], batch.column(1).filter(pa.array(new))
            for at, _, data, offsets in pieces(column):
                words = split_words(data, offsets)
                runs, _, place = seed_places(words, size, seed)
                place = place[_run_bounds(place)[0]]
                owner = np.searchsorted(words.first, place, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(runs[place].view(np.int64)), pa.array(keys[at + owner]),
                     pa.array((place - words.first[owner]).astype(np.int32))], ["seed", "k", "at"])

    return map_arrow(texts.select("k", "text"), rows, "seed long, k long, at int")


def suffix_runs(texts: DataFrame, size: int, seed: int) -> DataFrame:
    """(seed, heavy, d, k, start, windows): for each repeated seed of a text the hashes of its windows, in order."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ds, ks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at, to, data, offsets in pieces(batch.column(2)):
                words = split_words(data, offsets)
                runs, starts, place = seed_places(words, size, seed)
                whole, _ = windows(words, size)
                first, last = _run_bounds(place)
                lists = batch.column(3).slice(at, to - at)
                wanted = lists.flatten().to_numpy()
                owner = np.repeat(np.arange(to - at), pc.list_value_length(lists).to_numpy())
                spot = words.first[owner] + (wanted >> 1)
                run = np.searchsorted(place[first], spot)
                lo, hi = first[run], last[run]
                count = hi - lo + 1
                ends = np.append(0, np.cumsum(count))
                flat = np.repeat(lo - ends[:-1], count) + np.arange(ends[-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(runs[spot].view(np.int64)), pa.array((wanted & 1).astype(bool)), pa.array(ds[at + owner]),
                     pa.array(ks[at + owner]), pa.array((starts[lo] - words.first[owner]).astype(np.int32)),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(whole[starts[flat]].view(np.int64)))],
                    ["seed", "heavy", "d", "k", "start", "windows"])

    return map_arrow(texts, rows, "seed long, heavy boolean, d long, k long, start int, windows array<long>")


def later_leaves(d: np.ndarray, k: np.ndarray, start: np.ndarray, group: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Which suffixes are not the earliest of their deep node: 128 bits, the group's prefix and the whole window."""
    order = np.lexsort((start, k, d, node, group))
    same = np.zeros(len(order), bool)
    a, b = order[1:], order[:-1]
    same[1:] = (node[a] == node[b]) & (group[a] == group[b])
    late = np.zeros(len(order), bool)
    late[order] = same
    earlier_place = np.zeros(len(order), bool)  # a repeated row is the same place, not a later one
    earlier_place[1:] = (d[a] == d[b]) & (k[a] == k[b]) & (start[a] == start[b])
    if earlier_place.any():
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        first = order[head]
        at_first = (d[order] == d[first]) & (k[order] == k[first]) & (start[order] == start[first])
        late[order[at_first]] = False
    return late


def light_marks(runs: DataFrame) -> DataFrame:
    """(d, k, mark) from groups of one seed; mark: start of the run << 16 | its marked windows as bits."""

    def marks(table: pa.Table) -> pa.RecordBatch:
        d, k, start, group = (table.column(c).to_numpy() for c in ("d", "k", "start", "seed"))
        lists = table.column("windows").combine_chunks()
        count = pc.list_value_length(lists).to_numpy()
        owner = np.repeat(np.arange(len(d)), count)
        bit = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        late = later_leaves(d[owner], k[owner], start[owner] + bit, group[owner], lists.flatten().to_numpy())
        bits = np.bincount(owner[late], (1 << bit[late]).astype(float), len(d)).astype(np.int64)
        hit = bits > 0
        return pa.RecordBatch.from_arrays(
            [pa.array(d[hit]), pa.array(k[hit]), pa.array(start[hit].astype(np.int64) << 16 | bits[hit])], ["d", "k", "mark"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            held += batch.num_rows
            if held < 40_000:
                continue
            table = pa.Table.from_batches(waiting)
            group = table.column("seed").to_numpy()
            whole = int(np.searchsorted(group, group[-1]))  # the last group may go on
            if whole:
                yield marks(table.slice(0, whole))
            waiting = table.slice(whole).combine_chunks().to_batches()
            held = table.num_rows - whole
        if waiting:
            yield marks(pa.Table.from_batches(waiting))

    grouped = runs.where("not heavy").select("seed", "d", "k", "start", "windows") \
        .repartition("seed").sortWithinPartitions("seed")
    return map_arrow(grouped, rows, "d long, k long, mark long")


def heavy_marks(runs: DataFrame) -> DataFrame:
    """The same from groups of one whole window, reduced to their first leaf by partial aggregation."""
    leaves = runs.where("heavy").select("seed", "d", "k", "start", F.posexplode("windows").alias("i", "node")) \
        .select("seed", "node", "d", "k", (F.col("start") + F.col("i")).cast("long").alias("start"))
    place = F.struct("d", "k", "start")
    first = leaves.groupBy("seed", "node").agg(F.min(place).alias("first"))
    return leaves.join(first, ["seed", "node"]).where(place != F.col("first")) \
        .select("d", "k", F.shiftleft("start", 16).bitwiseOR(F.lit(1).cast("long")).alias("mark"))


def covered_words(marks: np.ndarray, n_words: int, size: int) -> np.ndarray:
    """Which words the marked windows cover."""
    start, bits = marks >> 16, marks & 0xFFFF
    edge = np.zeros(n_words + 1, np.int64)
    for b in range(16):
        on = start[(bits >> b & 1) == 1] + b
        np.add.at(edge, on, 1)
        np.add.at(edge, np.minimum(on + size, n_words), -1)
    return np.cumsum(edge[:-1]) > 0


def cut_repeats(joined: DataFrame, size: int) -> DataFrame:
    """``REMOVED`` and extra, of rows (d, k, text, extra, marks, is_first)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            firsts = batch.column(5).to_pylist()
            for at, to, data, offsets in pieces(batch.column(2)):
                words = split_words(data, offsets)
                raw = data.tobytes()
                for i in range(to - at):
                    a, b = words.first[i], words.first[i + 1]
                    text, n = raw[offsets[i]:offsets[i + 1]], int(b - a)
                    marks = batch.column(4)[at + i]
                    if not firsts[at + i]:
                        gone = np.full(n, n >= size)
                    elif marks.is_valid and len(marks):
                        gone = covered_words(marks.values.to_numpy(), n, size)
                    else:
                        gone = np.zeros(0, bool)
                    if not gone.any():
                        out.append((n, 0, hashlib.sha256(b" ".join(text.split())).hexdigest(), text.decode()))
                        continue
                    start, end = words.start[a:b], words.end[a:b]
                    keep = np.flatnonzero(~gone)
                    kept = b" ".join([raw[x:y] for x, y in zip(start[keep].tolist(), end[keep].tolist())])
                    # Whole spans between cuts keep their own white space.
                    begin = keep[np.append(True, np.diff(keep) > 1)] if len(keep) else keep
                    stop = keep[np.append(np.diff(keep) > 1, True)] if len(keep) else keep
                    spans = [raw[x:y] for x, y in zip(start[begin].tolist(), end[stop].tolist())]
                    out.append((n, int(gone.sum()), hashlib.sha256(kept).hexdigest(), b"\n".join(spans).decode()))
            columns = list(zip(*out)) or [(), (), (), ()]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pc.if_else(pc.equal(batch.column(0), NO_ID), None, batch.column(0)),
                 *[pa.array(c, t) for c, t in zip(columns, kinds)], batch.column(3)],
                [c.split()[0] for c in REMOVED.split(", ")] + ["extra"])

    return map_arrow(joined, rows, f"{REMOVED}, extra {joined.schema['extra'].dataType.simpleString()}")


def remove_repeats(docs: DataFrame, size: int = SIZE, seed: int = SEED, heavy: int = HEAVY,
                   id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, text) of each row; text: what is left, cut spans joined by \\n.

    A null text has no words, is never changed and comes back empty. Of rows
    with one doc_id and different texts, that with the smaller text hash counts
    as earlier; rows equal in both are one place and lose the same words. A
    null doc_id counts as smaller than any other. Texts shorter than ``size``
    words lose nothing. A very long text is worked on whole: its windows are
    rows like any others, and one task cuts it. An empty table gives no rows;
    other columns are not read.
    """
    return _without_repeats(docs, F.lit(0), size, seed, heavy, id_column, text_column).drop("extra")


def cut_documents(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """The documents with repeated passages cut out of text; n_chars follows, other columns are as they are."""
    cut = _without_repeats(docs, F.struct("*"), size, SEED, HEAVY, "doc_id", "text")
    changed = {"text": F.when(F.col("extra.text").isNotNull(), F.col("text")), "n_chars": F.char_length("text").cast("long")}
    return cut.select(*[changed[c].alias(c) if c == "text" or c == "n_chars" else F.col(f"extra.`{c}`").alias(c)
                        for c in docs.columns])


def _without_repeats(docs: DataFrame, extra: Column, size: int, seed: int, heavy: int, id_column: str,
                     text_column: str) -> DataFrame:
    texts = docs.select(F.coalesce(docs[id_column].cast("long"), F.lit(NO_ID)).alias("d"),
                        F.xxhash64(F.coalesce(docs[text_column].cast("string"), F.lit(""))).alias("k"),
                        docs[text_column].cast("string").alias("text"), extra.alias("extra"))
    found = seeds(texts, size, seed)
    place = F.xxhash64("k", "at")
    repeated = (found.groupBy("seed").agg(F.min(place).alias("x"), F.max(place).alias("y"), F.count(F.lit(1)).alias("n"))
                .where("x <> y").select("seed", (F.col("n") > heavy).cast("int").alias("heavy")))
    spots = (found.join(repeated, "seed").groupBy("k")
             .agg(F.sort_array(F.collect_set(F.col("at") * 2 + F.col("heavy"))).alias("spots")))
    # Copies agree in hash and length; a hash alone would be too little for billions of texts.
    first = texts.groupBy("k", F.octet_length("text").alias("bytes")).agg(F.min("d").alias("d")).select("d", "k").distinct()
    repeated_texts = texts.join(first.join(spots, "k"), ["d", "k"]).select("d", "k", "text", "spots", "extra")
    runs = suffix_runs(repeated_texts, size, seed)
    marks = light_marks(runs).union(heavy_marks(runs)).groupBy("d", "k").agg(F.collect_list("mark").alias("marks"))
    firsts = first.join(marks, ["d", "k"], "left").withColumn("is_first", F.lit(True))
    return cut_repeats(texts.join(firsts, ["d", "k"], "left").select("d", "k", "text", "extra", "marks", "is_first"), size)
