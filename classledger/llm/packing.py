"""Operator 8: training sequences packed by minimum bin slack.

Each task packs the rows of its own partition, so nothing is shuffled and no
group can be hot. A document's ids are cut at multiples of the window; the
remainders wait in a pool. A sequence starts with the pool's longest
remainder; a bitset subset-sum over the pool's lengths (bit s: sum s can be
reached) finds the multiset that comes closest to the rest of the window, and
walking the bitsets back gives how many of each length to take. Slack that no
multiset closes is filled with the head of a longer remainder, whose rest
stays in the pool. What a partition has left at its end, less than a window,
becomes sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .subwords import split_parts, word_ids
from .tables import map_arrow
from .words import pieces

WINDOW = 4096
END_ID = 2
POOL_WINDOWS = 512
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")


def fill(lengths: list[int], counts: list[int], room: int) -> tuple[int, list[tuple[int, int]]]:
    """The largest sum up to ``room``, and (position, how many) of the lengths that give it.

    ``reach`` has bit s set if some multiset of the lengths seen so far sums to
    s. A length with c copies is added in groups of 1, 2, 4 ... copies. The
    walk stops once ``room`` itself is reached.
    """
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for k, (length, left) in enumerate(zip(lengths, counts)):
        group = 1
        while left > 0 and length * group <= room:
            take = min(group, left)
            steps.append((k, take, reach))
            reach = (reach | reach << length * take) & mask
            left -= take
            group *= 2
        if reach >> room:
            break
    best = at = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for k, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[k] = chosen.get(k, 0) + take
            at -= lengths[k] * take
    return best, list(chosen.items())


class Packer:
    """Sequences of one partition; ``rows`` are the pieces that are placed."""

    def __init__(self, window: int, first_sequence: int):
        self.window, self.sequence = window, first_sequence
        self.pool: dict[int, list[tuple]] = {}  # length: (doc, start, ids, tokens of the document)
        self.waiting = 0
        self.rows: list[tuple] = []

    def add(self, doc, ids: bytes) -> None:
        tokens = len(ids) // 4
        whole = tokens - tokens % self.window
        for start in range(0, whole, self.window):
            self._place([(doc, start, ids[4 * start:4 * (start + self.window)], tokens)])
        if whole < tokens:
            self._keep((doc, whole, ids[4 * whole:], tokens))

    def _keep(self, piece: tuple) -> None:
        self.pool.setdefault(len(piece[2]) // 4, []).append(piece)
        self.waiting += len(piece[2]) // 4

    def _take(self, length: int) -> tuple:
        rest = self.pool[length]
        piece = rest.pop()
        if not rest:
            del self.pool[length]
        self.waiting -= length
        return piece

    def _place(self, content: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, tokens in content:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), tokens, self.sequence, offset))
            offset += n
        self.sequence += 1

    def _fill(self, content: list[tuple], room: int) -> None:
        """Take pieces that close ``room`` exactly; the caller knows that enough is waiting."""
        while room:
            lengths = sorted((n for n in self.pool if n <= room), reverse=True)
            best, chosen = fill(lengths, [len(self.pool[n]) for n in lengths], room)
            for k, times in chosen:
                content += [self._take(lengths[k]) for _ in range(times)]
            room -= best
            if room and self.pool:
                doc, start, ids, tokens = self._take(max(self.pool))
                content.append((doc, start, ids[:4 * room], tokens))
                self._keep((doc, start + room, ids[4 * room:], tokens))
                room = 0

    def pack(self, down_to: int) -> None:
        """Emit full windows while more than ``down_to`` ids wait."""
        while self.waiting > max(down_to, self.window - 1):
            longest = max(self.pool)
            content = [self._take(longest)]
            self._fill(content, self.window - longest)
            self._place(content)

    def finish(self) -> None:
        self.pack(0)
        while self.waiting:
            content: list[tuple] = []
            self._fill(content, 1 << self.waiting.bit_length() - 1)
            self._place(content)


def pack_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", window: int = WINDOW,
                   end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each placed piece of each document row: ``PIECES``.

    A null or empty text has the end id alone; rows with equal ids are packed
    independently (their pieces repeat doc_id and start); an empty table gives
    no rows; other columns are not read. Sequence ids are unique across the
    table: the partition's number times 2**33, plus a running number.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(tokenizer, end_id)
        packer = Packer(window, TaskContext.get().partitionId() << 33)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, to, data, offsets in pieces(batch.column(1)):
                flat, first, _, _ = encode(split_parts(data, offsets))
                raw, bounds = flat.astype("<u4").tobytes(), (4 * first).tolist()
                for doc, a, b in zip(ids[at:to], bounds[:-1], bounds[1:]):
                    packer.add(doc, raw[a:b])
                if packer.waiting > 2 * POOL_WINDOWS * window:
                    packer.pack(POOL_WINDOWS * window)
                yield from _rows(packer)
        packer.finish()
        yield from _rows(packer)

    source = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    return map_arrow(source, packed, PIECES)


def _rows(packer: Packer) -> Iterator[pa.RecordBatch]:
    if packer.rows:
        names = [c.split()[0] for c in PIECES.split(", ")]
        columns = [pa.array(c, pa.int64()) for c in zip(*packer.rows)]
        packer.rows = []
        yield pa.RecordBatch.from_arrays(columns, names)
