"""Operator 5: token counts by rank-synchronous merging of ragged arrays.

The model's tokens never span a space that follows another character (checked
when the vocabulary is read), so a text falls into pre-tokens: a run of spaces
with the characters that follow it. Each distinct pre-token is counted once
and kept; new ones are merged together as ragged numpy arrays: one flat array
of symbols, one of sequence starts. Every round finds the lowest-rank pair of
each sequence and merges it in all sequences at once; sequences without a pair
leave. A symbol outside the vocabulary counts as many tokens as it has bytes.

A round looks at the whole of a sequence, so a pre-token of more than ``LONG``
characters (text without spaces) is cut first where two neighbouring characters
stand together in no piece, which no merge can cross, and what is still longer
takes its merges from a heap by (rank, place), the same order, in n log n steps.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tables import map_arrow, tokenizer_path
from .words import pieces

SPACE = "▁"
LIMIT = 4096
CACHED = 500_000
LONG = 256
NO_RANK = np.iinfo(np.int64).max
_PRE_TOKEN = re.compile(rb" *[^ \n]+| +")
COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class PieceMerges:
    """Merge table of a byte-fallback piece model, as sorted numpy arrays."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = {}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i)):
                names[model.id_to_piece(i)] = model.get_score(i)
        if any(SPACE in p.lstrip(SPACE) for p in names) or any("\n" in p for p in names):
            raise ValueError("a piece spans a space or a line break; pre-tokens can't be counted apart")
        symbol = {p: k for k, p in enumerate(names)}
        for p in names:
            for c in p:
                symbol.setdefault(c, len(symbol))
        order = {s: r for r, s in enumerate(sorted(set(names.values()), reverse=True))}
        self.width = len(symbol) + 1  # the last number is every symbol outside the vocabulary
        keys, ranks, made = [], [], []
        for p, score in names.items():
            for cut in range(1, len(p)):
                if p[:cut] in symbol and p[cut:] in symbol:
                    keys.append(symbol[p[:cut]] * self.width + symbol[p[cut:]])
                    ranks.append(order[score])
                    made.append(symbol[p])
        by = np.argsort(np.asarray(keys, np.int64))
        self.table = dict(zip(keys, zip(ranks, made)))
        # Neighbouring characters of pieces; two that are in none of them never come into one token.
        beside = {symbol[a] * self.width + symbol[b] for p in names for a, b in zip(p, p[1:])}
        self.beside = np.append(np.asarray(sorted(beside), np.int64), NO_RANK)
        self.keys = np.append(np.asarray(keys, np.int64)[by], NO_RANK)
        self.ranks = np.append(np.asarray(ranks, np.int64)[by], NO_RANK)
        self.made = np.append(np.asarray(made, np.int64)[by], 0)
        # A merge is safe to apply to all its places at once if no pair with its result ranks lower.
        lowest = np.full(self.width, NO_RANK)
        left, right = np.divmod(self.keys[:-1], self.width)
        np.minimum.at(lowest, left, self.ranks[:-1])
        np.minimum.at(lowest, right, self.ranks[:-1])
        self.safe = lowest[self.made] > self.ranks
        self.char = np.full(0x110000, self.width - 1, np.int64)
        self.in_vocabulary = np.zeros(self.width, bool)
        for s, k in symbol.items():
            self.in_vocabulary[k] = s in names
            if len(s) == 1:
                self.char[ord(s)] = k

    def count(self, tokens: list[str]) -> np.ndarray:
        """Tokens of each pre-token, of any length."""
        total = np.zeros(len(tokens), np.int64)
        parts, owner = [], []
        for at, token in enumerate(tokens):
            if len(token) <= LONG:
                parts.append(token)
                owner.append(at)
                continue
            symbols = self.char[np.frombuffer(token.encode("utf-32-le"), np.uint32)]
            pair = symbols[:-1] * self.width + symbols[1:]
            cuts = np.flatnonzero(self.beside[np.searchsorted(self.beside, pair)] != pair) + 1
            for a, b in zip(np.append(0, cuts).tolist(), np.append(cuts, len(token)).tolist()):
                if b - a <= LONG:
                    parts.append(token[a:b])
                    owner.append(at)
                else:
                    total[at] += self._count_long(token[a:b], symbols[a:b].tolist())
        np.add.at(total, np.asarray(owner, np.int64), self._count_together(parts))
        return total

    def _count_long(self, token: str, symbols: list[int]) -> int:
        """Tokens of one sequence: the lowest rank, then the leftmost place, is merged first."""
        n, width, table = len(symbols), self.width, self.table
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            found = table.get(symbols[i] * width + symbols[i + 1])
            if found:
                heap.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
        heapq.heapify(heap)
        while heap:
            _, i, left, right, merged = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # one of the two was merged away meanwhile
            symbols[i], symbols[j] = merged, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = table.get(merged * width + symbols[k])
                if found:
                    heapq.heappush(heap, (found[0], i, merged, symbols[k], found[1]))
            h = before[i]
            if h >= 0:
                found = table.get(symbols[h] * width + merged)
                if found:
                    heapq.heappush(heap, (found[0], h, symbols[h], merged, found[1]))
        # What is left outside the vocabulary is single characters, of as many tokens as bytes.
        count, at = 0, 0
        while at < n:
            end = after[at]
            count += 1 if self.in_vocabulary[symbols[at]] else len(token[at:end].encode())
            at = end
        return count

    def _count_together(self, tokens: list[str]) -> np.ndarray:
        """Surviving symbols of each short pre-token, all merged round by round."""
        if not tokens:
            return np.zeros(0, np.int64)
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        points = np.frombuffer("".join(tokens).encode("utf-32-le"), np.uint32)
        flat = self.char[points]
        size = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        total = np.zeros(len(tokens), np.int64)
        owner = np.repeat(np.arange(len(tokens)), lengths)
        while len(flat):
            key = np.full(len(flat), -1, np.int64)
            joined = owner[1:] == owner[:-1]
            key[:-1][joined] = flat[:-1][joined] * self.width + flat[1:][joined]
            at = np.searchsorted(self.keys, key)
            rank = np.where(self.keys[at] == key, self.ranks[at], NO_RANK)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lowest = np.minimum.reduceat(rank, starts)
            spans = np.diff(np.append(starts, len(flat)))
            done = np.repeat(lowest == NO_RANK, spans)
            if done.any():  # what can't be merged further is counted and leaves
                worth = np.where(self.in_vocabulary[flat[done]], 1, size[done])
                total += np.bincount(owner[done], worth, len(tokens)).astype(np.int64)
                keep = ~done
                flat, owner, size, at, rank = flat[keep], owner[keep], size[keep], at[keep], rank[keep]
                spans, lowest = spans[lowest != NO_RANK], lowest[lowest != NO_RANK]
                starts = np.cumsum(spans) - spans
                if not len(flat):
                    break
            hit = np.flatnonzero(rank == np.repeat(lowest, spans))
            first = np.append(True, owner[hit][1:] != owner[hit][:-1])
            run = np.append(True, (hit[1:] != hit[:-1] + 1)) | first
            position = np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[first | (self.safe[at[hit]] & (position % 2 == 0))]
            flat[hit] = self.made[at[hit]]
            keep = np.ones(len(flat), bool)
            keep[hit + 1] = False
            flat, owner, size = flat[keep], owner[keep], size[keep]
        return total


class PieceCounter:
    """Counts of whole texts; distinct pre-tokens are merged once and kept."""

    def __init__(self, path: str):
        self.merges = PieceMerges(path)
        self.known: dict[bytes, int] = {}

    def __call__(self, texts: list[bytes]) -> list[int]:
        split = [_PRE_TOKEN.findall(b" " + t.replace(SPACE.encode(), b" ")) if t else [] for t in texts]
        new = set()
        for tokens in split:
            new.update(tokens)
        if len(self.known) + len(new) > CACHED:
            self.known = {t: self.known[t] for t in new if t in self.known}
        new = [t for t in new if t not in self.known]
        decoded = [t.decode().replace(" ", SPACE) for t in new]
        self.known.update(zip(new, self.merges.count(decoded).tolist()))
        return [sum(map(self.known.__getitem__, tokens)) + t.count(b"\n") for t, tokens in zip(texts, split)]


_counters: dict[str, PieceCounter] = {}


def piece_counter(path: str) -> PieceCounter:
    """One counter for each worker process."""
    if path not in _counters:
        _counters[path] = PieceCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, tokenizer: str = "piece_bpe_32k.model", limit: int = LIMIT,
                 id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """UTF-8 bytes and tokens of each document row: ``COUNTS``.

    A null text counts as empty: 0 bytes, 0 tokens. A very long text is counted
    whole by one task, also one without any space. Repeated rows are counted
    each; an empty table gives no rows; other columns are not read.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = piece_counter(tokenizer_path(tokenizer))
        for batch in batches:
            n_bytes, n_tokens = [], []
            for _, _, data, offsets in pieces(batch.column(1)):
                raw = data.tobytes()
                texts = [raw[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
                n_bytes += map(len, texts)
                n_tokens += count(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()),
                 pa.array([n > limit for n in n_tokens], pa.bool_())],
                [c.split()[0] for c in COUNTS.split(", ")])

    source = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    return map_arrow(source, counted, COUNTS)
