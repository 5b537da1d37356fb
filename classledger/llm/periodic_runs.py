"""Operator 13: periodic runs of words, seeded by minimizers at several scales.

A run of period q is a maximal stretch of words in which words q apart are
equal, q being its smallest period, of at least ``max(MIN_WORDS, MIN_REPEATS *
q)`` words. A batch of whole texts is one flat array of word hashes, and all
texts of it are searched together:

- Periods up to ``DIRECT`` are too short for minimizers: one scan for each lag.
- Scale k (``2 * DIRECT``, then doubling) finds the periods from k/2 + 1 to k.
  Words k long are hashed at every place; a place is a minimizer if its hash is
  the least of some ``k / 2`` neighbouring places. A run of such a period is at
  least four periods long, so it holds a whole window of places and the window
  one period later: both have the same minimizer. As k words cover a period, the
  next place of the same hash is exactly one period on. So the neighbours among
  equal minimizers that lie k/2 + 1 to k apart seed every run.
- A seed is extended both ways on the words themselves; seeds inside a stretch
  of the same lag are skipped. A stretch whose period has a smaller divisor that
  is a period too is no run of this period (a stretch of four periods that has a
  smaller period has one that divides it).

Words are compared by 64-bit hashes; two different words of one text share one
with odds of about 2**-64 a pair. Kept words are cut out of the text itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import map_arrow
from .words import Words, pieces, split_words, windows

MIN_WORDS = 6
MIN_REPEATS = 4
DIRECT = 8
RUNS = ("doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, text string")
_STEP = 64
_LAST = np.iinfo(np.uint64).max


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], equal, [False]]).view(np.int8)))
    return edge[::2], edge[1::2]


def _prime_divisors(q: int) -> list[int]:
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return out + ([q] if q > 1 else [])


def _short_runs(words: np.ndarray, text: np.ndarray) -> list[np.ndarray]:
    """Runs (start, length, period) of periods up to DIRECT, by one scan for each lag."""
    found, equal, sums = [], {}, {}
    for q in range(1, min(DIRECT, len(words) - 1) + 1):
        equal[q] = (words[q:] == words[:-q]) & (text[q:] == text[:-q])
        start, end = _stretches(equal[q])
        keep = end - start + q >= max(MIN_WORDS, MIN_REPEATS * q)
        start, end = start[keep], end[keep] + q
        for p in _prime_divisors(q):
            d = q // p
            if d not in sums:
                sums[d] = np.concatenate([[0], np.cumsum(equal[d])])
            least = sums[d][end - d] - sums[d][start] < end - d - start
            start, end = start[least], end[least]
        found.append(np.stack([start, end - start, np.full(len(start), q)], axis=1))
    return found


def _slide(values: np.ndarray, size: int, choose) -> np.ndarray:
    """``choose`` over each ``size`` neighbouring values from a place on; size is a power of two."""
    span = 1
    while span < size:
        values = choose(values[:len(values) - span], values[span:]) if len(values) > span else values[:0]
        span *= 2
    return values


def minimizers(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places that hold the least hash of some window of neighbouring places; all of equal ones."""
    least = _slide(hashes, window, np.minimum)
    if not len(least):
        return np.zeros(0, np.int64)
    edge = np.zeros(window - 1, np.uint64)  # a hash never lies below the least of its own windows
    return np.flatnonzero(_slide(np.concatenate([edge, least, edge]), window, np.maximum) == hashes)


def _match(words: np.ndarray, at: int, lag: int, limit: int, back: bool) -> int:
    """How many words from ``at`` on (or before it) equal the word ``lag`` later, at most ``limit``."""
    done, step = 0, _STEP
    while done < limit:
        n = min(step, limit - done)
        low = at - done - n if back else at + done
        same = words[low:low + n] == words[low + lag:low + lag + n]
        bad = np.flatnonzero(~(same[::-1] if back else same))
        if len(bad):
            return done + int(bad[0])
        done, step = done + n, step * 2
    return done


def _scale_runs(words: np.ndarray, hashes: np.ndarray, text: np.ndarray, first: np.ndarray, last: np.ndarray,
                k: int) -> Iterator[tuple[int, int, int]]:
    """Runs whose period lies in (k/2, k], from equal neighbouring minimizers of words k long."""
    place = minimizers(hashes, k // 2)
    place = place[hashes[place] != _LAST]
    place = place[np.lexsort((place, hashes[place]))]
    lag = place[1:] - place[:-1]
    seed = (hashes[place[1:]] == hashes[place[:-1]]) & (lag > k // 2) & (lag <= k) & (text[place[1:]] == text[place[:-1]])
    at, lag = place[:-1][seed], lag[seed]
    order = np.lexsort((at, lag))
    at, lag = at[order], lag[order]
    i = 0
    while i < len(at):
        m, q = int(at[i]), int(lag[i])
        low, high = int(first[text[m]]), int(last[text[m]])
        start = m - _match(words, m, q, m - low, True)
        length = m - start + _match(words, m, q, high - q - m, False) + q
        if length >= max(MIN_WORDS, MIN_REPEATS * q):
            whole = words[start:start + length]
            if all((whole[q // p:] != whole[:-(q // p)]).any() for p in _prime_divisors(q)):
                yield start, length, q
        # Further seeds of the same lag in this stretch tell nothing new.
        stop = int(np.searchsorted(lag, q, "right"))
        i = max(i + 1, i + int(np.searchsorted(at[i:stop], start + length - q, "left")))


def find_runs(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Runs (start, length, period) of the texts ``words[first[t]:first[t + 1]]``, by start, then period.

    ``words`` are hashes or any other ids; starts count from the first word of all texts.
    """
    counts = np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)
    if len(words) < MIN_WORDS:
        return np.zeros((0, 3), np.int64)
    found = _short_runs(words, text)
    longest = int(counts.max())
    k = 2 * DIRECT
    while longest > MIN_REPEATS * (k // 2):  # a period of the scale, four times, is longer than this
        keep = counts > MIN_REPEATS * (k // 2)
        place = np.flatnonzero(np.repeat(keep, counts))
        sub, n = words[place], counts[keep]
        bounds = np.concatenate([[0], np.cumsum(n)])
        owner = np.repeat(np.arange(len(n)), n)
        hashes = _grams(sub, bounds, k)
        runs = np.asarray(list(_scale_runs(sub, hashes, owner, bounds[:-1], bounds[1:], k)), np.int64).reshape(-1, 3)
        if len(runs):
            runs[:, 0] = place[runs[:, 0]]
            found.append(runs)
        k *= 2
    out = np.concatenate(found).astype(np.int64)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _grams(words: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on; the greatest value where a text ends before."""
    hashed, whole = windows(Words(words, bounds, bounds, words, bounds, bounds), k)
    hashed = np.minimum(hashed, _LAST - np.uint64(1))
    hashed[~whole] = _LAST
    return hashed


def _kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay: a run keeps its first period, what follows goes."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def collapse_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``RUNS`` of each row: its runs by start, then period, and its words without the repeats.

    A word is dropped if some run holds it after that run's first period; the
    rest is joined by one space. A null or empty text, or one of white space,
    has no words, no runs and an empty text. Texts are searched whole, however
    long: a task holds a few arrays as long as the words of a text, and sorts its
    minimizers, about 4/k of the words at scale k. Rows that share an id are
    treated apart; an empty table gives an empty result; further columns are not read.
    """

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in pieces(batch.column(1)):
                words = split_words(data, offsets)
                runs = find_runs(words.hash, words.first)
                raw, first = data.tobytes(), words.first
                cut = np.searchsorted(runs[:, 0], first)
                texts = []
                for t in range(to - at):
                    own = raw[offsets[t]:offsets[t + 1]].split()  # ASCII white space, as these are bytes
                    mine = runs[cut[t]:cut[t + 1]] - np.asarray([first[t], 0, 0])
                    if len(mine):
                        own = [own[i] for i in np.flatnonzero(_kept(len(own), mine))]
                    texts.append(b" ".join(own))
                runs[:, 0] -= np.repeat(first[:-1], np.diff(cut))
                structs = pa.StructArray.from_arrays([pa.array(runs[:, c].copy(), pa.int64()) for c in range(3)],
                                                     ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), pa.array(words.counts(), pa.int64()),
                     pa.ListArray.from_arrays(pa.array(cut, pa.int32()), structs),
                     pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "text"])

    source = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    return map_arrow(source, searched, RUNS)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents, by crc32 of the id, with a periodic tail.

    With h = crc32(doc_id as text), g = h div 10 and n words, if h mod 10 = 0 and
    n > 0 the words from a = g mod n on repeat those from a on with period
    ``1 + (n - a) div (3 + g mod 8)``; their words are joined by one space. Other
    rows, and those with a null id, keep their text.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.expr("h div 10")
    split = F.filter(F.split("text", "[ \\t-\\r]+"), lambda w: w != "")

    def planted(w: Column) -> Column:
        n = F.size(w).cast("long")
        start = F.call_function("mod", F.col("g"), n)
        period = F.call_function("div", n - start, F.lit(3) + F.col("g") % 8) + 1
        return F.array_join(F.transform(w, lambda x, i: F.when(i < start, x).otherwise(
            F.get(w, (start + (i - start) % period).cast("int")))), " ")

    # The words are bound once as a variable, so no word is cut out of the text again.
    changed = F.get(F.transform(F.array(split), lambda w: F.when(F.size(w) > 0, planted(w)).otherwise("")), 0)
    rows = docs.select(F.col("doc_id"), F.col("text"), h.alias("h")).withColumn("g", g)
    return rows.select("doc_id", F.when((F.col("h") % 10 == 0) & F.col("text").isNotNull(), changed)
                       .otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """The strongest run (greatest exact length / period) and digests of all runs and of the text, from ``RUNS``."""

    def stronger(best: Column, run: Column) -> Column:
        # Runs come by start, then period, so an equal ratio never replaces an earlier run.
        return F.when(best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best)

    kind = "struct<start: long, length: long, period: long>"
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    best = F.aggregate("runs", F.lit(None).cast(kind), stronger)
    listed = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return (found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                         F.sha2(listed, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
            .select("doc_id", "n_runs", F.col("best.start").alias("start"), F.col("best.length").alias("length"),
                    F.col("best.period").alias("period"),
                    F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"))
