"""Operator 7: language-model scores by a causal self-attention model, beside a unigram base.

The model reads subword ids of a public tokenizer: one attention layer and one
feed-forward layer over a window of ``WINDOW`` ids. The output tells the
``GROUPS * GROUP - 1`` most frequent ids apart in two steps, the group of ids,
then the id within its group; an id beyond them has its share of the tail's
counts. On the input side these ids share ``BUCKETS`` rows of the embedding by
hash. Long texts are scored in overlapping windows: each id is scored once, by a
window that gives it ``WINDOW - STRIDE`` ids of context at least (or the text's
beginning), many windows at a time.

Equal rows are one text with a number of copies from the start, so no group of
copies is ever gathered. Texts are dealt into blocks of some MB by hash; what a
block learns or scores does not depend on how the table is laid out.

Training has two rounds. In the first, ``WARM_STEPS`` gradient steps over the
windows of one block, or ``WARM_PASSES`` passes over them if these are fewer, find
the common start, at every size of the table. In the second every block takes its own steps from there, over all windows
of all its training texts (``EVERY`` is 1; a caller may ask for one window in
more), and the weights are averaged in Spark. So each position of each training
text moves the weights; id counts and word counts cover all texts whole too.

The texts travel to their blocks once, into a table bucketed by block, and are
encoded there, once: counting ids, learning, the blocks' words and scoring read a
block's ids or texts where they lie. Word counts are looked up block by block: a
block's distinct words are joined to the counts and come back to the block. Nothing that grows with the corpus is broadcast or held by
one task, and a frequent word has a row for each block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import broadcast_if_small
from ..session import ensure_checkpoint_dir
from .subwords import piece_ids
from .tables import map_arrow, materialise, ship_package
from .words import CHUNK_BYTES, Words, mix, pieces, runs, split_words

BLOCK_BYTES = 16 << 20
WINDOW, STRIDE = 32, 24
GROUPS, GROUP, BUCKETS = 32, 64, 256
WIDTH, HIDDEN = 24, 48
BATCH = 64
WARM_STEPS, WARM_PASSES, WARM_RATE = 1500, 4, 0.02
EVERY, RATE = 1, 0.004
BUCKETS_A_BLOCK, MOST_BUCKETS = 4, 50_000
CHUNK, FAN_IN = 4096, 256
ENCODED_AT_ONCE = 2 << 20
STEP_CHUNK, SCORED_AT_ONCE = 1 << 14, 128
END_WORD = int(mix(np.asarray([0x656E64], np.uint64)).view(np.int64)[0])
SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
          "base_score double, score double")

Weights = dict[str, np.ndarray]


class Alphabet:
    """Classes of ids: the most frequent their own, the others hashed buckets on the input side, one tail on the output side."""

    def __init__(self, counts: np.ndarray):
        """``counts``: how often each id occurs; the last entry is the end mark."""
        self.size, own = len(counts), GROUPS * GROUP - 1
        head = np.argsort(-counts, kind="stable")[:own]
        self.out = np.full(self.size, own, np.int64)
        self.out[head] = np.arange(len(head))
        self.into = own + 1 + (np.arange(self.size) * 2654435761 >> 7) % BUCKETS
        self.into[head] = np.arange(len(head))
        tail = np.where(self.out == own, counts + 0.5, 0.0)
        with np.errstate(divide="ignore"):
            self.tail = np.where(self.out == own, np.log(tail / max(tail.sum(), 1e-9)), 0.0)
        share = (np.bincount(self.out, counts, own + 1) + 0.5).reshape(GROUPS, GROUP)
        self.group_bias = np.log(share.sum(1) / share.sum()).astype(np.float32)
        self.bias = np.log(share / share.sum(1, keepdims=True)).astype(np.float32)


def first_weights(alphabet: Alphabet) -> Weights:
    """The start of training: random, but for the output's biases, which are the unigram model."""
    rng = np.random.default_rng(7)
    draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    return {"embed": draw(GROUPS * GROUP + BUCKETS, WIDTH), "place": draw(WINDOW, WIDTH),
            "qkv": draw(WIDTH, 3 * WIDTH) * 2, "back": draw(WIDTH, WIDTH), "up": draw(WIDTH, HIDDEN),
            "down": draw(HIDDEN, WIDTH), "group_out": draw(WIDTH, GROUPS), "group_bias": alphabet.group_bias.copy(),
            "out": draw(GROUPS, WIDTH, GROUP), "bias": alphabet.bias.copy()}


def flatten(w: Weights) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def unflatten(flat: np.ndarray, like: Weights) -> Weights:
    out, at = {}, 0
    for k in sorted(like):
        n = like[k].size
        out[k] = flat[at:at + n].reshape(like[k].shape).astype(np.float32)
        at += n
    return out


_MASK = np.tril(np.ones((WINDOW, WINDOW), np.float32))
_ONES = np.ones(max(WINDOW, GROUPS, GROUP), np.float32)
_SCALE = np.float32(WIDTH ** -0.5)


def attention(w: Weights, x: np.ndarray, last: int = WINDOW) -> dict[str, np.ndarray]:
    """The attention layer's values for the last places of windows of input classes x (B, WINDOW).

    A place sees itself and those before it. Queries and keys meet in one product, and so do values and ``back``:
    ``mixed`` holds both products, ``t`` and ``v`` the places under them. A last column of ones in ``v`` brings the
    row sums: ``z`` holds what the attention ``a`` adds to a place and the sum that it is yet to be divided by.
    """
    b = len(x)
    h0 = w["embed"].take(x.ravel(), 0).reshape(b, WINDOW, WIDTH)
    h0 += w["place"]
    query, key, value = (w["qkv"][:, i * WIDTH:(i + 1) * WIDTH] for i in range(3))
    mixed = np.zeros((WIDTH, 2 * WIDTH + 1), h0.dtype)
    mixed[:, :WIDTH], mixed[:, WIDTH:-1] = query @ key.T * _SCALE, value @ w["back"]
    tv = (h0.reshape(-1, WIDTH) @ mixed).reshape(b, WINDOW, 2 * WIDTH + 1)
    tv[:, :, -1] = 1
    t, v = tv[:, WINDOW - last:, :WIDTH], tv[:, :, WIDTH:]
    a = np.matmul(t, h0.transpose(0, 2, 1).copy())
    if a.max(initial=0) > 60:
        np.minimum(a, 60, out=a)
    np.exp(a, out=a)
    a *= _MASK[WINDOW - last:]
    return {"h0": h0, "mixed": mixed, "t": t, "v": v, "a": a, "z": np.matmul(a, v).reshape(-1, WIDTH + 1)}


def feed_forward(w: Weights, h1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(u, h2): the hidden layer of rows, and the rows with what it adds and a last column of ones for the biases."""
    u = h1 @ w["up"]
    np.maximum(u, np.zeros_like(u), out=u)
    h2 = np.ones((len(h1), WIDTH + 1), h1.dtype)
    np.add(u @ w["down"], h1, out=h2[:, :WIDTH])
    return u, h2


def attended(w: Weights, x: np.ndarray, last: int = WINDOW) -> np.ndarray:
    """The rows that the attention ends in, for the last places of windows."""
    f = attention(w, x, last)
    h1 = f["z"][:, :WIDTH] / f["z"][:, WIDTH:]
    h1 += f["h0"][:, WINDOW - last:].reshape(-1, WIDTH)
    return h1


def forward(w: Weights, x: np.ndarray, last: int = WINDOW) -> dict[str, np.ndarray]:
    """The model's last rows ``h2`` for the last places of windows."""
    return {"h2": feed_forward(w, attended(w, x, last))[1][:, :WIDTH]}


def outputs(w: Weights) -> tuple[np.ndarray, np.ndarray]:
    """The output's two steps with their biases as a last row."""
    return np.concatenate([w["group_out"], w["group_bias"][None]]), np.concatenate([w["out"], w["bias"][:, None]], 1)


def by_group(groups: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order that brings equal groups together, and (group, from, to) of each in that order."""
    groups = groups.astype(np.uint8)
    order = np.argsort(groups, kind="stable")
    ends = np.searchsorted(groups.take(order), np.arange(GROUPS + 1, dtype=np.uint8)).tolist()
    return order, [(c, i, j) for c, (i, j) in enumerate(zip(ends, ends[1:])) if i < j]


def _member_logits(h: np.ndarray, out: np.ndarray, parts: list[tuple[int, int, int]]) -> np.ndarray:
    """Logits of the members of each row's group; rows lie by group."""
    logits = np.empty((len(h), GROUP), h.dtype)
    for c, i, j in parts:
        np.matmul(h[i:j], out[c], out=logits[i:j])
    return logits


def _error(logits: np.ndarray, at: np.ndarray, share: np.ndarray) -> np.ndarray:
    """The loss's slope at the logits of rows that weigh ``share``: softmax less one at the right place."""
    if logits.max(initial=0) > 60 or logits.min(initial=0) < -60:  # else exp neither overflows nor vanishes
        logits -= logits.max(1, keepdims=True)
    np.exp(logits, out=logits)
    logits *= (share / (logits @ _ONES[:logits.shape[1]]))[:, None]
    logits.ravel()[np.arange(len(at)) * logits.shape[1] + at] -= share
    return logits


def gradients(w: Weights, x: np.ndarray, y: np.ndarray, counts: np.ndarray) -> Weights:
    """Of the mean loss over all places, weighted by ``counts``; y: output classes (B, WINDOW).

    Above the attention only the places that count are taken, by the group of what they predict: the others' slopes are 0.
    """
    f = attention(w, x)
    b, h0, v, a = len(x), f["h0"], f["v"], f["a"]
    flat_h0, weight, target = h0.reshape(-1, WIDTH), counts.ravel(), y.ravel()
    live = np.flatnonzero(weight)
    order, parts = by_group(target.take(live) // GROUP)
    live = live.take(order)
    group, member = np.divmod(target.take(live), GROUP)
    share = (weight.take(live) / max(counts.sum(), 1)).astype(np.float32)
    z = f["z"].take(live, 0)
    per_sum = 1 / z[:, WIDTH:]
    z = z[:, :WIDTH] * per_sum
    h1 = flat_h0.take(live, 0)
    h1 += z
    u, h2 = feed_forward(w, h1)
    group_out, out = outputs(w)
    p = _error(h2 @ group_out, group, share)
    slope = h2.T @ p
    g = {"group_out": slope[:WIDTH], "group_bias": slope[WIDTH]}
    dh2 = p @ w["group_out"].T
    p = _error(_member_logits(h2, out, parts), member, share)
    slope, inner = np.zeros_like(out), np.empty_like(dh2)
    across, back = h2.T, w["out"].transpose(0, 2, 1)
    for c, i, j in parts:
        np.matmul(across[:, i:j], p[i:j], out=slope[c])
        np.matmul(p[i:j], back[c], out=inner[i:j])
    g["out"], g["bias"] = slope[:, :WIDTH], slope[:, WIDTH]
    dh2 += inner
    g["down"] = u.T @ dh2
    du = dh2 @ w["down"].T
    du *= u > 0
    g["up"] = h1.T @ du
    dh2 += du @ w["up"].T
    dh0, dz = np.zeros_like(flat_h0), np.zeros((b * WINDOW, WIDTH + 1), flat_h0.dtype)
    dh0[live] = dh2
    dh2 *= per_sum
    dz[live] = np.concatenate([dh2, -np.einsum("nd,nd->n", dh2, z)[:, None]], 1)
    dz = dz.reshape(b, WINDOW, WIDTH + 1)
    da = np.matmul(dz, v.transpose(0, 2, 1).copy())
    da *= a
    dtv = np.empty((b, WINDOW, 2 * WIDTH), flat_h0.dtype)
    np.matmul(da, h0, out=dtv[:, :, :WIDTH])
    np.matmul(a.transpose(0, 2, 1), dz[:, :, :WIDTH], out=dtv[:, :, WIDTH:])
    dtv = dtv.reshape(-1, 2 * WIDTH)
    slope = flat_h0.T @ dtv
    d_match, d_value = slope[:, :WIDTH] * _SCALE, slope[:, WIDTH:]
    query, key, value = (w["qkv"][:, i * WIDTH:(i + 1) * WIDTH] for i in range(3))
    g["qkv"] = np.concatenate([d_match @ key, d_match.T @ query, d_value @ w["back"].T], 1)
    g["back"] = value.T @ d_value
    dh0 += np.matmul(da.transpose(0, 2, 1), f["t"]).reshape(-1, WIDTH)
    dh0 += dtv @ f["mixed"][:, :-1].T
    g["place"] = (np.ones(b, dh0.dtype) @ dh0.reshape(b, -1)).reshape(WINDOW, WIDTH)
    order = np.argsort(x.ravel(), kind="stable")
    ids = x.ravel()[order]
    heads = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    g["embed"] = np.zeros_like(w["embed"])
    g["embed"][ids[heads]] = np.add.reduceat(dh0.take(order, 0), heads, 0)
    return g


class Adam:
    def __init__(self, weights: Weights):
        self.flat, self.w, self.t, at = flatten(weights), {}, 0, 0
        for k in sorted(weights):  # views, so that a step moves all weights at once
            self.w[k] = self.flat[at:at + weights[k].size].reshape(weights[k].shape)
            at += weights[k].size
        self.m, self.v, self.g = (np.zeros_like(self.flat) for _ in range(3))
        self.room = np.empty(STEP_CHUNK, self.flat.dtype)

    def step(self, g: Weights, rate: float) -> None:
        self.t += 1
        fair_m, fair_v = np.float32(1 / (1 - 0.9 ** self.t)), np.float32(1 / (1 - 0.99 ** self.t))
        np.concatenate([g[k].ravel() for k in sorted(g)], out=self.g)
        for i in range(0, len(self.flat), STEP_CHUNK):  # parts that stay in the cache
            m, v, part = self.m[i:i + STEP_CHUNK], self.v[i:i + STEP_CHUNK], self.g[i:i + STEP_CHUNK]
            room = self.room[:len(m)]
            np.subtract(part, m, out=room)
            room *= np.float32(0.1)
            m += room
            np.multiply(part, part, out=room)
            room -= v
            room *= np.float32(0.01)
            v += room
            np.multiply(v, fair_v, out=room)
            np.sqrt(room, out=room)
            room += np.float32(1e-8)
            np.divide(m, room, out=room)
            room *= np.float32(rate) * fair_m
            self.flat[i:i + STEP_CHUNK] -= room


def window_places(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, known, fresh) of windows (B, WINDOW): the id each place predicts, whether it exists, whether it scores.

    A text's first window scores all its places, the others the last STRIDE.
    """
    length = np.diff(first)
    more = np.maximum(-(-(length - WINDOW) // STRIDE), 0)
    count = np.where(length > 0, 1 + more, 0)
    owner = np.repeat(np.arange(len(length)), count)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    place = (first[owner] + number * STRIDE)[:, None] + np.arange(WINDOW)
    known = place < first[owner + 1][:, None]
    fresh = known & ((number == 0)[:, None] | (np.arange(WINDOW) >= WINDOW - STRIDE))
    return place, known, fresh


def log_probabilities(w: Weights, alphabet: Alphabet, flat: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Natural log probability of each id of ``flat`` given those before it in its window."""
    out = np.zeros(len(flat))
    if not len(flat):
        return out
    before = np.empty(len(flat), np.int64)  # what a place reads: the id before it, the end mark at a text's start
    before[1:] = flat[:-1]
    before[first[:-1][np.diff(first) > 0]] = alphabet.size - 1
    into, target = alphabet.into[before], alphabet.out[flat]
    place, known, fresh = window_places(first)
    begins = fresh[:, 0]  # a text's first window scores all its places
    group_out, members = outputs(w)
    for which, last in ((np.flatnonzero(begins), WINDOW), (np.flatnonzero(~begins), STRIDE)):
        for i in range(0, len(which), SCORED_AT_ONCE):
            part = which[i:i + SCORED_AT_ONCE]
            at = np.minimum(place[part], len(flat) - 1)
            h1 = attended(w, into[at], last)
            spot, new = at[:, WINDOW - last:].ravel(), known[part, WINDOW - last:].ravel()
            if not new.all():
                spot, h1 = spot[new], h1[new]
            order, parts = by_group(target[spot] // GROUP)
            spot = spot[order]
            group, member = np.divmod(target[spot], GROUP)
            h2 = feed_forward(w, h1.take(order, 0))[1]
            found = _log_share(h2 @ group_out, group)
            found += _log_share(_member_logits(h2, members, parts), member)
            out[spot] = found
    return out + alphabet.tail[flat]


def _log_share(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log of the softmax of each row at one place."""
    if logits.max(initial=0) > 80:
        np.minimum(logits, 80, out=logits)
    hit = logits.ravel()[np.arange(len(logits)) * logits.shape[1] + at].astype(float)
    np.exp(logits, out=logits)
    return hit - np.log(logits @ _ONES[:logits.shape[1]])


def encode_texts(texts: pa.RecordBatch | pa.Table, tokenizer: str) -> Iterator[pa.RecordBatch]:
    """The rows with ``bytes``, a text's length, and ``ids``, its ids and end mark: 16 bits an id if the vocabulary lets them."""
    encode = piece_ids(tokenizer)
    kind = id_type(encode.end)
    for at, to, data, offsets in pieces(texts.column("text"), ENCODED_AT_ONCE):
        flat, first, _, _ = encode(split_words(data, offsets, lower=True), lower=True)
        ends = (first * kind.itemsize).astype(np.int32)
        ids = pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(ends), pa.py_buffer(flat.astype(kind))])
        part = texts.slice(at, to - at)
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in part.columns]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(offsets)), ids], [*part.schema.names, "bytes", "ids"])


def id_type(end: int) -> np.dtype:
    return np.dtype("<u2" if end < 1 << 16 else "<u4")


def id_pieces(column: pa.Array | pa.ChunkedArray, size: np.ndarray, kind: np.dtype,
              limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, ids, where each text's begin) of the runs that ``pieces`` makes of texts of these sizes."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset)
    first = (offsets - offsets[0]) // kind.itemsize
    flat = np.frombuffer(data, kind, first[-1], offsets[0])
    for at, to in runs(np.append(0, np.cumsum(size)), limit):
        yield at, to, flat[first[at]:first[to]], first[at:to + 1] - first[at]


def id_counts(texts: DataFrame, tokenizer: str) -> np.ndarray:
    """How often each id (the end mark last) occurs in (ids, bytes, copies); as many numbers as the vocabulary has."""
    end = piece_ids(tokenizer).end

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(end + 1)
        for batch in batches:
            copies = batch.column(2).to_numpy()
            for at, to, flat, first in id_pieces(batch.column(0), batch.column(1).to_numpy(), id_type(end)):
                times = copies[at:to]
                total += np.bincount(flat, np.repeat(times, np.diff(first)) if (times != 1).any() else None, end + 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used].astype(np.int64))], ["id", "n"])

    found = map_arrow(texts.select("ids", "bytes", "copies"), rows, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(end + 1)
    for r in found:
        out[r.id] = r.n
    return out


class Lessons:
    """The windows of a block's texts that are learnt from, and gradient steps over them."""

    def __init__(self, texts: pa.Table, alphabet: Alphabet, tokenizer: str, every: int):
        if "ids" not in texts.column_names:
            added = [pa.field("bytes", pa.int64()), pa.field("ids", pa.binary())]
            texts = pa.Table.from_batches([*encode_texts(texts, tokenizer)], pa.schema([*texts.schema, *added]))
        end = alphabet.size - 1
        texts = texts.sort_by([("key", "ascending"), ("doc_id", "ascending")])
        x, y, counts = [np.zeros((0, WINDOW), np.uint16)], [np.zeros((0, WINDOW), np.uint16)], [np.zeros((0, WINDOW), np.float32)]
        copies, keys = texts.column("copies").to_numpy(), texts.column("key").to_numpy()
        for at, to, flat, first in id_pieces(texts.column("ids"), texts.column("bytes").to_numpy(), id_type(end)):
            before = np.empty_like(flat)
            before[1:] = flat[:-1]
            before[first[:-1]] = end  # each text has its end mark at least
            place, known, fresh = window_places(first)
            owner = np.searchsorted(first, place[:, 0], "right") - 1
            number = np.arange(len(owner)) - np.searchsorted(owner, owner)
            of_text = np.bincount(owner, minlength=to - at)
            # One window in ``every``, from a place that the text's hash gives; a short text's last resort is its first.
            begin = (keys[at:to].view(np.uint64) % np.uint64(every)).astype(np.int64)
            begin = np.where(begin < of_text, begin, 0)
            chosen = (number - begin[owner]) % every == 0
            spots = np.minimum(place[chosen], len(flat) - 1)
            x.append(alphabet.into[before[spots]].astype(np.uint16))  # some 2,300 classes
            y.append(alphabet.out[flat[spots]].astype(np.uint16))
            counts.append((fresh[chosen] * copies[at:to][owner[chosen]][:, None]).astype(np.float32))
        self.x, self.y, self.counts = map(np.concatenate, (x, y, counts))

    def learn(self, weights: Weights, steps: int, rate: float, seed: int) -> Weights:
        """Weights after so many steps, the rate falling to nothing; every window once before any again."""
        model, rng, order, done = Adam(weights), np.random.default_rng(seed), np.zeros(0, np.int64), 0
        while done < steps and len(self.x):
            if not len(order):
                order = rng.permutation(len(self.x))
            part, order = order[:BATCH], order[BATCH:]
            model.step(gradients(model.w, self.x[part], self.y[part], self.counts[part]), rate * (1 - done / steps))
            done += 1
        return model.w

    def once(self) -> int:
        return -(-len(self.x) // BATCH)


LEARNT = "block long, chunk int, n double, part binary"


def _parts(weights: Weights, n: float, block: int) -> pa.RecordBatch:
    """The weights times n, in chunks."""
    flat = flatten(weights).astype(float) * n
    cuts = [flat[i:i + CHUNK].tobytes() for i in range(0, len(flat), CHUNK)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(cuts), block)), pa.array(np.arange(len(cuts), dtype=np.int32)),
                                       pa.array(np.full(len(cuts), n)), pa.array(cuts, pa.binary())], ["block", "chunk", "n", "part"])


def _sum_parts(table: pa.Table) -> pa.Table:
    """The sum of one chunk over at most FAN_IN blocks, in the order of the blocks."""
    table = table.sort_by("block")
    total = sum(np.frombuffer(p, float) for p in table.column("part").to_pylist())
    return pa.table({"block": [table.column("block")[0].as_py()], "chunk": table.column("chunk")[:1],
                     "n": [sum(table.column("n").to_pylist())], "part": pa.array([total.tobytes()], pa.binary())})


def _average(learnt: DataFrame, blocks: int, like: Weights) -> Weights:
    """The weights' mean over all blocks, FAN_IN blocks at a time; one row for each chunk reaches the driver."""
    while True:
        learnt = learnt.withColumn("block", F.expr(f"block div {FAN_IN}")).groupBy("block", "chunk").applyInArrow(_sum_parts, LEARNT)
        blocks = -(-blocks // FAN_IN)
        if blocks <= 1:
            break
    rows = learnt.orderBy("chunk").collect()
    if not rows or not rows[0].n:
        return like
    return unflatten(np.concatenate([np.frombuffer(r.part, float) / r.n for r in rows]), like)


def train(texts: DataFrame, tokenizer: str, blocks: int, every: int = EVERY, warm_steps: int = WARM_STEPS) -> tuple[Weights, Alphabet]:
    """Weights and alphabet from (block, key, doc_id, copies, bytes, ids), dealt into so many blocks."""
    alphabet = Alphabet(id_counts(texts, tokenizer))
    texts = texts.select("block", "key", "doc_id", "copies", "bytes", "ids")
    weights = first_weights(alphabet)
    ship_package(texts.sparkSession)

    def warm(table: pa.Table) -> pa.Table:
        lessons = Lessons(table, alphabet, tokenizer, 1)
        steps = min(warm_steps, WARM_PASSES * lessons.once())
        return pa.Table.from_batches([_parts(lessons.learn(weights, steps, WARM_RATE, 0), 1.0, 0)])

    first = texts.agg(F.min("block")).first()[0]
    if first is None:
        return weights, alphabet
    weights = _average(texts.where(F.col("block") == first).groupBy("block").applyInArrow(warm, LEARNT), 1, weights)
    start = weights

    def taught(table: pa.Table) -> pa.Table:
        lessons = Lessons(table, alphabet, tokenizer, every)
        block = table.column("block")[0].as_py()
        return pa.Table.from_batches([_parts(lessons.learn(start, lessons.once(), RATE, block), float(lessons.counts.sum()), block)])

    return _average(texts.groupBy("block").applyInArrow(taught, LEARNT), blocks, start), alphabet


def _distinct(batches: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of counts by word over (words, counts) parts, folded whenever they have grown."""
    words, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def fold() -> tuple[np.ndarray, np.ndarray]:
        all_words = np.concatenate([words, *(w for w, _ in waiting)])
        all_counts = np.concatenate([counts, *(c for _, c in waiting)])
        back, unique = pd.factorize(all_words)
        return unique, np.bincount(back, all_counts, len(unique)).astype(np.int64)

    for w, c in batches:
        waiting.append((w, c))
        held += len(w)
        if held > max(500_000, len(words)):
            words, counts = fold()
            waiting, held = [], 0
    return fold()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all (text, copies), the end mark of each included; pre-aggregated in the tasks."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            copies = batch.column(1).to_numpy()
            yield np.asarray([END_WORD]), np.asarray([copies.sum()])
            for at, to, data, offsets in pieces(batch.column(0)):
                found = split_words(data, offsets, lower=True)
                codes, words = pd.factorize(found.hash.view(np.int64))
                times = np.repeat(copies[at:to], found.counts())
                yield words, np.bincount(codes, times, len(words)).astype(np.int64)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = _distinct(parts(batches))
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(counts)], ["word", "c"])

    sent = map_arrow(texts.select("text", "copies"), rows, "word long, c long")
    return sent.groupBy("word").agg(F.sum("c").alias("c")).where("c > 0")


def block_words(blocks: DataFrame) -> DataFrame:
    """(block, word): the distinct words of each block's texts, and the end mark; a block's words are made distinct where it lies."""

    def rows(table: pa.Table) -> pa.Table:
        part, held = [np.asarray([END_WORD])], 0
        for _, _, data, offsets in pieces(table.column("text")):
            part.append(pd.unique(split_words(data, offsets, lower=True).hash.view(np.int64)))
            held += len(part[-1])
            if held > max(500_000, len(part[0])):  # fold only when it has doubled
                part, held = [pd.unique(np.concatenate(part))], 0
        words = pd.unique(np.concatenate(part))
        return pa.table([pa.array(np.full(len(words), table.column("block")[0].as_py())), pa.array(words)], ["block", "word"])

    ship_package(blocks.sparkSession)
    return blocks.select("block", "text").groupBy("block").applyInArrow(rows, "block long, word long")


DEALT = "block long, key long, doc_id long, held_out boolean, text string, copies long, bytes long, ids binary"


def deal(texts: DataFrame, blocks: int, tokenizer: str) -> DataFrame:
    """``texts`` with their ids written once, bucketed by block, so that what groups them by block reads a block where it lies.

    A block is in one bucket; there are more buckets than blocks, so that few share one.
    """
    buckets = min(BUCKETS_A_BLOCK * blocks, MOST_BUCKETS)
    name = f"scoring_texts_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(texts.sparkSession).rstrip('/')}/classledger/{name}"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from encode_texts(batch, tokenizer)

    (map_arrow(texts.repartition(buckets, "block"), rows, DEALT).write.format("parquet")
     .options(path=path, compression="zstd").bucketBy(buckets, "block").saveAsTable(name))
    return texts.sparkSession.table(name)


def score_documents(docs: DataFrame, tokenizer: str = "piece_bpe_32k.model",
                    id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``SCORES`` of each row: a smoothed unigram score of its words, and the attention model's log10 probability.

    Rows whose crc32(doc_id as text) leaves 1 modulo 5 are held out, all others
    are learnt from; a null doc_id counts as the empty text there. A null text
    is empty: it has the end mark alone. Repeated rows are learnt from and
    scored each, alike. A very long text is a block of its own size, which one
    task learns from and scores, window by window. An empty table gives no rows;
    other columns are not read. Without any training text the model is the
    uniform start.
    """
    key = docs[id_column].cast("long")
    rows = docs.select(key.alias("doc_id"), F.coalesce(docs[text_column].cast("string"), F.lit("")).alias("text"),
                       (F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 5 == 1).alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    number = max(1, -(-size // BLOCK_BYTES))
    # Equal rows are one, with their number: a third of all rows may be copies, and they are reduced in the tasks.
    # Only rows that have an equal one are grouped, so other texts are not moved for it.
    keyed = rows.withColumns({"key": F.xxhash64("text"), "bytes": F.octet_length("text")})
    several = materialise(keyed.groupBy("doc_id", "key", "bytes").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
                          .select(*[F.col(c).alias(f"_{c}") for c in ("doc_id", "key", "bytes")]), "scoring-copies")
    several = broadcast_if_small(several)
    equal = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("key") == F.col("_key")) & (F.col("bytes") == F.col("_bytes"))
    single = keyed.join(several, equal, "left_anti").withColumn("copies", F.lit(1).cast("long"))
    repeated = (keyed.join(several, equal, "left_semi").groupBy("doc_id", "held_out", "key", "bytes")
                .agg(F.any_value("text").alias("text"), F.count(F.lit(1)).alias("copies")))
    distinct = single.unionByName(repeated).withColumn("block", F.pmod(F.xxhash64("doc_id", "key"), F.lit(number)))
    blocks = deal(distinct.select("block", "key", "doc_id", "held_out", "text", "copies"), number, tokenizer)
    learnt = blocks.where(~F.col("held_out"))
    counts = materialise(word_counts(learnt), "scoring-counts")
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    weights, alphabet = train(learnt, tokenizer, number)
    n, smooth = int(totals.n), np.log10(totals.n + 0.5 * (totals.v + 1))
    known = block_words(blocks).join(counts, "word").select("block", "word", "c")

    fields = [c.split()[0] for c in f"{SCORES}, copies long".split(", ")]

    def scored(texts: pa.Table, looked_up: pa.Table) -> pa.Table:
        words = looked_up.column("word").to_numpy()
        order = np.argsort(words)
        words = np.append(words[order], np.iinfo(np.int64).max)
        seen = np.append(looked_up.column("c").to_numpy()[order], 0)

        def count_of(wanted: np.ndarray) -> np.ndarray:
            at = np.searchsorted(words, wanted)
            return np.where(words[at] == wanted, seen[at], 0)

        at_end = int(count_of(np.asarray([END_WORD]))[0])
        texts = texts.sort_by([("key", "ascending"), ("doc_id", "ascending")])
        log_p = [np.zeros(0)]
        for _, _, flat, first in id_pieces(texts.column("ids"), texts.column("bytes").to_numpy(), id_type(alphabet.size - 1)):
            log_p.append(np.add.reduceat(log_probabilities(weights, alphabet, flat, first), first[:-1]))
        scores = np.concatenate(log_p) / np.log(10)
        out = []
        for at, to, data, offsets in pieces(texts.column("text")):
            found = split_words(data, offsets, lower=True)
            back, distinct = pd.factorize(found.hash.view(np.int64))
            c = count_of(distinct)[back]
            owner = np.repeat(np.arange(to - at), found.counts())
            tokens = found.counts() + 1
            base = np.bincount(owner, np.log10(c + 0.5), to - at) + np.log10(at_end + 0.5) - tokens * smooth
            hits = np.bincount(owner, c > 0, to - at).astype(np.int64) + (at_end > 0)
            out.append(pa.table([texts.column("doc_id").slice(at, to - at), texts.column("held_out").slice(at, to - at),
                                 pa.array(tokens), pa.array(hits), pa.array(np.full(to - at, n)), pa.array(base),
                                 pa.array(scores[at:to]), texts.column("copies").slice(at, to - at)], fields))
        if not out:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(),
                                                       pa.float64(), pa.float64(), pa.int64())], fields)
        return pa.concat_tables(out)

    ship_package(docs.sparkSession)
    once = blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(scored, f"{SCORES}, copies long")
    return once.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "_copy")
