"""Operator 13 against brute force, on random low-complexity texts and awkward rows."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from classledger.llm import catalog, periodic_runs
from classledger.llm.periodic_runs import collapse_runs, find_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            e = i + q
            if e - s >= max(6, 4 * q) and not any(all(w[x] == w[x + d] for x in range(s, e - d)) for d in range(1, q)):
                out.append((s, e - s, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text, plant=True):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if plant and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def random_words(rng, most=400):
    w = []
    for _ in range(rng.randrange(0, 9)):
        letters = rng.choice([2, 3, 50])
        if rng.random() < 0.4:
            w += [rng.randrange(letters) for _ in range(rng.randrange(1, 30))]
        else:
            p = [rng.randrange(letters) for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 9, 10, 15, 16, 17, 31, 32, 33, 48, 64, 65]))]
            p = p * rng.choice([1, 1, 2, 3])
            w += (p * 9)[:int(len(p) * rng.uniform(2, 7))]
    return w[:most]


def test_runs_of_random_words_equal_brute_force():
    rng, total = random.Random(11), set()
    for _ in range(60):
        texts = [random_words(rng) for _ in range(rng.randrange(1, 5))] + [[]] * rng.randrange(2)
        first = np.cumsum([0] + [len(t) for t in texts])
        flat = np.asarray([x for t in texts for x in t], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        want = [(s + int(first[t]), length, q) for t, w in enumerate(texts) for s, length, q in brute_runs(w)]
        assert [tuple(r) for r in find_runs(flat, first).tolist()] == sorted(want, key=lambda r: (r[0], r[2]))
        total |= {q for _, _, q in want}
    assert len(total) > 12 and max(total) > 60


@pytest.mark.parametrize("q", [1, 2, 7, 8, 9, 15, 16, 17, 33, 100, 500, 1024, 1025])
def test_every_scale_finds_its_shortest_run(q):
    rng = np.random.default_rng(q)
    period = rng.integers(1, 2**62, q, dtype=np.uint64)
    length = max(6, 4 * q)
    around = rng.integers(1, 2**62, 300, dtype=np.uint64)
    words = np.concatenate([around, np.tile(period, 7)[:length], around[::-1]])
    assert find_runs(words, np.asarray([0, len(words)])).tolist() == [[300, length, q]]
    words = np.concatenate([around, np.tile(period, 7)[:length - 1], around[::-1]])
    assert find_runs(words, np.asarray([0, len(words)])).tolist() == []


def test_one_long_text(spark):
    """A million words: one of period 1,000 with a word changed, then one word alone."""
    words = np.tile(np.arange(1, 1001, dtype=np.uint64), 1000)
    words[500_000] = 7777
    got = find_runs(words, np.asarray([0, len(words)])).tolist()
    assert got == [[0, 500_000, 1000], [500_001, 499_999, 1000]]
    assert find_runs(np.ones(1_000_000, np.uint64), np.asarray([0, 1_000_000])).tolist() == [[0, 1_000_000, 1]]


AWKWARD = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "a a a a a a"), (6, "a a a a a"), (7, "a b " * 20 + "c d e " * 4),
           (8, "x\x00y \x0b " * 9), (9, "\u3000a\u3000 b\u00a0 " * 12), (9, "A a A a A a A a"), (None, "n n n n n n n")] + [
    (i, " ".join(f"w{j % (3 + i % 40)}" for j in range(13 * i % 300))) for i in range(10, 90)]


def test_the_query_equals_brute_force(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, 1, "g") for i, t in AWKWARD], "doc_id long, text string, h int, g string").repartition(5)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, catalog.op13_runs(spark, str(tmp_path)).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()), key=str)
    assert got == sorted((brute_row(i, t) for i, t in AWKWARD), key=str)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in AWKWARD) > 5
    plain = periodic_runs.run_digests(collapse_runs(docs))
    assert sorted(map(tuple, plain.collect()), key=str) == sorted((brute_row(i, t, False) for i, t in AWKWARD), key=str)


def test_empty_table(spark):
    assert collapse_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
