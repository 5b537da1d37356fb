"""Operator 12 against brute force, on awkward, repeated and random tables."""

import collections
import hashlib
import random

from classledger.llm import catalog, line_dedup
from classledger.llm.line_dedup import dedup_lines

SPACES = " \t\n\x0b\x0c\r"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(rows, min_chars=20, min_documents=3):
    holders = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[lower(line.strip(SPACES))].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = []
        for line in lines:
            key = lower(line.strip(SPACES))
            ids = holders[key]
            top = max((x for x in ids if x is not None), default=None)
            if len(key) < min_chars or len(ids) < min_documents or i == top:
                kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def result(df):
    return sorted(map(tuple, df.select("doc_id", "n_lines", "n_dropped", "text").collect()), key=str)


LONG = "a line of more than twenty characters"
SHORT = "nineteen characters"      # 19
EXACT = "exactly twenty chars"      # 20
WIDE = "é" * 19                    # 38 bytes, 19 code points
AWKWARD = [
    (1, None), (2, ""), (3, "\n"), (4, f"{LONG}\n{LONG}\nown"), (5, f"  {LONG.upper()}\t\r\nmid\n{LONG}"),
    (6, f"{LONG}\n{SHORT}\n{EXACT}\n{WIDE}"), (7, f"{SHORT}\n{EXACT}\n{WIDE}é"), (8, f"x\n{SHORT}\n{EXACT}\n{WIDE}\n{WIDE}é"),
    (9, f"{WIDE}é\n{WIDE}É"), (9, f"{WIDE}é\n{WIDE}É"), (9, "another text of the same id, long"), (None, f"{LONG}\nnull id"),
    (10, "another text of the same id, long"), (-3, "another text of the same id, long\n\n"), (11, LONG), (12, "\x00\x0b" + "z" * 5000),
    (13, " " + EXACT), (14, "z" * 5000 + "\n日本" * 3)]


def test_awkward_rows_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "k", 1, b"") for i, t in AWKWARD], "doc_id long, text string, keys string, _row int, gone binary")
    assert result(dedup_lines(docs.repartition(5))) == brute(AWKWARD)


def test_random_corpora_equal_brute_force(spark):
    rng = random.Random(7)
    pool = [f"shared line number {i} of the pool" for i in range(40)] + ["short", "", "  "]
    rows = [(rng.randrange(120), "\n".join(rng.choice(pool) if rng.random() < 0.5 else f"line {rng.random()} of its own text"
                                           for _ in range(rng.randrange(0, 12)))) for _ in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = brute(rows)
    assert sum(r[2] for r in want) > 100
    assert result(dedup_lines(docs)) == want
    assert result(dedup_lines(docs, min_chars=3, min_documents=2)) == brute(rows, 3, 2)


def test_the_filters_size_and_the_join_change_nothing(spark, monkeypatch):
    rows = AWKWARD + [(100 + i, f"{LONG}\n{'own line of document number %d' % i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = brute(rows)
    monkeypatch.setattr(line_dedup, "BITS_PER_KEY", 0)      # one segment
    assert result(dedup_lines(docs)) == want
    monkeypatch.setattr(line_dedup, "BITS_PER_KEY", 1 << 14)  # many segments
    monkeypatch.setattr(line_dedup, "broadcast_if_small", lambda df: df)
    assert result(dedup_lines(docs)) == want


def test_once_seen_lines_do_not_shuffle(spark):
    rows = [(i, f"{LONG}\nline {i} that only one document holds") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("xxhash64(doc_id) as _row", "doc_id", "text").repartition(4)
    keys = line_dedup.line_keys(docs)
    assert keys.selectExpr("sum(size(keys))").first()[0] == 4000
    n = line_dedup.suspects(keys, 1).count()
    assert 2000 <= n <= 2100          # the repeated line everywhere, and few others


def test_empty_table_and_query_columns(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert dedup_lines(none).count() == 0
    spark.createDataFrame(AWKWARD, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.op12_lines(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got), key=str) == sorted(
        ((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute(AWKWARD)), key=str)
