"""Operator 11 against a dense eigensolver, on planted and awkward vectors."""

import math

import numpy as np
import pytest

from classledger.llm import catalog, whitening
from classledger.llm.tables import read
from classledger.llm.whitening import whiten

from ..conftest import SF_SMALL


def brute(vectors, components=16):
    """{vec_id: [(deviation, whitened row up to signs)]} and the explained shares."""
    rows = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in vectors]
    fit = sorted({tuple(x) for _, x in rows})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    centred = np.asarray([[(n * x[j] - sums[j]) / n for j in range(d)] for x in fit])
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    keep = np.argsort(values)[::-1][:components]
    keep = [k for k in keep if values[k] > 1e-9 * values.max()]
    out = []
    for i, x in rows:
        apart = [n * x[j] - sums[j] for j in range(d)]
        out.append((i, sum(a * a for a in apart), np.asarray(apart) / n @ axes[:, keep] / np.sqrt(values[keep])))
    return n, out, values[keep] / np.trace(cov)


def check(rows, vectors, components=16):
    n, want, explained = brute(vectors, components)
    got = {}
    for r in rows:
        got.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
    assert len(rows) == len(want) * len(explained)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-10
    assert all(r.n == n and abs(r.explained / explained[r.component - 1] - 1) < 1e-9 for r in rows)
    signs = np.zeros(len(explained))
    for i, deviation, w in want:
        found = got[i, deviation]
        assert sorted(found) == list(range(1, len(explained) + 1))
        for k in range(len(explained)):
            value = found[k + 1][0].whitened
            if not signs[k] and abs(w[k]) > 1e-3:
                signs[k] = np.sign(value * w[k])
            assert abs(value - (signs[k] or 1) * w[k]) < 1e-7, (i, k)


def frame(spark, vectors):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in vectors], "vec_id long, embedding array<float>").repartition(5)


def test_planted_directions_equal_the_dense_solver(spark):
    rng = np.random.default_rng(3)
    basis = np.linalg.qr(rng.standard_normal((70, 70)))[0]
    x = (rng.standard_normal((900, 70)) * 1.07 ** -np.arange(70) * 30) @ basis + rng.standard_normal(70)
    vectors = [(i, v.astype(np.float32)) for i, v in enumerate(x)]
    vectors += [(1000 + i, vectors[7][1]) for i in range(400)] + [(5, vectors[5][1])]   # one vector a third of all rows
    check(whiten(frame(spark, vectors)).collect(), vectors)
    check(whiten(frame(spark, vectors), components=3, block=4, degree=5).collect(), vectors, 3)


def test_the_query_on_a_whole_table(spark):
    table = read(spark, SF_SMALL, "embeddings", "vec_id", "embedding").collect()
    check(catalog.op11_whitening(spark, SF_SMALL).collect(), [(r.vec_id, r.embedding) for r in table])


def test_a_block_that_cannot_converge_is_refused(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, v) for i, v in enumerate(rng.standard_normal((200, 40)))]
    with pytest.raises(whitening.NotCertified):
        whiten(frame(spark, vectors), components=4, block=1, degree=2, rounds=2)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0, 0.5]), (1, [1.0, 2.0, 0.5]), (2, [-1.0, 0.25, 3.0]), (3, [0.0, 0.0, 0.0]), (None, [4.0, -2.0, 1.0])]
    bad = [(10, None), (11, []), (12, [1.0, None, 2.0]), (13, [nan, 1.0, 2.0]), (14, [1.0, inf, 2.0]), (15, [1.0, -inf, 0.0]), (16, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, "i") for i, v in good + bad], "vec_id long, embedding array<double>, x int, i string")
    check(whiten(df).collect(), good)
    flat = spark.createDataFrame([(1, [1.0, 5.0]), (2, [2.0, 5.0]), (3, [3.0, 5.0])], "vec_id long, embedding array<double>")
    check(whiten(flat).collect(), [(1, [1.0, 5.0]), (2, [2.0, 5.0]), (3, [3.0, 5.0])])   # rank one: one component
    same = spark.createDataFrame([(1, [1.0, 5.0]), (2, [1.0, 5.0])], "vec_id long, embedding array<double>")
    assert whiten(same).count() == 0
    assert whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
