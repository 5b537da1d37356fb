"""Operator 11: whitening by Chebyshev-filtered subspace iteration.

``whole_numbers`` turns vectors into integers, so that counts, sums and the
deviations are exact. The fit list, each distinct vector once, is written and
then only read in passes: a pass sends a block Q of ``b`` columns to the tasks,
each adds up ``X^T (X Q)`` of its centred rows, and the partial sums meet in a
Spark aggregate, one row for each dimension. What reaches the driver is ``b``
numbers a dimension, whatever the number of rows.

A round is a polynomial in V applied to the block by the three-term Chebyshev
recurrence, one pass a degree: it keeps directions with eigenvalues in
[0, cut] small and lets the others grow, where cut is the block's least Ritz
value. Then the block is made orthonormal (QR, dimensions x b), and one more
pass gives the Rayleigh-Ritz values, vectors and residuals. It ends when the
residuals of the wanted vectors are at ``GOAL`` times the largest eigenvalue, or
have stopped falling below ``ACCEPTED`` times it (rounding error). A block as
wide as the space needs no filter. A last pass measures the whitened covariance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import map_arrow, materialise

COMPONENTS = 16
#: Columns of the block for each wanted component: the further below the last one the cut lies, the fewer passes.
BLOCK = 3
DEGREE = 12
ROUNDS = 40
GOAL = 1e-14
ACCEPTED = 1e-11
#: Eigenvalues below this part of the largest are zero: rounding error, not a direction.
RANK = 1e-12
OFFSET = 1_000_000
SCALE = 64
COLUMNS = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


class NotCertified(RuntimeError):
    """The wanted eigenvectors did not reach the accepted residual."""


def whole_numbers(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows whose vector is whole: x is floor(64 c) + 1000000 of each entry c.

    Null and empty vectors and those with a null, NaN or infinite entry are left
    out. All vectors must have one length: the one that most rows have (of equal
    counts, the longer); others are left out too.
    """
    v = F.col("v")
    sound = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = (vectors.select(vectors[id_column].cast("long").alias("vec_id"), vectors[vector_column].cast("array<double>").alias("v"))
            .where(v.isNotNull() & (F.size(v) > 0) & sound))
    x = F.transform(v, lambda c: F.floor(c * SCALE) + F.lit(OFFSET).cast("long"))
    rows = materialise(rows.select("vec_id", x.alias("x")), "whole-vectors")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows if lengths is None else rows.where(F.size("x") == lengths.d)


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column of equal lengths."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Passes:
    """Sums over the fit list, each one Spark job."""

    def __init__(self, fit: DataFrame):
        self.fit = fit
        self.n, self.sums = self._moments()

    def _summed(self, task, columns: int, kind: str) -> np.ndarray:
        """Rows (i, y0, y1, ...) of all tasks, added up by i; as many rows as dimensions reach the driver."""
        names = [f"y{j}" for j in range(columns)]

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    part = task(_matrix(batch.column(0)))
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(total), dtype=np.int32))] + [pa.array(np.ascontiguousarray(c)) for c in total.T], ["i"] + names)

        sent = map_arrow(self.fit, sums, ", ".join(["i int"] + [f"{c} {kind}" for c in names]))
        met = sent.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).toArrow().sort_by("i")
        return np.stack([met[c].to_numpy() for c in names], axis=1) if met.num_rows else np.zeros((0, columns))

    def _moments(self) -> tuple[int, np.ndarray]:
        got = self._summed(lambda x: np.stack([np.full(x.shape[1], len(x), np.int64), x.sum(axis=0)], axis=1), 2, "long")
        return (int(got[0, 0]), got[:, 1].astype(np.int64)) if len(got) else (0, np.zeros(0, np.int64))

    def trace(self) -> float:
        n, sums = self.n, self.sums
        return float(self._summed(lambda x: (_centred(x, n, sums) ** 2).sum(axis=0)[:, None], 1, "double").sum()) / n

    def times(self, q: np.ndarray) -> np.ndarray:
        """V q, of one pass over all rows."""
        n, sums = self.n, self.sums

        def task(x: np.ndarray) -> np.ndarray:
            c = _centred(x, n, sums)
            return c.T @ (c @ q)

        return self._summed(task, q.shape[1], "double") / n

    def whitened_covariance(self, project: np.ndarray) -> np.ndarray:
        """Covariance of the fit list's whitened rows; their mean is that of centred rows, nought but for rounding."""
        n, sums, width = self.n, self.sums, project.shape[1]

        def task(x: np.ndarray) -> np.ndarray:
            w = _centred(x, n, sums) @ project
            return np.concatenate([w.T @ w, w.sum(axis=0)[:, None]], axis=1)

        got = self._summed(task, width + 1, "double") / n
        return got[:, :width] - np.outer(got[:, width], got[:, width])


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n, rounded once: the difference is taken in whole numbers."""
    return (x * n - sums) / n


def _orthonormal(y: np.ndarray) -> np.ndarray:
    return np.linalg.qr(np.linalg.qr(y)[0])[0]


def filtered(passes: Passes, q: np.ndarray, cut: float, top: float, degree: int) -> np.ndarray:
    """p(V) q, p the Chebyshev polynomial of [0, cut], scaled to stay near 1 at ``top``."""
    centre, half = cut / 2, cut / 2
    sigma = first = half / (top - centre)
    before, now = q, (passes.times(q) - centre * q) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        now, before = (passes.times(now) - centre * now) * (2 * after / half) - before * (sigma * after), now
        sigma = after
    return now


def leading_vectors(passes: Passes, components: int = COMPONENTS, block: int = BLOCK, degree: int = DEGREE,
                    rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of V and their unit vectors as columns, at most ``components`` of them.

    Eigenvalues that are zero up to rounding have no vectors here. Raises
    ``NotCertified`` if the residuals stay above ``ACCEPTED`` times the largest.
    """
    d = len(passes.sums)
    width = min(d, components * block)
    if not width or passes.n < 2:
        return np.zeros(0), np.zeros((d, 0))
    q = _orthonormal(np.random.default_rng(11).standard_normal((d, width)))
    best, stalled = None, 0
    for _ in range(rounds):
        vq = passes.times(q)
        values, turn = np.linalg.eigh((q.T @ vq + vq.T @ q) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        if values[0] <= 0:
            return np.zeros(0), np.zeros((d, 0))
        wanted = min(components, int((values > RANK * values[0]).sum()))
        error = float(np.linalg.norm(vq - q * values, axis=0)[:wanted].max() / values[0])
        stalled = 0 if best is None or error < 0.9 * best[0] else stalled + 1
        if best is None or error <= best[0]:
            best = (error, values[:wanted], q[:, :wanted])
        if width == d or error <= GOAL or (stalled > 1 and best[0] <= ACCEPTED):
            break
        cut = max(float(values[-1]), RANK * float(values[0]))
        if cut >= 0.999999 * values[0]:
            cut = 0.5 * float(values[0])
        q = _orthonormal(filtered(passes, q, cut, float(values[0]), degree))
    if width < d and best[0] > ACCEPTED:
        raise NotCertified(f"residual {best[0]:.1e} after {rounds} rounds; a wider block or more rounds are needed")
    return best[1], best[2]


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id",
           vector_column: str = "embedding", **settings) -> DataFrame:
    """``COLUMNS``: each whole row on each component, by the covariance of the distinct vectors.

    ``whitened`` is (x - S/n) on the component over the root of its eigenvalue,
    ``deviation`` the exact sum of (n x - S)^2. Rows that are equal, or share an
    id, are each returned; equal vectors count once in the fit. Rows without a
    whole vector (see ``whole_numbers``) are left out. There are fewer components
    than asked for where the covariance has a lower rank, and no rows at all if
    all vectors are equal; an empty table gives an empty result. Equal
    eigenvalues give any orthonormal vectors of their space. A vector whose
    deviation does not fit a long stops the job. Other columns are not read.
    ``settings`` go to ``leading_vectors``.
    """
    rows = whole_numbers(vectors, id_column, vector_column)
    passes = Passes(materialise(rows.select("x").distinct(), "distinct-vectors"))
    values, axes = leading_vectors(passes, components, **settings)
    n, sums, count = passes.n, passes.sums, len(values)
    project = axes / np.sqrt(values)
    if count:
        explained = values / passes.trace()
        error = float(np.abs(passes.whitened_covariance(project) - np.eye(count)).max())
    else:
        explained, error = values, 0.0

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not count:
                continue
            x = _matrix(batch.column(1))
            apart = x * n - sums
            if float(np.abs(apart).max()) ** 2 * x.shape[1] < 2.0 ** 63:
                deviation = (apart ** 2).sum(axis=1)
            else:
                deviation = [sum(int(e) ** 2 for e in row) for row in apart]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), count)) if not batch.column(0).null_count
                 else batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), count))),
                 pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                 pa.array(np.full(len(x) * count, n, np.int64)), pa.array(np.repeat(pa.array(deviation, pa.int64()).to_numpy(), count)),
                 pa.array(((apart / n) @ project).ravel()), pa.array(np.tile(explained, len(x))),
                 pa.array(np.full(len(x) * count, error))], [c.split()[0] for c in COLUMNS.split(", ")])

    return map_arrow(rows, projected, COLUMNS)
