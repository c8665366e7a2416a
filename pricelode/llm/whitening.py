"""Whitening of embeddings by LOBPCG (locally optimal block preconditioned conjugate gradients).

Entries c become integers x = floor(1024 c) + 100000. One pass adds n and the sums S of each dimension, as integers. The
covariance of the centred rows is never formed: each iteration multiplies it with a block of columns in one pass over
the rows (every task sends one row for each cell of the product, whatever it has read). The block holds an orthonormal basis of the iterate, the
preconditioned residuals and the previous directions; Rayleigh-Ritz on it gives the next iterate, with ``GUARD`` columns more than are
asked for, so that near eigenvalues behind the last one don't slow it down. Since products always are fresh ones, the residual of an
iterate is a certificate: iteration ends when the residuals of all components are at most ``TOLERANCE`` of the
largest eigenvalue, or when rounding lets them fall no more and they are at most ``ENOUGH`` of it.

A last pass multiplies with the final components: it gives the covariance of the whitened rows, and ``identity_error``.

Defined cases: vectors that are null, empty, of another length than the most frequent one (of equal frequencies, the longest),
or hold a null or non-finite component, or one of 2^40 or more in size (its integers would not be exact), take no part; a null id stays null; repeated rows count each;
of ties between eigenvalues any basis of unit vectors is taken; components without variance (eigenvalue at most ``NO_VARIANCE`` of the largest) are left out, so
equal vectors give no rows; with fewer dimensions than components there are as many as dimensions; a deviation beyond a long is null;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelode.llm.common import written

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
GUARD = 8
TOLERANCE = 1e-13
ENOUGH = 1e-9
NO_VARIANCE = 1e-12
#: Iterations without a residual halved, after which rounding is taken to be the limit.
PATIENCE = 4
MOST = 500
SEED = 11
#: Entries from here on are too large for exact integers.
LARGEST = float(1 << 40)


class Fit(NamedTuple):
    """What the passes found; all small."""

    n: int
    sums: list[int]  # of each dimension, exact
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # (dimensions, components)
    trace: float
    residuals: np.ndarray  # of each component, over the largest eigenvalue
    identity_error: float
    passes: int


def integers(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, x) of the vectors that take part."""
    own = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))  # infinity is larger
    own = own.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(fine, F.lit(False)))
    sizes = own.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    size = sizes[0]["size"] if sizes else 0
    return own.where(F.size("v") == size).select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of integers, all of the same length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def column_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """n and the sum of each dimension, as integers of any size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for batch in batches:
            if batch.num_rows:
                own = [int(s) for s in _matrix(batch.column(0)).sum(axis=0)]
                sums = own if sums is None else [a + b for a, b in zip(sums, own, strict=True)]
                n += batch.num_rows
        if sums:
            exact = pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype=np.int32)), pa.array([n] * len(sums), pa.int64()), exact], ["dim", "n", "s"])

    found = rows.select("x").mapInArrow(add, "dim int, n long, s decimal(38,0)").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("dim").collect()
    return (found[0]["n"] if found else 0), [int(r["s"]) for r in found]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n in double precision: whole parts are subtracted as integers."""
    whole, rest = np.array([s // n for s in sums], np.int64), np.array([(s % n) / n for s in sums])
    return (x - whole) - rest


def product(rows: DataFrame, n: int, sums: list[int], block: np.ndarray) -> np.ndarray:
    """The covariance times ``block``, by one pass over the rows."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(block.shape)
        seen = False
        for batch in batches:
            if batch.num_rows:
                y = centred(_matrix(batch.column(0)), n, sums)
                total += y.T @ (y @ block)
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.reshape(-1))], ["cell", "part"])

    added = rows.select("x").mapInArrow(multiply, "cell int, part double").groupBy("cell").agg(F.sum("part").alias("v")).toArrow()
    out = np.zeros(block.size)
    out[added.column("cell").to_numpy()] = added.column("v").to_numpy()
    return out.reshape(block.shape) / n


def variances(rows: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """The covariance's diagonal."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sums))
        for batch in batches:
            if batch.num_rows:
                total += (centred(_matrix(batch.column(0)), n, sums) ** 2).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(total)], ["dim", "v"])

    found = rows.select("x").mapInArrow(add, "dim int, v double").groupBy("dim").agg(F.sum("v").alias("v")).orderBy("dim").collect()
    return np.array([r["v"] for r in found]) / n


def orthonormal(block: np.ndarray, against: np.ndarray | None = None) -> np.ndarray:
    """An orthonormal basis of the block's columns, without what ``against`` (orthonormal) spans; dependent columns go."""
    for _ in range(2):  # twice is enough for rounding
        if against is not None:
            block = block - against @ (against.T @ block)
        size = np.linalg.norm(block, axis=0)
        block = block[:, size > 1e-300] / size[size > 1e-300]
        if not block.shape[1]:
            return block
        left, s, _ = np.linalg.svd(block, full_matrices=False)
        block = left[:, s > 1e-10 * s[0]]
    return block


def lobpcg(multiply: Callable[[np.ndarray], np.ndarray], diagonal: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, their unit vectors and residuals (over the largest eigenvalue) of the symmetric
    matrix that ``multiply`` multiplies with."""
    d = len(diagonal)
    width = min(d, k + GUARD)
    basis = orthonormal(np.random.default_rng(SEED).standard_normal((d, width)))
    best, waited = np.inf, 0
    for _ in range(MOST):
        made = multiply(basis)
        inner = basis.T @ made
        theta, turn = np.linalg.eigh((inner + inner.T) / 2)
        theta, turn = theta[::-1][:width], turn[:, ::-1][:, :width]
        iterate = basis @ turn
        residual = made @ turn - iterate * theta
        if theta[0] <= 0:
            return theta[:k], iterate[:, :k], np.zeros(k)
        size = np.linalg.norm(residual, axis=0)[:k] / theta[0]
        waited = waited + 1 if size.max() > best / 2 else 0
        best = min(best, size.max())
        if size.max() <= TOLERANCE or len(basis.T) == d or (waited >= PATIENCE and size.max() <= ENOUGH):
            return theta[:k], iterate[:, :k], size
        # the way that the iterate came, without what was iterate before
        way = basis[:, width:] @ turn[width:]
        scale = np.abs(diagonal[:, None] - theta[None, :])
        steered = residual / np.maximum(scale, 0.1 * theta[0])
        basis = np.hstack([iterate, orthonormal(np.hstack([steered, way]), iterate)])
        if basis.shape[1] == width:  # nothing left to add: the residuals are rounding
            return theta[:k], iterate[:, :k], size
    raise RuntimeError(f"residuals of {best:.1e} after {MOST} iterations")


def fit(rows: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """Components of rows (written: they are read in each pass); None without variance."""
    n, sums = column_sums(rows)
    if not n:
        return None
    diagonal = variances(rows, n, sums)
    if not diagonal.sum() > 0:
        return None
    passes = 2

    def multiply(block: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return product(rows, n, sums, block)

    values, vectors, residuals = lobpcg(multiply, diagonal, min(components, len(sums)))
    some = values > NO_VARIANCE * values[0]
    values, vectors, residuals = values[some], vectors[:, some], residuals[some]
    white = vectors / np.sqrt(values)
    error = float(np.abs(white.T @ multiply(white) - np.eye(len(values))).max())
    return Fit(n, sums, values, vectors, float(diagonal.sum()), residuals, error, passes)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum of (n x - S)^2 of each row, exact; None beyond a long."""
    whole, rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)
    away = x - whole
    largest = n * (int(np.abs(away).max(initial=0)) + 1)
    if x.shape[1] * largest * largest < 1 << 63:
        return ((n * away - rest) ** 2).sum(axis=1).tolist()
    exact = [sum((n * a - r) ** 2 for a, r in zip(row, rest.tolist(), strict=True)) for row in away.tolist()]
    return [e if e < 1 << 63 else None for e in exact]


def whitened(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row for each vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error and residual."""
    rows = written(integers(vectors, vec_id, embedding), "integers")
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double"
    found = fit(rows, components)
    if found is None:
        return rows.sparkSession.createDataFrame([], schema)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(found.values)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, rows = _matrix(batch.column(1)), batch.num_rows
            white = centred(x, found.n, found.sums) @ (found.vectors / np.sqrt(found.values))
            each = np.repeat(np.arange(rows), k)
            columns = [
                batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, found.n, np.int64)),
                pa.array(deviations(x, found.n, found.sums), pa.int64()).take(pa.array(each)), pa.array(white.reshape(-1)),
                pa.array(np.tile(found.values / found.trace, rows)), pa.array(np.full(rows * k, found.identity_error)), pa.array(np.tile(found.residuals, rows)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "residual"])

    return rows.mapInArrow(project, schema)
