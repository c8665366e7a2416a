"""Whitening against a covariance in exact fractions and numpy's eigenvectors."""

import math
from fractions import Fraction

import numpy as np
import pytest

from pricelode.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n int, whitened string"


def table(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, None if v is None else [None if c is None else float(c) for c in v], 1, "clash") for i, v in enumerate(vectors)], SCHEMA)


def brute(vectors):
    """x, n, sums, eigenvalues (falling), eigenvectors, trace"""
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(row[j] for row in x) for j in range(d)]
    y = np.array([[float(Fraction(n * row[j] - sums[j], n)) for j in range(d)] for row in x])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    return x, n, sums, y, values[::-1], vectors[:, ::-1]


def check(rows, vectors, ids, components=8):
    x, n, sums, y, values, basis = brute(vectors)
    k = min(components, len(sums))
    assert len(rows) == n * k
    got = {(r.vec_id, r.component): r for r in rows}
    for j in range(k):
        want = y @ basis[:, j] / math.sqrt(values[j])
        have = np.array([got[i, j + 1].whitened for i in ids])
        sign = 1 if (want * have).sum() > 0 else -1
        assert np.abs(sign * have - want).max() < 1e-8
        one = got[ids[0], j + 1]
        assert one.n == n and one.explained == pytest.approx(values[j] / values.sum(), rel=1e-9) and one.identity_error < 1e-10 and one.residual < 1e-11
    for i, row in zip(ids, x, strict=True):
        assert got[i, 1].deviation == sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True))


@pytest.mark.parametrize("d", [1, 3, 8, 40])
def test_components_equal_eigenvectors(spark, d):
    rng = np.random.default_rng(d)
    vectors = (rng.standard_normal((300, d)) * np.linspace(2, 0.3, d)).astype(np.float32)
    check(whitening.whitened(table(spark, vectors).repartition(3)).collect(), vectors, list(range(300)))


def test_only_passes_over_rows_find_the_components(spark):
    """Far more dimensions than a block holds, with near eigenvalues; as many passes as iterations, the sums, the diagonal and the proof."""
    rng = np.random.default_rng(1)
    turn = np.linalg.qr(rng.standard_normal((200, 200)))[0]
    vectors = ((rng.standard_normal((2000, 200)) * np.r_[np.linspace(3, 2, 12), np.full(188, 0.2)]) @ turn + 5).astype(np.float32)
    rows = whitening.written(whitening.integers(table(spark, vectors)), "rows")
    found = whitening.fit(rows)
    _, _, _, _, values, basis = brute(vectors)
    assert 5 < found.passes < 60 and np.allclose(found.values, values[:8], rtol=1e-11)
    assert np.abs(np.abs((found.vectors * basis[:, :8]).sum(axis=0)) - 1).max() < 1e-10


def test_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").collect()
    ok = [r for r in rows if r.embedding and all(c is not None and math.isfinite(c) for c in r.embedding)]
    got = whitening.whitened(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")).collect()
    check(got, [r.embedding for r in ok], [r.vec_id for r in ok])


def test_vectors_that_take_no_part(spark):
    rng = np.random.default_rng(2)
    good = rng.standard_normal((50, 4)).astype(np.float32).tolist()
    odd = [None, [], [1.0, None, 2.0, 3.0], [1.0, math.nan, 2.0, 3.0], [math.inf, 1.0, 2.0, 3.0], [1.0, 2.0], [1e30, 0.0, 0.0, 0.0]]
    got = whitening.whitened(table(spark, good).union(table(spark, odd, 100)).union(table(spark, [good[0]], 200))).collect()
    check(got, [*good, good[0]], [*range(50), 200])
    with_null = table(spark, good).selectExpr("nullif(vec_id, 3) as vec_id", "embedding")
    assert whitening.whitened(with_null).where("vec_id is null").count() == 4


def test_no_variance_and_no_rows(spark):
    assert whitening.whitened(table(spark, [[1.0, 2.0]] * 5)).count() == 0
    assert whitening.whitened(table(spark, [])).count() == 0 and whitening.whitened(table(spark, [None])).columns[0] == "vec_id"
    line = [[float(i), float(i), 3.0] for i in range(20)]
    got = whitening.whitened(table(spark, line)).collect()
    assert {r.component for r in got} == {1} and got[0].explained == pytest.approx(1) and got[0].identity_error < 1e-10


def test_deviations_are_exact_and_null_beyond_a_long():
    x = np.array([[1 << 40, 3], [5, -7]])
    want = [(2 * (1 << 40) - 11) ** 2 + (6 - 4) ** 2, (10 - 11) ** 2 + (-14 - 4) ** 2]
    assert whitening.deviations(x, 2, [11, 4]) == [None, want[1]] and want[0] >= 1 << 63
    small = np.array([[1 << 29, 3], [5, -7]])
    assert whitening.deviations(small, 2, [11, 4]) == [(2 * (1 << 29) - 11) ** 2 + 4, want[1]]
