"""Whitening against numpy's eigenvectors and exact integers."""

import math
from fractions import Fraction

import numpy as np
import pytest
from oracle import SF
from pyspark.sql import functions as F

from meridex.llm import whitening as wh


def brute(vectors):
    """Whole-numbered rows, the distinct ones, and eigenvalues and -vectors of their covariance by another method."""
    x = [[max(min(math.floor(256 * float(c)), 2**63 - 1), -(2**63)) for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, s = len(fit), [sum(col) for col in zip(*fit)]
    centred = np.array([[(n * v - t) / n for v, t in zip(row, s)] for row in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return x, n, s, values[::-1], vectors[:, ::-1]


def test_query_against_brute_force(spark):
    rows = wh.op13_whitening(spark, SF).collect()
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    x, n, s, values, components = brute(vectors.values())
    x = dict(zip(vectors, x))
    assert len(rows) == 4 * len(vectors) and len({(r.vec_id, r.component) for r in rows}) == len(rows)
    signs = {}
    for r in rows:
        k = r.component - 1
        assert r.n == n and r.deviation == sum((n * v - t) ** 2 for v, t in zip(x[r.vec_id], s))
        assert math.isclose(r.explained, values[k] / values.sum(), rel_tol=1e-9) and 0 <= r.identity_error < 1e-10
        want = float((np.array(x[r.vec_id]) - np.array(s) / n) @ components[:, k] / math.sqrt(values[k]))
        if abs(want) > 1e-6:
            assert signs.setdefault(k, math.copysign(1, want * r.whitened)) == math.copysign(1, want * r.whitened)
        assert math.isclose(abs(want), abs(r.whitened), rel_tol=1e-7, abs_tol=1e-9)


def determinant(m):
    if not m:
        return 1
    return m[0][0] * determinant([[a - row[0] * b / m[0][0] for a, b in zip(row[1:], m[0][1:])] for row in m[1:]])


def made(rows, spark, extra="vec_id long, embedding array<double>"):
    return spark.createDataFrame(rows, extra)


def test_rows_that_go_and_copies(spark):
    rows = [(1, [1.0, 2.0, -0.0]), (1, [1.0, 2.0, 0.0]), (2, None), (3, [1.0, None, 2.0]), (4, [math.nan, 1.0, 1.0]), (5, [math.inf, 1.0, 1.0]), (6, [3.0, -1.0, 0.5]), (None, [0.001, 0.0039, -0.0001]), (7, [1.0]), (8, [])]
    found, model, error = wh.whiten(made(rows, spark))
    assert sorted(str(r.vec_id) for r in found.collect()) == ["1", "1", "6", "None"]
    assert model.n == 3 and len(model.eigenvalues) == 2 and error < 1e-12  # three points span two dimensions
    x, n, s, values, _ = brute([r[1] for r in rows if r[0] in (1, 6, None) and r[1]])
    assert np.allclose(model.eigenvalues, values[:2], rtol=1e-12)
    assert x[-1] == [0, 0, -1]


def test_few_rows_and_empty(spark):
    for rows in ([], [(1, None)], [(1, [])], [(1, [2.0, 3.0])], [(1, [2.0, 3.0]), (2, [2.0, 3.0])]):
        found, model, _ = wh.whiten(made(rows, spark))
        assert found.count() == 0 and model is None


def test_large_and_uneven_entries(spark):
    """Means far above spreads, spreads of ten orders, constant dimensions, entries beyond the range of a long."""
    rnd = np.random.default_rng(3)
    v = rnd.normal(size=(300, 6)) * [1e3, 1e4, 1e9, 1, 0, 2] + [1e12, 0, 5, -1e10, 7, 0]
    rows = [(k, r.tolist()) for k, r in enumerate(v)]
    found, model, error = wh.whiten(made(rows, spark), components=5)
    x, n, s, values, _ = brute(v)
    assert len(model.eigenvalues) == 5 and np.allclose(model.eigenvalues[:2], values[:2], rtol=1e-6) and error < 1e-4
    rows = [[n * row[k] - s[k] for k in (0, 1, 2, 3, 5)] for row in set(map(tuple, x))]
    exact = determinant([[Fraction(sum(r[i] * r[j] for r in rows), n**3) for j in range(5)] for i in range(5)])
    assert math.isclose(np.prod(model.eigenvalues), exact, rel_tol=1e-9)
    for r in found.collect():
        want = sum((n * a - b) ** 2 for a, b in zip(x[r.vec_id], s))
        assert r.whitened.deviation == (want if want < 2**63 else None)
    found, model, _ = wh.whiten(made([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 3.0])], spark))
    assert model.n == 3 and found.count() == 3


def test_result_does_not_depend_on_partitions(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    models = [wh.whiten(df.repartition(k).select("vec_id", "embedding"))[1] for k in (1, 7)]
    assert np.array_equal(models[0].components, models[1].components) and np.array_equal(models[0].eigenvalues, models[1].eigenvalues)


def test_columns_stay(spark):
    df = made([(1, [1.0, 0.0], "a"), (2, [0.0, 2.0], None)], spark, "whole long, embedding array<double>, whitened string")
    found, _, _ = wh.whiten(df)
    assert found.columns == ["whole", "embedding", "whitened"] and {r.whole for r in found.collect()} == {1, 2}


@pytest.mark.parametrize("shape,rank", [((5, 5), 5), ((8, 3), 3), ((40, 64), 40), ((1, 4), 1)])
def test_factor_and_rotations(shape, rank):
    rows = np.random.default_rng(1).normal(size=shape) * np.logspace(0, -3, shape[1])
    a = rows.T @ rows
    left = wh.pivoted_cholesky(a)
    assert left.shape[1] == min(rank, shape[1]) and np.allclose(left @ left.T, a, atol=1e-13)
    values, vectors = wh.one_sided_jacobi(left)
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12) and (np.diff(values) <= 0).all()
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][: len(values)], atol=1e-12) and np.allclose(vectors * values @ vectors.T, a, atol=1e-12)


def test_small_eigenvalues_keep_their_digits():
    """Graded scatter: eigenvalues of fifteen orders, which a plain eigen solver would round off."""
    scale = np.logspace(0, -7.5, 6)
    core = np.eye(6) + 0.3
    values, _ = wh.one_sided_jacobi(np.linalg.cholesky(core) * scale[:, None])
    exact = np.linalg.eigvalsh(core * np.outer(scale, scale) * 1.0)[::-1]
    assert abs(values[0] / exact[0] - 1) < 1e-14 and values.min() > 0
    assert math.isclose(np.prod(values), np.linalg.det(core) * np.prod(scale) ** 2, rel_tol=1e-10)
