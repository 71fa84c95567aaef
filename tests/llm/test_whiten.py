"""Whitening against numpy and exact fractions."""

from fractions import Fraction

import numpy as np
import pytest

from quirework.llm import whiten

SCHEMA = "vec_id long, embedding array<float>, label int, x string, key int"


def scaled(rows):
    return np.array([[int(np.floor(1024 * float(e))) + 100_000 for e in v] for v in rows], object)


def test_jacobi_keeps_small_eigenvalues():
    rng = np.random.default_rng(1)
    for d in (1, 2, 5, 24):
        a = rng.normal(size=(d, 3 * d))
        scale = 10.0 ** -np.arange(d)
        m = (a @ a.T) * scale[:, None] * scale[None]
        values, basis = whiten.jacobi(m)
        assert (np.diff(values) <= 0).all()
        assert np.allclose(basis.T @ basis, np.eye(d), atol=1e-13)
        # A graded matrix: each eigenvalue is right to many digits of its own size, as rescaling shows.
        product = np.linalg.det(m / scale[:, None] / scale[None])
        assert np.isclose(np.prod(values / scale**2), product, rtol=1e-9)
    values, basis = whiten.jacobi(np.array([[2.0, 1.0], [1.0, 2.0]]))
    assert np.allclose(values, [3, 1])


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(4)
    basis = rng.normal(size=(12, 12))
    vectors = (rng.normal(size=(300, 12)) * 0.8 ** np.arange(12)) @ basis * 0.1 + 0.05
    vectors = vectors.astype(np.float32)
    rows = [(k, v.tolist(), k % 3, "x", k) for k, v in enumerate(vectors)]
    odd = [(None, rows[0][1], 0, "x", 1), (5, rows[1][1], 0, "x", 1), (900, None, 0, "x", 1), (901, [], 0, "x", 1), (902, [None] + rows[0][1][1:], 0, "x", 1), (903, [float("nan")] + rows[0][1][1:], 0, "x", 1), (904, [float("inf")] + rows[0][1][1:], 0, "x", 1), (905, [1.0, 2.0], 0, "x", 1)]
    kept = np.concatenate([vectors, vectors[:2]])
    return spark.createDataFrame(rows + odd, SCHEMA).repartition(3), kept, [*range(300), None, 5]


def test_whitened_rows(made):
    df, kept, ids = made
    out = whiten.whiten(df).collect()
    x = scaled(kept)
    n, sums = len(x), x.sum(0)
    exact = np.array([[Fraction(int(v)) - Fraction(int(s), n) for v, s in zip(row, sums, strict=True)] for row in x])
    cov = np.array((exact.T @ exact) / n, np.float64)
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1], basis[:, ::-1]
    assert len(out) == n * 8 and {r.n for r in out} == {n}
    deviation = {}
    for k, row in zip(ids, x, strict=True):
        deviation.setdefault(k, set()).add(int(((row * n - sums) ** 2).sum()))
    for r in out:
        assert r.deviation in deviation[r.vec_id]
        assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-9 * r.explained
    by_place = {}
    for r in out:
        by_place.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
    plain = np.array(exact, np.float64) @ (basis[:, :8] / np.sqrt(values[:8]))
    for c in range(8):
        got = np.array([by_place[k, int(((row * n - sums) ** 2).sum())][c + 1][0] for k, row in zip(ids, x, strict=True)])
        sign = np.sign((got * plain[:, c]).sum())
        assert np.allclose(got, sign * plain[:, c], atol=1e-8)
    assert len({r.identity_error for r in out}) == 1 and 0 <= out[0].identity_error < 1e-9


def test_other_partitions_agree(made):
    df, _, _ = made
    key = lambda r: (r.vec_id is None, r.vec_id or 0, r.deviation, r.component)
    a, b = (sorted(whiten.whiten(x).collect(), key=key) for x in (df.repartition(1), df.repartition(7)))
    assert [(r.vec_id, r.component, r.deviation, r.whitened, r.explained) for r in a] == [(r.vec_id, r.component, r.deviation, r.whitened, r.explained) for r in b]


def test_degenerate_tables(spark, made):
    df, _, _ = made
    assert whiten.whiten(df.limit(0)).count() == 0
    assert whiten.whiten(df.where("embedding is null")).count() == 0
    one = whiten.whiten(df.where("vec_id = 7")).collect()
    assert len(one) == 8 and all(r.whitened is None and r.deviation == 0 for r in one)
    flat = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [3.0, 0.0])], "vec_id long, embedding array<double>")
    rows = whiten.whiten(flat).collect()
    assert {r.component for r in rows} == {1, 2}
    assert [r.whitened is None for r in sorted(rows, key=lambda r: r.component)] == [False] * 3 + [True] * 3
    assert {round(r.explained, 9) for r in rows} == {0.0, 1.0}
    huge = spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.5, 3.0])], "vec_id long, embedding array<double>")
    rows = whiten.whiten(huge).collect()
    assert len(rows) == 6 and rows[0].identity_error < 1e-4
