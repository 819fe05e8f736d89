"""Rotations against the library's eigenvalues, whole numbers against plain ones."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest
from tessera.llm import op13_whitening as wh

SCHEMA = "vec_id long, embedding array<float>, k string, x int, component int, at int, whitened string, label int"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(k, v, "a", 1, 2, 3, "b", 4) for k, v in rows], SCHEMA).repartition(parts)


def spread(n, d, seed=0):
    """Rows of d components whose variances fall by large factors."""
    rng = np.random.default_rng(seed)
    turn, _ = np.linalg.qr(rng.normal(size=(d, d)))
    return (rng.normal(size=(n, d)) * 2.5 ** -np.arange(d) * 50) @ turn + rng.normal(size=d)


@pytest.mark.parametrize("d", [1, 2, 3, 8, 17, 64])
def test_jacobi_as_library(d):
    rng = np.random.default_rng(d)
    root = rng.normal(size=(d, d + 2))
    a = root @ root.T
    values, axes = wh.jacobi(a)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=1e-11)
    assert np.allclose(axes.T @ axes, np.eye(d), atol=1e-12)
    assert np.allclose(axes * values @ axes.T, a, atol=1e-11 * values[0])


def test_jacobi_of_odd_matrices():
    for a in (np.zeros((4, 4)), np.eye(5), np.diag([3.0, 0.0, 2.0]), np.ones((6, 6))):
        values, axes = wh.jacobi(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-13) and np.allclose(axes.T @ axes, np.eye(len(a)), atol=1e-12)


def test_small_eigenvalues_are_accurate():
    """A matrix scaled by 1e-8 in places: eigenvalues keep their digits relative to themselves."""
    scale = np.diag(10.0 ** -np.arange(0, 12, 2))
    core = np.array([[1.0 if i == j else 0.3 / (1 + abs(i - j)) for j in range(6)] for i in range(6)])
    a = scale @ core @ scale
    values, _ = wh.jacobi(a)
    exact = [[Fraction(float(c)) for c in row] for row in a]

    def sign(at):
        """Of the determinant of a - at I, in fractions."""
        m, up = [[c - (at if i == j else 0) for j, c in enumerate(row)] for i, row in enumerate(exact)], True
        for k in range(6):
            up = up == (m[k][k] > 0)
            for i in range(k + 1, 6):
                f = m[i][k] / m[k][k]
                m[i] = [x - f * y for x, y in zip(m[i], m[k], strict=True)]
        return up

    for v in values:
        assert sign(Fraction(float(v)) * (1 - Fraction(1, 10**12))) != sign(Fraction(float(v)) * (1 + Fraction(1, 10**12)))


@pytest.mark.parametrize("parts", [1, 7])
def test_report_as_plain(spark, parts):
    v = spread(300, 10).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    out = wh.report(table(spark, rows, parts))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    x = np.floor(v.astype(float) * 1024) + 100000
    s = [int(c) for c in x.sum(0)]
    y = x - x.mean(0)
    cov = y.T @ y / 300
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    got = {}
    for r in out.collect():
        got[r.vec_id, r.component] = r
    assert sorted(got) == [(i, c) for i in range(300) for c in range(1, 9)]
    for c in range(1, 9):
        mine = np.array([got[i, c].whitened for i in range(300)])
        plain = y @ axes[:, c - 1] / math.sqrt(values[c - 1])
        assert min(np.abs(mine - plain).max(), np.abs(mine + plain).max()) < 1e-5
        assert all(abs(got[i, c].explained - values[c - 1] / np.trace(cov)) < 1e-9 * values[c - 1] / np.trace(cov) + 1e-15 for i in range(300))
    for i in range(300):
        assert got[i, 1].deviation == sum((300 * int(a) - b) ** 2 for a, b in zip(x[i], s, strict=True)) and got[i, 1].n == 300
    assert {r.identity_error for r in got.values()} == {got[0, 1].identity_error} and got[0, 1].identity_error < 1e-9


def test_odd_rows(spark):
    v = [(i, x.tolist()) for i, x in enumerate(spread(40, 4, 3))]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0]), (103, [1.0, float("nan"), 2.0, 3.0]), (104, [float("inf"), 1.0, 1.0, 1.0]), (105, [1.0, 2.0]), (None, v[0][1]), (0, v[0][1]), (0, v[1][1])]
    got = wh.report(table(spark, v + odd)).collect()
    keys = [r.vec_id for r in got if r.component == 1]
    assert sorted(map(repr, keys)) == sorted(map(repr, [k for k, _ in v] + [None, 0, 0]))
    assert {r.n for r in got} == {43} and {r.component for r in got} == {1, 2, 3, 4}
    assert wh.report(table(spark, [])).collect() == []
    assert wh.report(table(spark, [(1, None)])).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_rows_without_variance(spark):
    got = wh.report(table(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert len(got) == 4 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.identity_error is None for r in got)
    line = wh.report(table(spark, [(i, [float(i), float(2 * i), 1.0]) for i in range(9)])).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in line)
    first = [r.whitened for r in sorted(line, key=lambda r: r.vec_id) if r.component == 1]
    assert abs(np.mean(np.square(first)) - 1) < 1e-12 and line[0].identity_error < 1e-12


def test_huge_components(spark):
    """Components beyond 2**45 count as that; sums and the scatter stay exact."""
    rows = [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [3.0, 2.0])]
    got = {r.vec_id: r for r in wh.report(table(spark, rows)).collect() if r.component == 1}
    assert all(r.deviation is None for k, r in got.items() if k != 3)
    x = [[wh.MOST + 100000, 100000], [-wh.MOST + 100000, 101024], [103072, 102048]]
    s = [sum(c) for c in zip(*x, strict=True)]
    assert got[3].deviation == sum((3 * a - b) ** 2 for a, b in zip(x[2], s, strict=True))
    assert abs(sum(r.whitened**2 for r in got.values()) / 3 - 1) < 1e-9


def test_exact_product():
    rng = np.random.default_rng(1)
    for most in (3, 1 << 20, 1 << 40):
        y = rng.integers(-most, most, (50, 5))
        wide = y.astype(object)
        assert (wh.exact_product(y) == wide.T.dot(wide)).all()
