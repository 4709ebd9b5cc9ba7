"""Whitening against numpy's eigenvectors, exact counts against Python integers, and odd vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from effnum.llm import whitening as w


@pytest.mark.parametrize("d", [1, 2, 3, 5, 17, 64])
def test_eigenvectors(d):
    rng = np.random.default_rng(d)
    x = rng.normal(size=(300, d)) * np.geomspace(1, 50, d)
    v = np.cov(x.T, bias=True).reshape(d, d)
    values, vectors = w.components(v, 16)
    true = np.linalg.eigvalsh(v)[::-1][: min(16, d)]
    assert np.allclose(values, true, rtol=1e-11)
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    assert np.abs(v @ vectors - vectors * values).max() < 1e-12 * values[0] * d


def test_equal_and_vanishing_eigenvalues():
    values, vectors = w.components(np.eye(20) * 3, 16)
    assert np.allclose(values, 3) and np.abs(vectors.T @ vectors - np.eye(16)).max() < 1e-12
    one = np.ones((6, 6))
    values, vectors = w.components(one, 16)
    assert np.allclose(values, [6]) and np.allclose(np.abs(vectors[:, 0]), 1 / math.sqrt(6))
    assert len(w.components(np.zeros((4, 4)))[0]) == 0
    blocks = np.kron(np.eye(4), np.array([[2.0, 1.0], [1.0, 2.0]]))  # 3 and 1, four times each
    values, vectors = w.components(blocks, 16)
    assert np.allclose(values, [3] * 4 + [1] * 4)
    assert np.abs(vectors.T @ vectors - np.eye(8)).max() < 1e-12 and np.abs(blocks @ vectors - vectors * values).max() < 1e-12


def test_sturm_counts():
    rng = np.random.default_rng(1)
    d, e = rng.normal(size=9), rng.normal(size=8)
    true = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    at = np.linspace(-4, 4, 41)
    assert (w.sturm(d, e, at) == (true[None, :] < at[:, None]).sum(1)).all()
    assert np.allclose(w.leading(d, e, 4), true[::-1][:4], atol=1e-13)


def plain(rows):
    """vec_id, component, n, deviation, |whitened|, explained by their definitions."""
    x = [(k, [math.floor(64 * float(c)) + 1000000 for c in v]) for k, v in rows]
    fit = sorted({tuple(v) for _, v in x})
    n, d = len(fit), len(fit[0])
    s = [sum(v[i] for v in fit) for i in range(d)]
    z = np.array([[float(n * v[i] - s[i]) / n for i in range(d)] for v in fit])
    e, q = np.linalg.eigh(z.T @ z / n)
    e, q = e[::-1], q[:, ::-1]
    out = []
    for k, v in x:
        dev = sum((n * v[i] - s[i]) ** 2 for i in range(d))
        c = np.array([float(n * v[i] - s[i]) / n for i in range(d)])
        for j in range(min(16, d)):
            if e[j] > w.LEAST * e.sum():
                out.append((k, j + 1, n, dev, abs(c @ q[:, j]) / math.sqrt(e[j]), e[j] / e.sum()))
    return out


def table(spark, rows):
    return spark.createDataFrame([(k, v, 5, "y") for k, v in rows], "vec_id long, embedding array<float>, id int, x string").repartition(3)


def agree(got, rows):
    got = sorted((r.vec_id if r.vec_id is not None else -1, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in got)
    want = sorted((k if k is not None else -1, *rest) for k, *rest in plain(rows))
    assert [g[:4] for g in got] == [x[:4] for x in want]
    assert np.allclose([g[4:] for g in got], [x[4:] for x in want], rtol=1e-9, atol=1e-9)


def test_against_definition(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(size=20) * np.geomspace(0.1, 4, 20)]) for i in range(150)]
    rows += [(500, rows[0][1]), (0, rows[0][1]), (0, rows[7][1]), (None, rows[8][1])]  # copies, one id twice, no id
    odd = [(900, None), (901, [None] + [1.0] * 19), (902, [math.nan] * 20), (903, [math.inf] * 20), (904, [])]
    got = w.digest(table(spark, rows + odd)).collect()
    agree(got, rows)
    assert max(r.identity_error for r in got) < 1e-9 and len({r.identity_error for r in got}) == 1
    signs = {}  # one sign for all rows: whitened coordinates of the fit list are uncorrelated
    for r in got:
        signs.setdefault(r.component, {})[r.vec_id] = r.whitened
    a, b = (np.array([signs[j][i] for i in range(1, 150)]) for j in (1, 2))
    assert abs(np.corrcoef(a, b)[0, 1]) < 0.05


def test_few_and_constant(spark):
    same = [(i, [0.5, 0.25]) for i in range(5)]
    assert w.digest(table(spark, same)).count() == 0  # one distinct vector has no variance
    flat = [(i, [float(i), 1.0, 2.0 * i]) for i in range(10)]  # rank one
    got = w.digest(table(spark, flat)).collect()
    assert {r.component for r in got} == {1}
    agree(got, flat)
    assert w.digest(table(spark, flat).limit(0)).count() == 0


def test_lengths_and_rounds(spark, monkeypatch):
    rng = np.random.default_rng(4)
    two = [(i, [float(c) for c in rng.normal(size=2)]) for i in range(40)]
    five = [(100 + i, [float(c) for c in rng.normal(size=5)]) for i in range(40)]
    for bound in (w.SENT, 1):  # all lengths at once, or a round each
        monkeypatch.setattr(w, "SENT", bound)
        monkeypatch.setattr(w, "HELD", bound)
        got = w.digest(table(spark, two + five)).collect()
        agree([r for r in got if r.vec_id < 100], two)
        agree([r for r in got if r.vec_id >= 100], five)


def test_huge_entries(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.normal(size=3)]) for i in range(30)] + [(77, [1e9, 0.0, 1.0]), (78, [3e38, 1.0, 0.0])]
    got = w.digest(table(spark, rows)).collect()
    assert {r.vec_id for r in got} == {*range(30), 77, 78}
    assert all(r.deviation is None for r in got if r.vec_id == 78)
    assert all(np.isfinite(r.whitened) for r in got)
    table_of_x = w.integer_vectors(table(spark, rows)).collect()
    assert max(max(r.x) for r in table_of_x) == (1 << 63) - 1


def test_count_is_exact(spark):
    x = np.array([[(1 << 61), -(1 << 61)], [5, 7]], np.int64)
    n, total = 6, np.array([123456789012345678901, -5], object)
    z = w._centred(x, n, total)
    assert z.tolist() == [[6 * (1 << 61) - 123456789012345678901, -6 * (1 << 61) + 5], [30 - 123456789012345678901, 47]]
    assert spark.range(1).select(F.lit(1)).count() == 1
