"""Whitening against exact rational arithmetic and against numpy, and its edges."""

from fractions import Fraction

import numpy as np
import pytest

from sparkledger.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, component string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, "x") for i, v in enumerate(vectors)], SCHEMA).repartition(3)


def test_products_are_exact():
    rng = np.random.default_rng(5)
    c = rng.normal(size=(700, 3)) * np.array([1e-9, 1.0, 1e12])
    hi, lo = W.gram(c, np.zeros((3, 3)), np.zeros((3, 3)))
    for i in range(3):
        for j in range(3):
            want = sum(Fraction(a) * Fraction(b) for a, b in zip(c[:, i], c[:, j]))
            size = sum(abs(Fraction(a) * Fraction(b)) for a, b in zip(c[:, i], c[:, j]))
            assert abs(Fraction(hi[i, j]) + Fraction(lo[i, j]) - want) <= size * Fraction(1, 2**95)


def test_against_exact_sums(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(400, 40)) * np.linspace(0.2, 3, 40)).astype(np.float32)
    rows = W.whiten(frame(spark, vectors.tolist())).collect()
    assert len(rows) == 400 * 32
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]
    s = [sum(col) for col in zip(*x)]
    d = np.array([[400 * a - b for a, b in zip(v, s)] for v in x])
    cov = (d.T @ d) / 400.0**3  # whole numbers below 2^53: exact but for the division
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1], q[:, ::-1]
    got = np.zeros((400, 32))
    for r in rows:
        got[r.vec_id, r.component - 1] = r.whitened
        assert r.n == 400 and r.deviation == int((d[r.vec_id].astype(object) ** 2).sum())
        assert abs(r.explained - e[r.component - 1] / e.sum()) < 1e-12 and r.identity_error < 1e-9
    want = (d / 400.0) @ q[:, :32] / np.sqrt(e[:32])
    assert np.abs(np.abs(got) - np.abs(want)).max() < 1e-8
    assert np.abs(got.T @ got / 400 - np.eye(32)).max() < 1e-9


def test_edges(spark):
    base = [[1.0, 2.0, 0.5], [0.0, 1.0, 0.5], [2.0, -1.0, 0.5], [1.0, 2.0, 0.5]]
    odd = [None, [], [1.0], [float("nan"), 1.0, 1.0], [float("inf"), 0.0, 0.0], [None, 1.0, 1.0]]
    rows = W.whiten(frame(spark, base + odd)).collect()
    assert sorted({r.vec_id for r in rows}) == [0, 1, 2, 3] and len(rows) == 12
    flat = {r.component: r for r in rows if r.vec_id == 0}
    assert flat[3].whitened is None and flat[3].explained == 0 and flat[1].whitened is not None
    by = {(r.vec_id, r.component): r.whitened for r in rows}
    assert by[0, 1] == by[3, 1] and flat[1].n == 4 and flat[1].identity_error < 1e-12
    same = W.whiten(frame(spark, [[1.0, 2.0]] * 5)).collect()
    assert len(same) == 10 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in same)
    assert W.whiten(frame(spark, base).limit(0)).count() == 0
    assert W.whiten(frame(spark, [None, []])).count() == 0
    ids = spark.createDataFrame([(None, [1.0, 2.0]), (7, [2.0, 1.0]), (7, [2.0, 1.5])], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id is None, r.component) for r in W.whiten(ids).collect()) == [(False, 1)] * 2 + [(False, 2)] * 2 + [(True, 1), (True, 2)]
    with pytest.raises(Exception, match="counted exactly"):
        W.whiten(frame(spark, [[1e20, 1.0], [2.0, 1.0]])).collect()
