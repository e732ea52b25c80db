"""Whitening: FEAST against a dense solver, the query against brute force, odd tables."""

import math

import numpy as np
import pytest

from tessera.llm.whitening import count_above, deviations, feast, interval_of, largest_components, tridiagonal, whiten


def spectrum(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return (q * values) @ q.T


def test_inertia_counts_match_eigenvalues():
    a = spectrum([5, 3, 3, 1, 0, -2])
    d, e = tridiagonal(a)
    for shift in (-3, -1, 0.5, 2, 2.999, 3.001, 4, 6):
        assert count_above(d, e, shift) == (np.linalg.eigvalsh(a) > shift).sum()
    assert interval_of(d / 10, e / 10, 2, 1.0)[2] == 3  # the equal ones stay together


@pytest.mark.parametrize("values", [[9, 7, 5, 3, 1, .5], [4, 4, 4, 4, 4, 1], [1, 1, 1, 1, 1, 1], [9, 5, 0, 0, 0, 0], [1e6, 1, 1e-3, 1e-5, 1e-7, 0], list(np.linspace(1, 2, 40))])
def test_components_match_a_dense_solver(values):
    v = spectrum(values)
    got, vectors = largest_components(v, 4)
    want = np.sort(values)[::-1][:4]
    want = want[want > 1e-12 * max(values)]
    assert got == pytest.approx(want, rel=1e-9, abs=1e-14 * max(values))
    assert vectors.T @ vectors == pytest.approx(np.eye(len(got)), abs=1e-10)
    assert np.abs(v @ vectors - vectors * got).max() < 1e-12 * max(values)


def test_feast_reports_missing_pairs():
    with pytest.raises(ArithmeticError):
        feast(np.diag([1.0, 2.0, 3.0]), 0.5, 3.5, 2)


def brute(rows):
    kept = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    xs = [list(t) for t in {tuple(x) for _, x in kept}]
    n, s = len(xs), [sum(c) for c in zip(*xs)]
    z = np.array(xs, float) - np.array(s) / n
    values, vectors = np.linalg.eigh(z.T @ z / n)
    out = {}
    for i, x in kept:
        dev = sum((n * a - b) ** 2 for a, b in zip(x, s))
        for c in range(4):
            w = ((np.array(x) - np.array(s) / n) @ vectors[:, -1 - c]) / math.sqrt(values[-1 - c])
            out.setdefault((i, c + 1), []).append((n, dev, abs(w), values[-1 - c] / values.sum()))
    return out


def test_query_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    scale = np.array([1.0, .8, .6, .45, .2, .1, .05, .01])
    rows = [(i, (rng.standard_normal(8) * scale + 3).astype(np.float32).tolist()) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 420)]  # copies weigh once
    rows += [(1, rows[5][1]), (None, rows[6][1]), (500, None), (501, [None] + rows[0][1][1:]), (502, [float("nan")] + rows[0][1][1:]), (503, [float("inf")] + rows[0][1][1:])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, n int").repartition(4)
    got, want = {}, brute(rows)
    out = whiten(df).collect()
    for r in out:
        got.setdefault((r.vec_id, r.component), []).append((r.n, r.deviation, abs(r.whitened), r.explained))
    assert got.keys() == want.keys()
    for k in want:
        for a, b in zip(sorted(got[k]), sorted(want[k])):
            assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], rel=1e-7, abs=1e-9)
    assert {r.identity_error for r in out} == {out[0].identity_error} and out[0].identity_error < 1e-8
    signs = {}
    for r in out:  # one sign per component: equal vectors, equal values
        assert signs.setdefault((r.deviation, r.component), r.whitened) == pytest.approx(r.whitened)


def test_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whiten(spark.createDataFrame([], schema)).count() == 0
    assert whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0  # one distinct vector
    two = whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [3.0])], schema)).collect()  # a short one ends in zeros
    assert sorted((r.vec_id, r.component) for r in two) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 2)]
    huge = whiten(spark.createDataFrame([(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [1.0, 1.0])], schema)).collect()
    assert len(huge) and {r.deviation for r in huge if r.vec_id < 3} == {None}


def test_deviations_are_exact():
    x = np.array([[3, 2 ** 30], [-5, 7]])
    assert deviations(x, 1000, [10, 20]) == [(3000 - 10) ** 2 + (1000 * 2 ** 30 - 20) ** 2 if (1000 * 2 ** 30) ** 2 < 2 ** 63 else None, 5010 ** 2 + 6980 ** 2]
