"""Whitening against dense eigenvectors, and the parts of the contour method one by one."""

import numpy as np
import pytest

from tidemark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n string, w string, v string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y", "z") for i, v in rows], SCHEMA).repartition(3)


def vectors(n, d, seed=0, spread=None):
    rng = np.random.default_rng(seed)
    scale = np.linspace(2, 0.3, d) if spread is None else spread
    x = (rng.standard_normal((n, d)) * scale) @ np.linalg.qr(rng.standard_normal((d, d)))[0]
    return [(i, [float(np.float32(c)) for c in row]) for i, row in enumerate(x)]


def check(spark, rows, kept):
    """Compare with numpy's dense solver; ``kept`` are the rows that remain."""
    got = whitening.whiten(frame(spark, rows)).collect()
    x = np.floor(1024 * np.array([v for _, v in kept])).astype(np.int64) + 100_000
    n, d = x.shape
    y = x - x.sum(axis=0) / n
    cov = y.T @ y / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:8], u[:, ::-1][:, :8]
    assert len(got) == n and {len(r.w) for r in got} == {min(d, 8)}
    got = sorted(got, key=lambda r: (str(r.vec_id), r.deviation_exact))
    order = sorted(range(n), key=lambda i: (str(kept[i][0]), sum((n * int(c) - int(s)) ** 2 for c, s in zip(x[i], x.sum(axis=0)))))
    assert [r.vec_id for r in got] == [kept[i][0] for i in order]
    for r, i in zip(got, order):
        exact = sum((n * int(c) - int(s)) ** 2 for c, s in zip(x[i], x.sum(axis=0)))
        assert r.n == n and int(r.deviation_exact) == exact and r.deviation == (exact if exact < 1 << 63 else None)
    np.testing.assert_allclose(got[0]["values"], e, rtol=1e-10)
    np.testing.assert_allclose(got[0].explained, e / np.trace(cov), rtol=1e-10)
    w = np.array([r.w for r in got])
    want = (y[order] @ u) / np.sqrt(e)
    signs = np.sign((w * want).sum(axis=0))
    np.testing.assert_allclose(w * signs, want, atol=1e-7)
    assert got[0].identity_error < 1e-9 and len({r.identity_error for r in got}) == 1


def test_dense_solver_agrees(spark):
    check(spark, rows := vectors(300, 24), rows)


def test_rows_that_cannot_be_fitted_are_dropped(spark):
    rows = vectors(120, 10, seed=2)
    rows[5:8] = [(5, rows[5][1]), (5, rows[5][1]), (None, rows[7][1])]
    odd = [(900, None), (901, [None] * 10), (902, [float("nan")] + [0.0] * 9), (903, [0.0] * 9 + [float("-inf")]), (904, [1.0, 2.0]), (905, [])]
    check(spark, odd[:3] + rows + odd[3:], rows)


def test_fewer_dimensions_than_components(spark):
    check(spark, rows := vectors(50, 3, seed=3), rows)


def test_deviations_beyond_long(spark):
    check(spark, rows := vectors(40, 5, seed=4, spread=np.array([9e9, 5e9, 1e9, 7e8, 3e8])), rows)
    x = np.array([[LARGE := whitening.LARGEST, -LARGE], [3, 4]])
    assert whitening._deviations(x, 2, [LARGE + 3, 4 - LARGE]) == [2 * (LARGE - 3) ** 2 + 14 * (LARGE - 3) + 49, 2 * (LARGE - 3) ** 2 + 14 * (LARGE - 3) + 49]


def test_no_variance_and_no_rows(spark):
    got = whitening.whiten(frame(spark, [(1, [1.0, 2.0])] * 4)).collect()
    assert [(r.vec_id, r.n, r.deviation, r.w, r.explained, r.identity_error) for r in got] == [(1, 4, 0, [None, None], [None, None], None)] * 4
    flat = [(i, [float(i % 5), 1.0, 2.0]) for i in range(20)]
    got = whitening.whiten(frame(spark, flat)).collect()
    assert {tuple(x is None for x in r.w) for r in got} == {(False, True, True)} and got[0].identity_error < 1e-12
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None), (2, [])])).count() == 0


def test_inertia_counts():
    rng = np.random.default_rng(5)
    for d in (1, 2, 3, 17):
        a = rng.standard_normal((d, d))
        a = a + a.T
        t, e = whitening.tridiagonal(a), np.linalg.eigvalsh(a)
        for s in [*np.linspace(e[0] - 1, e[-1] + 1, 41), *(e + 1e-9), *(e - 1e-9)]:
            assert whitening.below(t, s) == (e < s).sum()
    assert whitening.below(whitening.tridiagonal(np.diag([1.0, 1.0, 3.0])), 2.0) == 2


@pytest.mark.parametrize(
    "e",
    [
        [9.0] * 12 + [1.0] * 8,  # more equal eigenvalues than components
        [5.0, 5.0, 5.0, 4.0, 4.0, 3.0, 2.0, 1.0, 0.5, 0.0, 0.0],
        list(1 + 1e-6 * np.arange(30)),
        [1e12, 1e6, 1.0, 1e-3, 1e-3, 1e-4, 0, 0, 0, 0],
        list(np.linspace(1, 2, 60)),
    ],
)
def test_hard_spectra(spark, e):
    rng = np.random.default_rng(6)
    e = np.array(e)
    q = np.linalg.qr(rng.standard_normal((len(e), len(e))))[0]
    v = (q * e) @ q.T
    v = (v + v.T) / 2
    values, basis = whitening.feast(spark, v, 8)
    norm = np.abs(e).max()
    np.testing.assert_allclose(values, np.sort(e)[::-1][:8], atol=1e-13 * norm)
    np.testing.assert_allclose(basis.T @ basis, np.eye(8), atol=1e-12)
    assert np.linalg.norm(v @ basis - basis * values, axis=0).max() < 1e-12 * norm


def test_intervals_hold_the_largest_and_nothing_twice():
    rng = np.random.default_rng(7)
    a = rng.standard_normal((40, 40))
    a = a @ a.T
    t, e = whitening.tridiagonal(a), np.linalg.eigvalsh(a)
    found = whitening.intervals(t, 8, float(np.abs(a).sum(axis=1).max()))
    assert sum(c for *_, c in found) >= 8 and all(c <= whitening.PER_INTERVAL for *_, c in found)
    assert [c for *_, c in found] == [int(((e > low) & (e < high)).sum()) for low, high, _ in found]
    assert all(low >= higher_high or high <= higher_low for (low, high, _), (higher_low, higher_high, _) in zip(found[1:], found))
