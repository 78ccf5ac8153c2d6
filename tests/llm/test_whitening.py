"""Whitening against a dense eigensolver and exact integers."""

from math import floor, isfinite

import numpy as np
import pytest

from sitefold.llm.query_search import op12_whitening
from sitefold.llm.whitening import eigenvectors, polar_factor, whiten

VECTORS = "vec_id long, embedding array<float>, x string, n long, component string"


def random_symmetric(values, seed):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    a = q @ np.diag(values) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize(
    "values",
    [
        [3.0], [1.0, 1.0, 1.0], [0.0, 0.0], [-1.0, 0.0, 1.0], [5.0, 5.0, 2.0, 2.0, 2.0, 1.0],
        list(np.linspace(1, 64, 64)), [1e8] + [1.0] * 20, [1.0, 1 + 1e-12, 2.0, 3.0],
        list(np.random.default_rng(1).random(40)), [0.0] * 10 + [1.0] * 3, [10.0**-k for k in range(16)],
    ],
)
def test_eigenvectors(values):
    a = random_symmetric(np.array(values), 3)
    q = eigenvectors(a)
    size, scale = len(a), max(np.linalg.norm(a), 1e-300)
    assert np.abs(q.T @ q - np.eye(size)).max() < 1e-13
    rest = q.T @ a @ q
    assert np.abs(rest - np.diag(np.diag(rest))).max() <= 2e-14 * size * scale
    assert np.sort(np.diag(rest)) == pytest.approx(np.sort(values), abs=1e-13 * scale)


def test_polar_factor():
    a = random_symmetric(np.array([4.0, 1e-9, -2.0, -1e-3, 7.0]), 5)
    u = polar_factor(a)
    assert np.abs(u @ u - np.eye(5)).max() < 1e-12
    assert np.trace(u) == pytest.approx(1)
    assert np.linalg.eigvalsh(u @ a).min() > -1e-12


def plain(rows, most=4):
    """{(vec_id, component): (n, deviation, |whitened|, explained)} of (vec_id, vector) rows."""
    good = [
        (i, tuple(floor(256 * float(c)) for c in v))
        for i, v in rows
        if v is not None and len(v) and all(c is not None and isfinite(c) for c in v)
    ]
    fit = np.array(sorted({x for _, x in good}), float)
    n, sums = len(fit), [sum(int(v) for v in col) for col in fit.T]
    centred = fit - fit.mean(axis=0)
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    out = []
    for i, x in good:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        for c in range(min(most, len(values))):
            w = (np.array(x) - fit.mean(axis=0)) @ vectors[:, -1 - c] / np.sqrt(values[-1 - c])
            out.append((i, c + 1, n, deviation, w, values[-1 - c] / values.sum()))
    return out, vectors[:, ::-1][:, :most]


def check(out, want):
    assert len(out) == len(want)
    signs = {}
    for got, exact in zip(sorted(out, key=lambda r: r[:2]), sorted(want, key=lambda r: r[:2])):
        assert tuple(got[:4]) == exact[:4]
        sign = signs.setdefault(got[1], 1 if got[4] * exact[4] > 0 or abs(exact[4]) < 1e-6 else -1)
        assert got[4] * sign == pytest.approx(exact[4], abs=1e-8)
        assert got[5] == pytest.approx(exact[5], rel=1e-9)
        assert 0 <= got[6] < 1e-10


def test_query_over_the_whole_table(spark, sf):
    out = op12_whitening(spark, sf)
    assert out.dtypes == [
        ("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"),
        ("whitened", "double"), ("explained", "double"), ("identity_error", "double"),
    ]
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check([tuple(r) for r in out.collect()], plain(rows)[0])


def test_rough_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(0, (3, 1, 0.5, 0.2, 0.1))]) for i in range(60)]
    rows += rows[:20] * 5  # a repeated group counts once in the fit
    bad = [(900, None), (901, []), (902, [1.0, None, 0.0, 0.0, 0.0]), (903, [float("nan")] * 5), (904, [float("inf")] * 5)]
    frame = spark.createDataFrame([(*r, "a", 5, "b") for r in rows + bad], VECTORS).repartition(3)
    out = [tuple(r) for r in whiten(frame).collect()]
    check(out, plain(rows)[0])


def test_lengths_ties_and_nothing(spark):
    pairs = [(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, -1.0])]
    line = [(5, [1.0, 2.0, 3.0]), (6, [2.0, 4.0, 6.0]), (None, [3.0, 6.0, 9.0])]
    same = [(7, [1.0] * 4), (8, [1.0] * 4)]
    out = whiten(spark.createDataFrame([(*r, "a", 5, "b") for r in pairs + line + same], VECTORS)).collect()
    # Two equal components; one component of a line; none where nothing varies.
    by_id = {}
    for r in out:
        by_id.setdefault(r.vec_id, []).append(r)
    assert {i: len(r) for i, r in by_id.items()} == {1: 2, 2: 2, 3: 2, 4: 2, 5: 1, 6: 1, None: 1}
    for i in (1, 2, 3, 4):
        assert sum(r.whitened**2 for r in by_id[i]) == pytest.approx(2)
        assert by_id[i][0].explained == pytest.approx(0.5)
    assert by_id[5][0].explained == pytest.approx(1)
    assert by_id[6][0].whitened == pytest.approx(0, abs=1e-12)
    assert all(r.identity_error < 1e-12 for r in out)
    assert whiten(spark.createDataFrame([], VECTORS)).count() == 0


def test_huge_entries(spark):
    rows = [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [5.0, 2.0])]
    out = whiten(spark.createDataFrame([(*r, "a", 5, "b") for r in rows], VECTORS)).collect()
    assert {r.vec_id for r in out} == {1, 2, 3}
    assert all(r.deviation is None for r in out if r.vec_id != 3)
