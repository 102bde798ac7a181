"""Whitening against NumPy's symmetric eigensolver and whole-number sums."""

import numpy as np
import pytest

from ridgeline.llm import whitening as W
from ridgeline.llm.common import shared_folder


def matrices():
    rng = np.random.default_rng(5)
    yield rng.standard_normal((40, 12))
    yield rng.standard_normal((40, 30)) * np.logspace(0, -7, 30)
    yield np.repeat(rng.standard_normal((30, 4)), 2, axis=1)
    yield np.vstack([np.eye(9), -np.eye(9)])
    yield np.diag(np.r_[np.ones(5), 2 * np.ones(5), 1e-5, 0.0])
    yield rng.standard_normal((3, 8))
    yield np.zeros((4, 4))
    yield np.linalg.qr(rng.standard_normal((20, 20)))[0] * np.r_[np.full(10, 1.0), np.full(10, 1 + 1e-9)]
    yield rng.standard_normal((70, 64)) * (1 + 1e-6 * rng.standard_normal(64))
    yield np.ones((6, 1))


@pytest.mark.parametrize("i", range(10))
def test_directions(i):
    m = list(matrices())[i]
    r = np.linalg.qr(m, mode="r")
    r = np.vstack([r, np.zeros((r.shape[1] - len(r), r.shape[1]))])
    d, a, v = W.bidiagonal(r)
    b = np.diag(d) + np.diag(a, 1)
    top = np.linalg.norm(m, 2)
    assert np.allclose(v.T @ v, np.eye(len(d)), atol=1e-13) and np.allclose((r @ v).T @ (r @ v), b.T @ b, atol=1e-13 * top * top)
    values, x = W.directions(r, 16)
    want = np.linalg.svd(m, compute_uv=False)
    want = np.r_[want, np.zeros(r.shape[1] - len(want))]
    assert np.allclose(np.sqrt(values), want, rtol=1e-12, atol=4e-15 * top)
    rank = int((want > 1e-13 * top).sum()) if top else 0
    assert x.shape == (r.shape[1], min(16, rank))
    assert np.allclose(x.T @ x, np.eye(x.shape[1]), atol=1e-12)
    assert np.abs(m.T @ (m @ x) - x * values[:x.shape[1]]).max(initial=0.0) <= 1e-12 * top * top


def test_small_singular_values_are_accurate_relatively():
    """A graded bidiagonal keeps every digit of its least values."""
    from fractions import Fraction

    d, a = np.logspace(0, -12, 7), np.logspace(-1, -11, 6)
    values = W.squared_singular_values(d, a)
    product = Fraction(1)
    for v in values:
        product *= Fraction(float(v))
    exact = Fraction(1)
    for x in d:
        exact *= Fraction(float(x)) ** 2
    assert abs(product / exact - 1) < Fraction(1, 10 ** 13)


def brute(rows, k=16):
    good = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    lengths = [len(v) for _, v in good]
    width = max(set(lengths), key=lambda d: (lengths.count(d), d))
    x = [(i, tuple(int(np.floor(64 * c)) + 1000000 for c in v)) for i, v in good if len(v) == width]
    fit = sorted({v for _, v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    c = np.array([[float(n * a - s) / n for a, s in zip(v, sums, strict=True)] for v in fit])
    e, u = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(e)[::-1]
    e, u = e[order], u[:, order]
    keep = min(k, int((e > e[0] * 1e-14).sum()))
    out = []
    for i, v in x:
        y = np.array([float(n * a - s) / n for a, s in zip(v, sums, strict=True)])
        dev = sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))
        out += [(i, j + 1, n, dev, y @ u[:, j] / np.sqrt(e[j]), e[j] / e.sum()) for j in range(keep)]
    return out


def run(spark, rows):
    df = spark.createDataFrame([(i, v, 1.0, 2) for i, v in rows], "id bigint, vector array<float>, x double, component int").repartition(4)
    return df, W.whiten(df.select("id", "vector"), shared_folder(spark)).collect()


def test_whitening(spark):
    rng = np.random.default_rng(1)
    base = (rng.standard_normal((400, 24)) * np.linspace(1, 3, 24)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(None, base[3].tolist()), (7, base[9].tolist())] + [(1000 + i, base[0].tolist()) for i in range(300)]
    rows += [(-1, None), (-2, []), (-3, [float("nan")] * 24), (-4, [None, *[1.0] * 23]), (-5, [float("inf"), *[1.0] * 23]), (-6, [1.0, 2.0])]
    _, got = run(spark, rows)
    key = lambda r: (-99 if r[0] is None else r[0], r[1], r[3])
    got, want = sorted(map(tuple, got), key=key), sorted(brute(rows), key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    flip = {c: np.sign(next(g[4] for g in got if g[1] == c) * next(w[4] for w in want if w[1] == c)) for c in range(1, 17)}
    assert np.allclose([g[4] * flip[g[1]] for g in got], [w[4] for w in want], atol=1e-9)
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-10)
    assert {g[6] for g in got} == {got[0][6]} and got[0][6] < 1e-10


def test_few_dimensions_ties_and_nothing(spark):
    cross = [(i, [float(a), float(b)]) for i, (a, b) in enumerate([(1, 0), (-1, 0), (0, 1), (0, -1)])]
    _, got = run(spark, cross)
    assert len(got) == 8 and all(abs(r.explained - 0.5) < 1e-12 and r.identity_error < 1e-12 for r in got)
    assert run(spark, [(1, [1.0, 2.0])] * 5)[1] == []
    assert run(spark, [(1, None)])[1] == [] and run(spark, [])[1] == []
    flat = [(i, [float(i), 3.0, float(i)]) for i in range(9)]
    assert {r.component for r in run(spark, flat)[1]} == {1}


def test_triangles_are_reduced_in_groups(spark, monkeypatch):
    monkeypatch.setattr(W, "FAN_IN", 2)
    monkeypatch.setattr(W, "QR_ROWS", 16)
    rows = spark.range(300).selectExpr("id", "transform(sequence(0, 5), i -> cast(hash(id, i) % 500 as bigint)) as x").repartition(9)
    at = shared_folder(spark)
    n, s = W.whole_sums(rows, 6)
    fit = W.Fit(n, s, np.zeros(0), np.zeros((6, 0)), 0.0)
    x = np.array([r.x for r in rows.collect()])
    assert n == 300 and list(s) == x.sum(axis=0).tolist()
    r = W.triangles(rows, fit, 6, at)
    c = x - x.mean(axis=0)
    assert np.allclose(r.T @ r, c.T @ c, rtol=1e-10)


def test_deviation_of_many_rows_is_exact():
    fit = W.Fit(3_000_000_000, (3_000_000_001, -7), np.zeros(0), np.zeros((2, 0)), 0.0)
    x = np.array([[1, 0], [1, -1]])
    assert fit.deviation(x) == [1 + 49, 1 + (3_000_000_000 - 7) ** 2]
    with pytest.raises(OverflowError):
        fit.deviation(np.array([[40, 40]]))
