import math

import numpy as np
import pytest

from tests.conftest import SF_SMALL
from wardline.llm import whitening
from wardline.llm.common import table
from wardline.llm.queries import QUERIES


def test_inertia_counts_equal_eigenvalue_counts():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 8, 20):
        for _ in range(15):
            a = rng.normal(size=(n, n))
            a = a + a.T
            if n > 2:
                a[0, 0] = a[1, 1] = 0.0
            e = np.linalg.eigvalsh(a)
            for s in (0.0, 0.3, *((e[1:] + e[:-1]) / 2)):
                assert whitening.inertia_above(a, s) == (e > s).sum()


@pytest.mark.parametrize("spectrum", [[5, 4, 3, 2, 1, 0.5], [5, 5, 5, 5, 1, 1], [7, 1 + 1e-9, 1, 1 - 1e-9, 0.1], [3, 1e-3, 1e-6, 0, 0], [1e12, 1, 1, 1e-3, 0], [2.0], [0.0, 0.0]])
def test_leading_components(spectrum):
    rng = np.random.default_rng(4)
    q, _ = np.linalg.qr(rng.normal(size=(len(spectrum),) * 2))
    a = q @ np.diag(spectrum) @ q.T
    a = (a + a.T) / 2
    found = whitening.leading(a)
    want = [e for e in sorted(spectrum, reverse=True)[:4] if e > 1e-13 * max(spectrum)]
    assert np.allclose([e for e, _ in found], want, rtol=1e-9, atol=1e-13 * max(spectrum))
    v = np.array([v for _, v in found]).reshape(len(found), len(a))
    assert np.allclose(v @ v.T, np.eye(len(found)), atol=1e-8)
    for e, u in found:
        assert np.linalg.norm(a @ u - e * u) <= 1e-13 * max(spectrum) * len(spectrum)


def test_limbs_and_exact_products():
    for v in (0, 1, -1, 2 ** 100 + 3, -2 ** 119 - 7):
        assert whitening.whole(whitening.limbs(v)) == v
    rng = np.random.default_rng(5)
    for most in (300, 1 << 30, 1 << 60):
        y = rng.integers(-most, most, (20, 3))
        assert (whitening.cross_products(y) == y.astype(object).T @ y.astype(object)).all()


def brute(vectors):
    """Plain version: per usable vector its integers, deviation and whitened values."""
    x = np.array(vectors, float)
    x = np.floor(256 * x).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    e, v = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-e)[:4]
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ v[:, order] / np.sqrt(e[order]), e[order] / e.sum()


def test_query_against_plain_version(spark):
    rows = table(spark, SF_SMALL, "embeddings").orderBy("vec_id").collect()
    n, deviation, white, explained = brute([r.embedding for r in rows])
    got = sorted(QUERIES["op12_whitening"](spark, SF_SMALL).collect(), key=lambda r: (r.vec_id, r.component))
    assert [(r.vec_id, r.component) for r in got] == [(r.vec_id, k) for r in rows for k in (1, 2, 3, 4)]
    assert {r.n for r in got} == {n} and [r.deviation for r in got[::4]] == deviation.tolist()
    w = np.array([r.whitened for r in got]).reshape(-1, 4)
    signs = np.sign((w * white).sum(axis=0))
    assert np.allclose(w, white * signs, atol=1e-8)
    assert np.allclose([r.explained for r in got[:4]], explained, rtol=1e-9)
    assert all(r.identity_error < 1e-9 for r in got)


def test_large_means_keep_small_spread(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(-3, 4, (60, 3)) / 256 + np.array([2.0 ** 40, -(2.0 ** 41), 5.0])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(base.tolist())], "vec_id long, embedding array<double>")
    got = sorted(whitening.whiten(df).collect(), key=lambda r: (r.vec_id, r.component))
    x = np.floor((base - np.array([2.0 ** 40, -(2.0 ** 41), 5.0])) * 256).astype(int)
    fit = np.unique(x, axis=0)
    e = np.sort(np.linalg.eigvalsh(np.cov(fit.T, bias=True)))[::-1]
    assert np.allclose([r.explained for r in got[:3]], e / e.sum(), rtol=1e-6)
    assert got[0].identity_error < 1e-9
    assert [r.deviation for r in got[::3]] == ((len(fit) * x - fit.sum(axis=0)) ** 2).sum(axis=1).tolist()


def test_edges(spark):
    nan, inf = math.nan, math.inf
    rows = [(0, [1.0, 2.0]), (1, [0.5, -0.25]), (2, [1.0, 2.0]), (2, [0.0, -0.0]), (None, [3.0, 2.0]), (4, None), (5, [1.0, None]), (6, [nan, 1.0]),
            (7, [inf, 1.0]), (8, []), (9, [1.0, 2.0, 3.0]), (10, [1e30, 0.0])]
    df = spark.createDataFrame([(*r, 1, 2.0, [0]) for r in rows], "vec_id long, embedding array<double>, n int, whitened double, x array<int>")
    got = whitening.whiten(df).collect()
    keep = [(i, v) for i, v in rows if i in (0, 1, 2, None)]
    n, deviation, white, _ = brute([v for _, v in keep])
    assert sorted((str(r.vec_id), r.component, r.n, r.deviation) for r in got) == sorted((str(i), k, n, int(d)) for (i, _), d in zip(keep, deviation) for k in (1, 2))
    assert whitening.whiten(df.limit(0)).count() == 0
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert whitening.whiten(same).count() == 0
