"""Exact ARMA likelihood, order walk, forecasts, and series with nothing to fit."""

import datetime

import numpy as np
import pytest

from wardline.operators import arima as A
from wardline.operators import statespace as SS


def simulate(n, ar=(), ma=(), seed=0, burn=300):
    rng = np.random.default_rng(seed)
    e, y = rng.normal(size=n + burn), np.zeros(n + burn)
    for t in range(n + burn):
        y[t] = e[t] + sum(a * y[t - i] for i, a in enumerate(ar, 1) if t >= i) + sum(b * e[t - i] for i, b in enumerate(ma, 1) if t >= i)
    return y[burn:]


@pytest.mark.parametrize("o", [SS.Order(0, 0, 0), SS.Order(2, 0, 1), SS.Order(1, 0, 2, 1, 0, 1), SS.Order(0, 0, 1, 2, 0, 0), SS.Order(3, 0, 0, 0, 0, 2)])
def test_likelihood_equals_dense_gaussian(o):
    rng = np.random.default_rng(o.size)
    x, w = rng.normal(0, 0.5, (2, o.size)), rng.normal(size=40)
    mean = np.array([0.3, -0.2])
    got, sigma2 = SS.log_likelihood(w, x, mean, o)
    ar, ma = SS.coefficients(x, o)
    for k in range(2):
        psi = np.zeros(4000)
        for j in range(len(psi)):
            psi[j] = (1.0 if j == 0 else ma[k][j - 1] if j <= ma.shape[1] else 0.0) + sum(a * psi[j - i] for i, a in enumerate(ar[k], 1) if j >= i)
        gamma = np.array([psi[:len(psi) - h] @ psi[h:] for h in range(40)])
        cov = gamma[np.abs(np.subtract.outer(np.arange(40), np.arange(40)))]
        c = w - mean[k]
        s2 = c @ np.linalg.solve(cov, c) / 40
        want = -0.5 * (40 * (np.log(2 * np.pi * s2) + 1) + np.linalg.slogdet(cov)[1])
        assert np.isclose(sigma2[k], s2) and np.isclose(got[k], want)


def test_polynomials_stay_stationary_and_convert_back():
    rng = np.random.default_rng(3)
    r = np.tanh(rng.normal(0, 1, (5, 3)))
    phi = SS.from_partial(r)
    for k in range(5):
        assert (np.abs(np.roots(np.concatenate(([1.0], -phi[k])))) < 1).all()
        assert np.allclose(SS.to_partial(phi[k]), np.clip(r[k], -0.98, 0.98), atol=1e-9) or np.abs(r[k]).max() > 0.98
    ar, ma = SS.coefficients(rng.normal(size=(1, 4)), SS.Order(1, 0, 1, 1, 0, 1))
    assert (np.abs(np.roots(np.concatenate(([1.0], -ar[0])))) < 1).all() and (np.abs(np.roots(np.concatenate(([1.0], ma[0])))) < 1).all()


def test_fit_recovers_parameters():
    y = 5 + simulate(1500, ar=(0.6,), ma=(0.4,), seed=4)
    f = SS.fit_order(y, SS.Order(1, 0, 1))
    ar, ma = SS.coefficients(f.x[None, :], f.order)
    assert abs(ar[0][0] - 0.6) < 0.08 and abs(ma[0][0] - 0.4) < 0.08 and abs(f.mean - 5) < 0.4 and abs(f.sigma2 - 1) < 0.1
    around = [SS.log_likelihood(f.w, f.x[None, :] + e, np.array([f.mean]), f.order)[0][0] for e in (0.02 * np.eye(2))] \
        + [SS.log_likelihood(f.w, f.x[None, :] - e, np.array([f.mean]), f.order)[0][0] for e in (0.02 * np.eye(2))]
    assert max(around) <= f.loglik + 1e-3  # a maximum


def test_walk_finds_differences_and_band_covers():
    rng = np.random.default_rng(5)
    walk = np.cumsum(rng.normal(size=500))
    f = SS.select(walk[:450], False)
    assert f.order.d == 1 and f.order.D == 0
    level, lo, hi = SS.forecast(f, 50)
    assert np.mean((walk[450:] >= lo) & (walk[450:] <= hi)) > 0.8 and (np.diff(hi - lo) > 0).all()
    week = 10 * np.array([0, 1, 3, 2, 5, 8, 4.0])
    y = np.tile(week, 60) + rng.normal(size=420)
    f = SS.select(y[:392], True)
    assert f.order.D == 1
    level, lo, hi = SS.forecast(f, 28)
    assert np.mean((y[392:] >= lo) & (y[392:] <= hi)) > 0.85 and np.abs(level - y[392:]).mean() < 2


def test_white_noise_forecast_is_the_mean():
    f = SS.fit_order(np.random.default_rng(6).normal(3, 1, 300), SS.Order(0, 0, 0))
    level, lo, hi = SS.forecast(f, 5)
    assert np.allclose(level, f.mean) and np.allclose(hi - lo, 2 * 1.959964 * f.sigma2 ** 0.5)


@pytest.mark.parametrize("y,status", [(np.full(50, 3.0), "constant"), (np.arange(50.0), "exact"), (np.array([1.0, 2.0]), "too_short"), (np.zeros(0), "too_short"), (np.arange(5.0), "too_short")])
def test_nothing_to_fit(y, status):
    assert A.adf(y)["status"] == status and A.adf(y)["p_value"] is None
    assert SS.select(y, True) is None


def test_series_with_nothing_to_fit_do_not_end_the_others(spark):
    day = datetime.date(2020, 1, 1)
    dates = [day + datetime.timedelta(days=i) for i in range(100)]
    week = [4.0, 1.0, 3.0, 2.0, 5.0, 8.0, 4.0]
    noise = simulate(100, ar=(0.5,), seed=9)
    rows = [(n, d, float(f(i))) for n, f in (("constant", lambda i: 7), ("line", lambda i: 2 * i), ("week", lambda i: week[i % 7]), ("noise", lambda i: noise[i])) for i, d in enumerate(dates)]
    rows += [("short", d, float(i)) for i, d in enumerate(dates[75:])]
    s = spark.createDataFrame(rows, "series string, date date, value double")
    got = A.arima_forecast(s, "2020-03-20", "2020-03-21").toPandas().sort_values(["series", "date"])
    status = got.groupby("series").status.first().to_dict()
    assert status == {"constant": "exact", "line": "exact", "week": "exact", "noise": "arima", "short": "mean"}
    for n in ("constant", "line", "week"):
        part = got[got.series == n]
        assert np.allclose(part.forecast, part.value) and np.allclose(part.lower, part.upper)
    test = {r.series: r for r in A.adf_test(s).collect()}
    assert test["constant"].is_stationary and test["line"].is_stationary is None and test["noise"].status == "ok"
