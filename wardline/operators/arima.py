"""Stationarity test and order-selected ARIMA, per series.

A daily series is bounded by its calendar (thousands of rows however large
the detail tables behind it), so each series is one ``applyInPandas`` group
and many series are fitted in parallel.  The estimation is least squares,
except that forecasts are made by exact likelihood (``statespace``), which the
least-squares estimates start:

* ADF: ``Δy_t = α + γ·y_{t-1} + Σ β_i·Δy_{t-i}``, lag order by AIC over a
  common sample (maxlag = ⌈12·(n/100)^¼⌉), t-statistic of γ, p-value from
  MacKinnon's (1994) response-surface approximation.
* ARIMA (Hannan–Rissanen): ``d`` from the ADF test; a long AR gives
  innovation estimates; every ``(p, q[, P, Q])`` within the reference's
  bounds is fitted by least squares on lagged values and lagged
  innovations and the lowest AIC wins (``select_arima``, a quick choice).
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.operators import series as S

# ---------------------------------------------------------------------------
# MacKinnon (1994) approximate p-value surface, constant-only
# regression, one variable.
# ---------------------------------------------------------------------------
TAU_MAX_C = 2.74
TAU_MIN_C = -18.83
TAU_STAR_C = -1.61
TAU_C_SMALLP = [2.1659, 1.4412, 0.038269]
TAU_C_LARGEP = [1.7339, 0.93202, -0.12745, -0.010368]
# ---------------------------------------------------------------------------


def _norm_cdf(x: float) -> float:
    return 0.5 * (1.0 + math.erf(x / math.sqrt(2.0)))


def mackinnon_p(stat: float) -> float:
    if stat > TAU_MAX_C:
        return 1.0
    if stat < TAU_MIN_C:
        return 0.0
    coef = TAU_C_SMALLP if stat <= TAU_STAR_C else TAU_C_LARGEP
    return _norm_cdf(sum(c * stat ** i for i, c in enumerate(coef)))


def _ols(y: np.ndarray, X: np.ndarray):
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    resid = y - X @ beta
    return beta, resid, float(resid @ resid)


def adf(y: np.ndarray, maxlag: int | None = None) -> dict:
    """Augmented Dickey-Fuller with a constant; lag order by AIC.

    ``status`` is ``ok``; ``too_short`` below 6 values, ``constant``, or
    ``exact`` where the regression leaves nothing (a line, a short cycle): then
    there is no statistic, and ``p_value`` is null."""
    y = np.asarray(y, dtype=float)
    n = len(y)
    none = {"adf_stat": None, "p_value": None, "used_lag": 0, "n_obs": max(0, n - 1)}
    if n < 6:
        return none | {"status": "too_short"}
    if np.ptp(y) == 0:
        return none | {"status": "constant"}
    nothing = 1e-18 * float(np.sum((y - y.mean()) ** 2))
    if maxlag is None:
        maxlag = int(math.ceil(12.0 * (n / 100.0) ** 0.25))
        maxlag = max(0, min(n // 2 - 2, maxlag))
    dy = np.diff(y)

    def design(lag: int, start: int):
        # rows t = start..n-2 of dy (dy[t] = y[t+1]-y[t]); regressors y[t], dy[t-1..t-lag], 1
        rows = np.arange(start, n - 1)
        cols = [y[rows]] + [dy[rows - i] for i in range(1, lag + 1)] + [np.ones(len(rows))]
        return dy[rows], np.column_stack(cols)

    best = None
    for lag in range(0, maxlag + 1):
        yy, X = design(lag, maxlag)
        _, _, ssr = _ols(yy, X)
        m = len(yy)
        k = X.shape[1]
        if ssr <= nothing:
            return none | {"status": "exact"}
        aic = -2 * (-m / 2 * (math.log(2 * math.pi) + math.log(ssr / m) + 1)) + 2 * k
        if best is None or aic < best[0]:
            best = (aic, lag)
    lag = best[1]
    yy, X = design(lag, lag)
    beta, resid, ssr = _ols(yy, X)
    m, k = X.shape
    if ssr <= nothing or m <= k:
        return none | {"status": "exact" if ssr <= nothing else "too_short"}
    sigma2 = ssr / (m - k)
    cov = sigma2 * np.linalg.pinv(X.T @ X)
    stat = float(beta[0] / math.sqrt(cov[0, 0]))
    return {"adf_stat": stat, "p_value": mackinnon_p(stat), "used_lag": lag, "n_obs": m, "status": "ok"}


ADF_SCHEMA = "series string, adf_stat double, p_value double, used_lag int, n_obs int, status string, is_stationary boolean"


def adf_test(s: DataFrame, alpha: float = 0.05) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        r = adf(pdf["value"].to_numpy())
        stationary = r["p_value"] < alpha if r["p_value"] is not None else True if r["status"] == "constant" else None
        return pd.DataFrame([{"series": pdf["series"].iloc[0], **r, "is_stationary": stationary}]).astype({"is_stationary": object})

    return s.select("series", "date", "value").groupBy("series").applyInPandas(run, ADF_SCHEMA)


# -- X6 ----------------------------------------------------------------------
def _lagged(x: np.ndarray, lags: list[int], t: np.ndarray) -> list[np.ndarray]:
    return [x[t - l] for l in lags]


def select_arima(y: np.ndarray, seasonal: bool, m: int = 7, max_p: int = 3, max_q: int = 3, max_P: int = 2,
                 max_Q: int = 2, alpha: float = 0.05) -> dict:
    """Order search over the reference's bounds by AIC (Hannan–Rissanen)."""
    y = np.asarray(y, dtype=float)
    d, w = 0, y
    while d < 2 and (adf(w)["p_value"] or 0.0) >= alpha:
        w = np.diff(w)
        d += 1
    n = len(w)
    long_order = min(max(20, 3 * m if seasonal else 0), n // 4)
    t = np.arange(long_order, n)
    X = np.column_stack(_lagged(w, list(range(1, long_order + 1)), t) + [np.ones(len(t))])
    _, e_part, _ = _ols(w[t], X)
    eps = np.zeros(n)
    eps[long_order:] = e_part
    Ps = range(max_P + 1) if seasonal else [0]
    Qs = range(max_Q + 1) if seasonal else [0]
    start = long_order + max(max_p, max_q, (max_P if seasonal else 0) * m, (max_Q if seasonal else 0) * m)
    t = np.arange(start, n)
    best = None
    for p, q, P, Q in itertools.product(range(max_p + 1), range(max_q + 1), Ps, Qs):
        ar = list(range(1, p + 1)) + [m * j for j in range(1, P + 1)]
        ma = list(range(1, q + 1)) + [m * j for j in range(1, Q + 1)]
        X = np.column_stack(_lagged(w, ar, t) + _lagged(eps, ma, t) + [np.ones(len(t))])
        beta, _, ssr = _ols(w[t], X)
        k = X.shape[1] + 1
        aic = len(t) * math.log(ssr / len(t)) + 2 * k
        if best is None or aic < best["aic"]:
            best = {"aic": aic, "p": p, "q": q, "P": P, "Q": Q, "ar": ar, "ma": ma, "beta": beta,
                    "sigma2": ssr / max(1, len(t) - X.shape[1])}
    best.update({"d": d, "w": w, "eps": eps, "y": y})
    return best


def forecast_arima(fit: dict, horizon: int, z: float = 1.959964) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Recursive h-step forecast (future innovations 0) with ψ-weight bands."""
    ar, ma, beta = fit["ar"], fit["ma"], fit["beta"]
    phi = dict(zip(ar, beta[: len(ar)]))
    theta = dict(zip(ma, beta[len(ar): len(ar) + len(ma)]))
    c = beta[-1]
    w = list(fit["w"])
    eps = list(fit["eps"])
    out = []
    for _ in range(horizon):
        v = c + sum(b * w[-l] for l, b in phi.items()) + sum(b * eps[-l] for l, b in theta.items())
        w.append(v)
        eps.append(0.0)
        out.append(v)
    out = np.array(out)
    # ψ weights of the ARMA part, then integrate d times
    psi = np.zeros(horizon)
    psi[0] = 1.0
    for j in range(1, horizon):
        psi[j] = theta.get(j, 0.0) + sum(phi.get(i, 0.0) * psi[j - i] for i in range(1, j + 1))
    levels = out
    y = fit["y"]
    for k in range(fit["d"]):
        base = np.diff(y, n=fit["d"] - k - 1)[-1] if fit["d"] - k - 1 > 0 else y[-1]
        levels = base + np.cumsum(levels)
        psi = np.cumsum(psi)
    var = fit["sigma2"] * np.cumsum(psi ** 2)
    half = z * np.sqrt(var)
    return levels, levels - half, levels + half


ARIMA_SCHEMA = ("series string, date date, value double, forecast double, lower double, upper double, "
                "p int, d int, q int, sp int, sd int, sq int, log_likelihood double, aic double, status string")
#: Training days below which orders are not searched.
MIN_TRAIN_DAYS = 60


def arima_forecast(s: DataFrame, train_end: str, test_start: str, seasonal: bool | None = None,
                   min_train: int = MIN_TRAIN_DAYS) -> DataFrame:
    """Fit by exact likelihood on the training days (``statespace``), forecast
    every test day of each series.

    ``seasonal=None`` decides per series from the seasonal strength (X5).
    ``status`` is ``arima``; ``exact`` where differencing leaves a constant (a
    constant or linear series, or a fixed week), which goes on as it is with no
    band; with fewer than ``min_train`` training days ``mean`` (their mean, the
    band from their spread); and ``no_training`` with nulls where there are
    none.  Orders are null unless fitted."""
    from wardline.operators import statespace as SS

    sp = S.time_split(s, train_end, test_start)
    strength = S.seasonal_strength(S.seasonal_decompose(sp.filter(F.col("split") == "train").drop("split")))
    sp = sp.join(strength.select("series", "is_seasonal"), "series", "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        tr = pdf[pdf["split"] == "train"]["value"].to_numpy(dtype=float)
        te = pdf[pdf["split"] == "test"]
        if te.empty:
            return pd.DataFrame(columns=ARIMA_SCHEMA_COLS)
        out = {"series": te["series"].to_numpy(), "date": te["date"].to_numpy(), "value": te["value"].to_numpy()}
        orders = dict.fromkeys(("p", "d", "q", "sp", "sd", "sq", "log_likelihood", "aic"))
        if len(tr) < min_train:
            mean, spread = (tr.mean(), 1.959964 * tr.std()) if len(tr) else (np.nan, np.nan)
            return pd.DataFrame({**out, "forecast": mean, "lower": mean - spread, "upper": mean + spread, **orders, "status": "mean" if len(tr) else "no_training"})
        weekly = (bool(pdf["is_seasonal"].iloc[0]) if pd.notna(pdf["is_seasonal"].iloc[0]) else False) if seasonal is None else seasonal
        fit = SS.select(tr, weekly)
        if fit is None:
            level = goes_on(tr, len(te))
            return pd.DataFrame({**out, "forecast": level, "lower": level, "upper": level, **orders, "status": "exact"})
        f, lo, hi = SS.forecast(fit, len(te))
        o = fit.order
        orders = {"p": o.p, "d": o.d, "q": o.q, "sp": o.P, "sd": o.D, "sq": o.Q, "log_likelihood": fit.loglik, "aic": fit.aic}
        return pd.DataFrame({**out, "forecast": f, "lower": lo, "upper": hi, **orders, "status": "arima"})

    return sp.groupBy("series").applyInPandas(run, ARIMA_SCHEMA)


def goes_on(y: np.ndarray, horizon: int, m: int = 7) -> np.ndarray:
    """A series that repeats exactly, as a line, a cycle of up to ``m`` days or
    both, continued; else its last value."""
    scale = 1e-9 * max(1.0, float(np.abs(y).max()))
    cycles = [np.array([1.0, *[0.0] * (k - 1), -1.0]) for k in range(1, m + 1)]
    for lag in [*cycles, *(np.convolve([1.0, -1.0], c) for c in cycles)]:
        rest = np.convolve(y, lag, "valid")
        if len(rest) and np.abs(rest - rest[-1]).max() <= scale:
            break
    else:
        lag, rest = [1.0, -1.0], np.zeros(1)
    out = list(y)
    for _ in range(horizon):
        out.append(rest[-1] - sum(c * out[-i] for i, c in enumerate(lag[1:], 1)))
    return np.array(out[len(y):])


ARIMA_SCHEMA_COLS = [c.split()[0] for c in ARIMA_SCHEMA.split(", ")]
