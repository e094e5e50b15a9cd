"""Seasonal ARIMA by exact Gaussian likelihood.

A differenced series is an ARMA process whose polynomials are products of a
short and a seasonal one.  Its likelihood comes from the Kalman filter of the
companion state-space form, started from the stationary distribution; once the
filter's gain has settled, only the innovations go on.  Parameters move in
partial autocorrelations, so every point is stationary and invertible, and all
points of a gradient or line search are filtered together.  Orders are found by
a stepwise walk over AIC; the seasonal difference by the strength of the
seasonal pattern, the plain ones by the Dickey-Fuller test."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from wardline.operators import arima as A

# The bounds of the order walk, and the strength from which a
# series is differenced seasonally (Wang, Smith & Hyndman 2006).
MAX_P = MAX_Q = 3
MAX_SP = MAX_SQ = 2
STRONG = 0.64
_EDGE = 0.98  # largest partial autocorrelation of a starting point
SETTLED = 1e-9
ITERATIONS = 12


@dataclass(frozen=True)
class Order:
    p: int
    d: int
    q: int
    P: int = 0
    D: int = 0
    Q: int = 0
    m: int = 7

    @property
    def size(self) -> int:
        return self.p + self.q + self.P + self.Q


# -- polynomials ------------------------------------------------------------------
def from_partial(r: np.ndarray) -> np.ndarray:
    """AR coefficients of partial autocorrelations (rows: parameter points)."""
    phi = np.zeros_like(r)
    for k in range(r.shape[1]):
        phi[:, :k], phi[:, k] = phi[:, :k] - r[:, k:k + 1] * phi[:, :k][:, ::-1], r[:, k]
    return phi


def to_partial(phi: np.ndarray) -> np.ndarray:
    """Partial autocorrelations of AR coefficients, kept inside (-1, 1)."""
    r, phi = np.zeros(len(phi)), np.array(phi, float)
    for k in range(len(phi) - 1, -1, -1):
        r[k] = np.clip(phi[k], -_EDGE, _EDGE)
        phi = (phi[:k] + r[k] * phi[:k][::-1]) / (1 - r[k] ** 2)
    return r


def product(short: np.ndarray, seasonal: np.ndarray, m: int, sign: float) -> np.ndarray:
    """Coefficients (lags 1, 2, ...) of (1 + s a B..)(1 + s b B^m..) with sign s."""
    n, k = short.shape[1], seasonal.shape[1]
    out = np.zeros((len(short), n + k * m))
    out[:, :n] = short
    for j in range(k):
        out[:, (j + 1) * m - 1] += seasonal[:, j]
        out[:, (j + 1) * m:(j + 1) * m + n] += sign * short * seasonal[:, j:j + 1]
    return out


def coefficients(x: np.ndarray, o: Order) -> tuple[np.ndarray, np.ndarray]:
    """(AR, MA) polynomials of free parameters (rows: points)."""
    r = np.tanh(x)
    a, b, c, e = np.split(r, np.cumsum([o.p, o.P, o.q]), axis=1)
    ar = product(from_partial(a), from_partial(b), o.m, -1.0)
    ma = -product(from_partial(-c), from_partial(-e), o.m, -1.0) if c.shape[1] + e.shape[1] else np.zeros((len(x), 0))
    # 1 + theta(B) = (1 - u(B))(1 - v(B)) with u, v of invertible form
    return ar, ma


# -- the Kalman filter ---------------------------------------------------------------
def _state(ar: np.ndarray, ma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Transition (points x r x r) and the innovations' loadings (points x r)."""
    n, r = len(ar), max(ar.shape[1], ma.shape[1] + 1, 1)
    t, load = np.zeros((n, r, r)), np.zeros((n, r))
    t[:, :ar.shape[1], 0] = ar
    t[:, np.arange(r - 1), np.arange(1, r)] = 1.0
    load[:, 0] = 1.0
    load[:, 1:ma.shape[1] + 1] = ma
    return t, load


def stationary(t: np.ndarray, load: np.ndarray) -> np.ndarray:
    """P = T P T' + R R' by doubling."""
    p, a = load[:, :, None] * load[:, None, :], t.copy()
    for _ in range(60):
        step = a @ p @ a.transpose(0, 2, 1)
        p = p + step
        a = a @ a
        if np.abs(step).max() <= 1e-13 * np.abs(p).max():
            break
    return p


def innovations(w: np.ndarray, ar: np.ndarray, ma: np.ndarray):
    """(one-step errors, their variances in units of the innovations', the last
    predicted state) of ``w`` (points x time)."""
    t, load = _state(ar, ma)
    n, size = w.shape
    p, a = stationary(t, load), np.zeros(load.shape)
    q = load[:, :, None] * load[:, None, :]
    v, f = np.empty((n, size)), np.empty((n, size))
    gain = None
    for k in range(size):
        if gain is None:
            f[:, k] = p[:, 0, 0]
            v[:, k] = w[:, k] - a[:, 0]
            column = (t @ p[:, :, :1])[:, :, 0]
            step = column / f[:, k:k + 1]
            a = (t @ a[:, :, None])[:, :, 0] + step * v[:, k:k + 1]
            p = t @ p @ t.transpose(0, 2, 1) - step[:, :, None] * column[:, None, :] + q
            p = (p + p.transpose(0, 2, 1)) / 2
            if k and np.abs(f[:, k] - 1).max() < SETTLED:
                gain, f[:, k + 1:] = step, 1.0
        else:
            v[:, k] = e = w[:, k] - a[:, 0]
            lead = a[:, 0].copy()
            a[:, :-1] = a[:, 1:]
            a[:, -1] = 0.0
            a += t[:, :, 0] * lead[:, None] + gain * e[:, None]
    return v, f, a


def log_likelihood(w: np.ndarray, x: np.ndarray, mean: np.ndarray, o: Order) -> tuple[np.ndarray, np.ndarray]:
    """Exact log-likelihood with the variance concentrated out, and that
    variance, per parameter point."""
    ar, ma = coefficients(x, o)
    v, f, _ = innovations(w[None, :] - mean[:, None], ar, ma)
    n = len(w)
    sigma2 = np.maximum((v * v / f).mean(axis=1), 1e-300)
    return -0.5 * (n * (np.log(2 * math.pi * sigma2) + 1) + np.log(f).sum(axis=1)), sigma2


# -- fitting -------------------------------------------------------------------------
@dataclass
class Fit:
    order: Order
    x: np.ndarray
    mean: float
    sigma2: float
    loglik: float
    aic: float
    y: np.ndarray
    w: np.ndarray
    tried: int = field(default=1)


def difference(y: np.ndarray, d: int, seasonal: int, m: int) -> np.ndarray:
    for _ in range(seasonal):
        y = y[m:] - y[:-m]
    return np.diff(y, n=d)


def _start(w: np.ndarray, o: Order) -> np.ndarray:
    """Hannan-Rissanen estimates as free parameters."""
    n, lags = len(w), max(o.p + o.P * o.m, o.q + o.Q * o.m)
    long = min(max(10, 2 * o.m, lags), max(1, n // 4))
    c = w - w.mean()
    if n < 3 * (long + lags) + 10:
        return np.zeros(o.size)
    t = np.arange(long, n)
    _, e, _ = A._ols(c[t], np.column_stack([c[t - i] for i in range(1, long + 1)]))
    eps = np.concatenate([np.zeros(long), e])
    ar, sar = range(1, o.p + 1), [o.m * j for j in range(1, o.P + 1)]
    ma, sma = range(1, o.q + 1), [o.m * j for j in range(1, o.Q + 1)]
    t = np.arange(long + lags, n)
    beta = A._ols(c[t], np.column_stack([c[t - i] for i in (*ar, *sar)] + [eps[t - i] for i in (*ma, *sma)] + [np.zeros(len(t))]))[0]
    a, b, q, s = np.split(beta[:o.size], np.cumsum([o.p, o.P, o.q]))
    r = np.concatenate([to_partial(a), to_partial(b), -to_partial(-q), -to_partial(-s)])
    return np.arctanh(np.clip(r, -0.9, 0.9))


def fit_order(y: np.ndarray, o: Order, iterations: int = ITERATIONS) -> Fit:
    """Maximum likelihood by BFGS; the mean is a parameter unless the series is
    differenced twice or more."""
    w = difference(y, o.d, o.D, o.m)
    with_mean = o.d + o.D < 2
    spread = float(w.std()) or 1.0
    z = np.concatenate([_start(w, o), [w.mean() / spread] if with_mean else []])

    def value(points: np.ndarray) -> np.ndarray:
        mean = points[:, -1] * spread if with_mean else np.zeros(len(points))
        ll = log_likelihood(w, np.clip(points[:, :o.size], -6, 6), mean, o)[0]
        return np.where(np.isfinite(ll), -ll, np.inf)

    k = len(z)
    h, best = np.eye(k) / max(1, len(w)), value(z[None, :])[0]
    grad = None
    for _ in range(iterations if k else 0):
        if grad is None:
            steps = 1e-5 * np.eye(k)
            around = value(np.concatenate([z + steps, z - steps]))
            grad = (around[:k] - around[k:]) / 2e-5
        if np.abs(grad).max() < 1e-4 * len(w) ** 0.5:
            break
        move = -h @ grad
        scales = np.array([1.0, 0.5, 2.0, 0.2, 0.05, 0.01])
        tried = value(z + scales[:, None] * move)
        i = int(np.argmin(tried))
        if not tried[i] < best - 1e-7:
            if np.allclose(h, np.eye(k) / len(w)):
                break
            h = np.eye(k) / len(w)
            continue
        s, z, best = scales[i] * move, z + scales[i] * move, tried[i]
        steps = 1e-5 * np.eye(k)
        around = value(np.concatenate([z + steps, z - steps]))
        new = (around[:k] - around[k:]) / 2e-5
        t, grad = new - grad, new
        if s @ t > 1e-12:
            rho, unit = 1 / (s @ t), np.eye(k)
            h = (unit - rho * np.outer(s, t)) @ h @ (unit - rho * np.outer(t, s)) + rho * np.outer(s, s)
    x, mean = np.clip(z[:o.size], -6, 6), float(z[-1] * spread) if with_mean else 0.0
    ll, sigma2 = log_likelihood(w, x[None, :], np.array([mean]), o)
    return Fit(o, x, mean, float(sigma2[0]), float(ll[0]), float(-2 * ll[0] + 2 * (k + 1)), y, w)


def seasonal_strength(y: np.ndarray, m: int) -> float:
    """1 - var(rest) / var(seasonal + rest) around a centred moving average."""
    if len(y) < 3 * m:
        return 0.0
    width = m if m % 2 else m + 1
    weights = np.ones(width) / m
    if not m % 2:
        weights[[0, -1]] /= 2
    trend = np.convolve(y, weights, "valid")
    rest = y[width // 2:len(y) - width // 2] - trend
    phase = np.arange(len(rest)) % m
    pattern = (np.bincount(phase, rest, m) / np.bincount(phase, minlength=m))[phase]
    both = float(rest.var())
    return max(0.0, 1 - float((rest - pattern).var()) / both) if both > 0 else 0.0


def select(y: np.ndarray, seasonal: bool, m: int = 7, alpha: float = 0.05) -> Fit | None:
    """The order of lowest AIC on a stepwise walk from four starts, moving one
    or two orders by one, within the bounds.  None where there is nothing to
    fit: fewer than 8 values, or a series that repeats exactly."""
    y = np.asarray(y, float)
    if len(y) < 8:
        return None
    use = seasonal and len(y) >= 4 * m
    big = 1 if use and seasonal_strength(y, m) >= STRONG else 0
    w, d = difference(y, 0, big, m), 0
    if "exact" in (A.adf(y)["status"], A.adf(w)["status"]):
        return None
    while d < 2 and len(w) >= 8 and (p := A.adf(w)["p_value"]) is not None and p >= alpha:
        w, d = np.diff(w), d + 1
    if w.std() <= 1e-9 * max(1.0, float(np.abs(y).max())):
        return None
    caps = (MAX_P, MAX_Q, MAX_SP if use else 0, MAX_SQ if use else 0)
    fits: dict[tuple, Fit] = {}

    def fit(p, q, sp, sq) -> float:
        key = (p, q, sp, sq)
        if any(v < 0 or v > c for v, c in zip(key, caps)) or 2 * (sum(key) + (sp + sq) * (m - 1)) >= len(w):
            return math.inf
        if key not in fits:
            fits[key] = fit_order(y, Order(p, d, q, sp, big, sq, m))
        return fits[key].aic

    s = 1 if use else 0
    starts = [(2, 2, s, s), (0, 0, 0, 0), (1, 0, s, 0), (0, 1, 0, s)]
    best = min(starts, key=lambda k: fit(*k))
    if best not in fits:
        best = (0, 0, 0, 0)
        fit(*best)
    moves = [(1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1), (1, 1, 0, 0), (0, 0, 1, 1)]
    improved = True
    while improved:
        improved = False
        for move in moves:
            for sign in (1, -1):
                near = tuple(b + sign * v for b, v in zip(best, move))
                if fit(*near) < fits[best].aic - 1e-6:
                    best, improved = near, True
    out = fits[best]
    out.tried = len(fits)
    return out


def forecast(f: Fit, horizon: int, z: float = 1.959964) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forecasts with a central 95 % band, on the level of the series."""
    o = f.order
    ar, ma = coefficients(f.x[None, :], o)
    _, _, a = innovations(f.w[None, :] - f.mean, ar, ma)
    t, _ = _state(ar, ma)
    a, t, w = a[0], t[0], np.empty(horizon)
    for k in range(horizon):
        w[k] = a[0] + f.mean
        a = t @ a
    lag = np.array([1.0])  # the difference polynomial
    for _ in range(o.d):
        lag = np.convolve(lag, [1.0, -1.0])
    for _ in range(o.D):
        lag = np.convolve(lag, np.concatenate(([1.0], np.zeros(o.m - 1), [-1.0])))
    levels = list(f.y[len(f.y) - len(lag) + 1:]) if len(lag) > 1 else []
    for k in range(horizon):
        levels.append(w[k] - sum(c * levels[-i] for i, c in enumerate(lag[1:], 1)))
    levels = np.array(levels[len(levels) - horizon:])
    whole = np.convolve(np.concatenate(([1.0], -ar[0])), lag)
    psi = np.zeros(horizon)
    for j in range(horizon):
        psi[j] = (1.0 if j == 0 else ma[0][j - 1] if j <= ma.shape[1] else 0.0) - whole[1:j + 1] @ psi[:j][::-1][:len(whole) - 1]
    half = z * np.sqrt(f.sigma2 * np.cumsum(psi ** 2))
    return levels, levels - half, levels + half
