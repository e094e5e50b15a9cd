"""Embedding whitening by spectrum slicing.

Vectors become integers, so counts, sums and cross products over the distinct
vectors are exact and merge in any order.  On the driver only the covariance of
one length of vectors is held: inertia counts of its shifted LDL' factorisation
isolate each leading eigenvalue, Rayleigh quotient iteration converges to it,
and two more counts certify its number."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import stored

SCALE = 256
COMPONENTS = 4
#: Exact sums travel as four 64-bit columns of 40 bits each.
LIMB = 40
_LIMBS = ["l0", "l1", "l2", "l3"]
#: Integers below this multiply exactly in doubles, as many as ``_EXACT_ROWS`` at a time.
_SMALL = 1 << 20
_EXACT_ROWS = 1 << 13
_LONG = float(1 << 62)


# -- exact sums -----------------------------------------------------------------
def limbs(value: int) -> list[int]:
    """The value in base 2^40, the last limb with the sign."""
    out = []
    for _ in range(len(_LIMBS) - 1):
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def whole(parts) -> int:
    return sum(int(p) << (LIMB * k) for k, p in enumerate(parts))


def cross_products(y: np.ndarray) -> np.ndarray:
    """Exact ``y' y`` of integers, as Python integers."""
    total = np.zeros((y.shape[1], y.shape[1]), object)
    if np.abs(y).max(initial=0) < _SMALL:
        for a in range(0, len(y), _EXACT_ROWS):  # below 2^53 each
            part = y[a:a + _EXACT_ROWS].astype(np.float64)
            total += (part.T @ part).astype(np.int64)
        return total
    wide = y.astype(object)
    return wide.T @ wide


def matrix_of(column: pa.Array) -> np.ndarray:
    """Rows of a list column whose lists are equally long."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def by_length(batch: pa.RecordBatch, name: str = "x") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, rows) for each length of vectors in a batch."""
    column = batch.column(name)
    sizes = np.diff(column.offsets.to_numpy())
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        yield d, rows, matrix_of(column if len(rows) == len(sizes) else column.take(pa.array(rows)))


def _long_table(totals: dict[tuple[int, int, int], int]) -> pa.RecordBatch:
    keys, values = list(totals), [limbs(int(v)) for v in totals.values()]
    columns = [pa.array([k[i] for k in keys], pa.int32()) for i in range(3)] + [pa.array([v[i] for v in values], pa.int64()) for i in range(4)]
    return pa.record_batch(columns, names=["d", "i", "j", *_LIMBS])


_SUMS = "d int, i int, j int, " + ", ".join(f"{c} long" for c in _LIMBS)


def _summed(parts: DataFrame) -> dict[int, dict[tuple[int, int], int]]:
    """Totals over tasks.  Spark adds the limbs by (length, i, j); what comes to
    the driver is one small matrix for each length."""
    out: dict[int, dict[tuple[int, int], int]] = {}
    for r in parts.groupBy("d", "i", "j").agg(*(F.sum(c).alias(c) for c in _LIMBS)).collect():
        out.setdefault(r.d, {})[r.i, r.j] = whole(r[c] for c in _LIMBS)
    return out


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Row counts (at j = 1) and sums (at j = 0) of the dimensions."""
    count, total = {}, {}
    for batch in batches:
        for d, rows, x in by_length(batch):
            count[d] = count.get(d, 0) + len(rows)
            exact = x.sum(axis=0) if np.abs(x).max(initial=0) < 1 << 40 else x.astype(object).sum(axis=0)
            total[d] = total.get(d, np.zeros(d, object)) + exact
    yield _long_table({(d, 0, 1): n for d, n in count.items()} | {(d, i, 0): v for d, s in total.items() for i, v in enumerate(s)})


def _products(means: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {}
        for batch in batches:
            for d, _, x in by_length(batch):
                total[d] = total.get(d, 0) + cross_products(x - means[d])
        yield _long_table({(d, i, j): m[i, j] for d, m in total.items() for i in range(d) for j in range(i, d)})

    return run


# -- the spectrum ---------------------------------------------------------------
def inertia_above(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric ``a`` exceed ``shift``: the positive
    pivots of ``a - shift I = L D L'`` (Sylvester's law of inertia), with the
    symmetric pivoting of 1 x 1 and 2 x 2 blocks that keeps it stable."""
    m = a - shift * np.eye(len(a))
    alpha, positive = (1 + 17 ** 0.5) / 8, 0
    while len(m):
        column = np.abs(m[1:, 0])
        most = column.max(initial=0.0)
        size = 1
        if most > 0 and abs(m[0, 0]) < alpha * most:
            r = 1 + int(column.argmax())
            other = np.abs(np.delete(m[r], r)).max()
            if abs(m[0, 0]) * other < alpha * most ** 2:
                if abs(m[r, r]) >= alpha * other:
                    to = 0
                else:
                    size, to = 2, 1
                if to != r:
                    m[[to, r]] = m[[r, to]]
                    m[:, [to, r]] = m[:, [r, to]]
        d, below = m[:size, :size], m[size:, :size]
        positive += int((np.linalg.eigvalsh(d) > 0).sum()) if size == 2 else int(d[0, 0] > 0)
        rest = m[size:, size:]
        if size == 2 or d[0, 0] != 0:
            rest = rest - below @ np.linalg.solve(d, below.T)
            rest = (rest + rest.T) / 2
        m = rest
    return positive


def _solve(a: np.ndarray, shift: float, v: np.ndarray) -> np.ndarray:
    size = len(a)
    nudge = np.finfo(float).eps * np.abs(a).max()
    for k in range(8):
        try:
            x = np.linalg.solve(a - (shift + (k and nudge * 2 ** k)) * np.eye(size), v)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(x).all() and np.abs(x).max() > 0:
            return x / np.abs(x).max()
    return v


def leading(a: np.ndarray, most: int = COMPONENTS) -> list[tuple[float, np.ndarray]]:
    """The ``most`` largest eigenvalues of a covariance with unit eigenvectors
    (largest entry positive), falling; those that rounding cannot tell from
    zero are left out.  Equal eigenvalues get any orthonormal vectors."""
    size = len(a)
    norm = float(np.abs(a).sum(axis=1).max(initial=0.0))
    floor = 16 * size * np.finfo(float).eps * norm
    close = 64 * np.finfo(float).eps * norm
    out: list[tuple[float, np.ndarray]] = []
    rng = np.random.default_rng(1)
    for k in range(1, min(most, size) + 1):
        lo, hi = floor, norm * (1 + 1e-12)
        n_lo = inertia_above(a, lo)
        if n_lo < k:
            break
        n_hi = 0
        found = None
        while found is None:
            # count(lo) >= k > count(hi): the k-th eigenvalue lies between
            if n_lo - n_hi == 1 or hi - lo <= close:
                found = _rayleigh(a, lo, hi, [v for _, v in out], rng, certain=hi - lo <= close)
            if found is None:
                if hi - lo <= np.finfo(float).eps * norm:
                    raise ArithmeticError(f"no eigenvector for eigenvalue {k}")
                mid = (lo + hi) / 2
                n = inertia_above(a, mid)
                lo, n_lo, hi, n_hi = (mid, n, hi, n_hi) if n >= k else (lo, n_lo, mid, n)
        e, v = found
        step = max(close, 1e-12 * e)
        if not (inertia_above(a, e - step) >= k > inertia_above(a, e + step)):
            raise ArithmeticError(f"eigenvalue {k} is not certified")
        out.append((e, v if v[np.abs(v).argmax()] > 0 else -v))
    return out


def _rayleigh(a, lo, hi, earlier, rng, certain):
    """Rayleigh quotient iteration started inside (lo, hi); None if it leaves."""
    def apart(v):
        for _ in range(2):
            for u in earlier:
                v = v - (u @ v) * u
        return v / np.linalg.norm(v)

    v, shift = apart(rng.normal(size=len(a))), (lo + hi) / 2
    for _ in range(3):
        v = apart(_solve(a, shift, v))
    rounding = np.finfo(float).eps * np.abs(a).sum(axis=1).max()
    for _ in range(12):
        e = float(v @ a @ v)
        if np.linalg.norm(a @ v - e * v) <= 8 * rounding:
            break
        v = apart(_solve(a, e if lo < e < hi else shift, v))
    e = float(v @ a @ v)
    slack = 32 * rounding if certain else 0.0
    settled = np.linalg.norm(a @ v - e * v) <= 32 * rounding
    return (e, v) if settled and lo - slack < e < hi + slack else None


class Whitener:
    """What is learned of the vectors of one length."""

    def __init__(self, n: int, sums: list[int], products: dict[tuple[int, int], int], most: int):
        d = len(sums)
        self.n, self.sums = n, sums
        self.mean = np.array([s // n for s in sums], np.int64)  # rounded down; the rest is in [0, 1)
        rest = [s - n * int(m) for s, m in zip(sums, self.mean)]
        self.rest = np.array([r / n for r in rest])
        cov = np.zeros((d, d))
        for (i, j), p in products.items():
            cov[i, j] = cov[j, i] = (n * p - rest[i] * rest[j]) / (n * n)
        self.found = leading(cov, most) if d else []
        trace = float(np.trace(cov))
        self.explained = [e / trace for e, _ in self.found]
        self.directions = np.stack([v / e ** 0.5 for e, v in self.found], axis=1) if self.found else np.zeros((d, 0))
        self.identity_error: float | None = None

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) - self.rest) @ self.directions

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)^2, null where they exceed 64 bits."""
        n, y, r = self.n, x - self.mean, [s - self.n * int(m) for s, m in zip(self.sums, self.mean)]
        if np.abs(y).max(initial=0) < 1 << 25 and n < 1 << 32:
            squares, mixed = (y * y).sum(axis=1).tolist(), (y.astype(object) @ np.array(r, object)).tolist() if max(r, default=0) >= 1 << 31 else (y @ np.array(r, np.int64)).tolist()
        else:
            wide = y.astype(object)
            squares, mixed = (wide * wide).sum(axis=1).tolist(), (wide @ np.array(r, object)).tolist()
        ends = sum(v * v for v in r)
        values = [n * n * int(s) - 2 * n * int(m) + ends for s, m in zip(squares, mixed)]
        return [v if v < 1 << 63 else None for v in values]


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``vec_id, x`` of the rows that take part."""
    fits = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(_LONG / scale))
    wide: Column = F.transform("v", lambda c: F.floor(c.cast("double") * scale).cast("long"))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"))
    return rows.where((F.size("v") > 0) & F.forall("v", fits)).select("vec_id", wide.alias("x"))


def fit(distinct: DataFrame, most: int = COMPONENTS) -> dict[int, Whitener]:
    """For each length of vectors its whitener, from a stored table of distinct
    vectors ``x``.  Three passes: counts and sums; cross products of what is
    left after taking off the (integer) means; and the covariance of the
    whitened vectors, which the whiteners keep the error of."""
    first = _summed(distinct.mapInArrow(_sums, _SUMS))
    sums = {d: (t[0, 1], [t[i, 0] for i in range(d)]) for d, t in first.items()}
    means = {d: np.array([v // n for v in s], np.int64) for d, (n, s) in sums.items()}
    products = _summed(distinct.mapInArrow(_products(means), _SUMS)) if sums else {}
    out = {d: Whitener(n, s, products[d], most) for d, (n, s) in sums.items()}
    shared = distinct.sparkSession.sparkContext.broadcast(out)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in by_length(batch):
                w = shared.value[d].whiten(x)
                w = np.hstack([w, np.ones((len(w), 1))])
                total[d] = total.get(d, 0) + w.T @ w
        cells = [(d, i, j, float(m[i, j])) for d, m in total.items() for i in range(len(m)) for j in range(len(m))]
        yield pa.record_batch([pa.array([c[k] for c in cells], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.float64()))], names=["d", "i", "j", "v"])

    cells = distinct.mapInArrow(spread, "d int, i int, j int, v double").groupBy("d", "i", "j").agg(F.sum("v").alias("v")).collect() if out else []
    for d, own in out.items():
        k = len(own.found)
        m = np.zeros((k + 1, k + 1))
        for c in cells:
            if c.d == d:
                m[c.i, c.j] = c.v
        centre = m[k, :k] / own.n
        own.identity_error = float(np.abs(m[:k, :k] / own.n - np.outer(centre, centre) - np.eye(k)).max(initial=0.0))
    return out


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``:
    for each row with a usable vector and each of the ``most`` leading
    components of the covariance of the distinct integer vectors.

    Rows are left out whose vector is null or empty, or holds a null or
    non-finite entry (or one that, scaled, is no 64-bit integer).  Vectors of
    different lengths have whiteners of their own; the number of lengths must be
    small.  Copies count once in the fit and get a row each, as do repeated and
    null ids; other columns of the input play no part.  Components of no
    variance are left out: a single vector, or equal ones, give no rows, and
    neither does an empty table.  ``deviation`` is null beyond 64 bits."""
    rows = integers(vectors, id_col, vector_col, scale)
    learned = fit(stored(rows.select("x").distinct(), "vectors"), most)
    shared = rows.sparkSession.sparkContext.broadcast(learned)
    id_type = rows.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, x in by_length(batch):
                own = shared.value[d]
                k = len(own.found)
                if not k:
                    continue
                n = len(at)
                ids = batch.column("vec_id").take(pa.array(np.repeat(at, k)))
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, own.n, np.int64)),
                    pa.array([v for v in own.deviations(x) for _ in range(k)], pa.int64()), pa.array(own.whiten(x).ravel()),
                    pa.array(np.tile(own.explained, n)), pa.array(np.full(n * k, own.identity_error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double")
