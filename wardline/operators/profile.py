"""Distribution and relationship profiles.

Every operator reduces the input to a result whose size is set by the
number of categories, bins or column pairs, never by the row count.  Wide
inputs are turned long with one ``explode`` of ``(name, value)`` structs so
several columns share one scan and one shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions import exprs as X
from wardline.operators.quantiles import DEFAULT_ACCURACY, exact_quantiles, long_values, quantile_table


def _long_text(df: DataFrame, cols: Sequence[str], by: Iterable[str] = (), name="feature", value="category"):
    by = list(by)
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias(name), F.col(c).cast("string").alias(value)) for c in cols
    ])).alias("__p")
    return df.select(*by, pairs).select(*by, f"__p.{name}", f"__p.{value}")


# -- A11 -------------------------------------------------------------------
def value_counts(df: DataFrame, col: str, top: int | None = None, places: int = 2) -> DataFrame:
    """``(value, count, pct)``: descending count (ties by value); pct of non-null rows."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    total = df.agg(F.count(F.col(col)).alias("__t"))
    out = counts.crossJoin(F.broadcast(total)).select(  # one-row side
        "value", "count", X.np_round(F.col("count") * 100.0 / F.col("__t"), places).alias("pct")
    ).orderBy(F.desc("count"), "value")
    return out.limit(top) if top else out


# -- A12 -------------------------------------------------------------------
def rate_by_category(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    """``(feature, category, rate, n)`` for several categorical columns in one pass."""
    long = _long_text(df, cols, [target]).filter(F.col("category").isNotNull())
    return long.groupBy("feature", "category").agg(
        F.avg(target).alias("rate"), F.count(F.lit(1)).alias("n")
    )


# -- A13 -------------------------------------------------------------------
def rate_by_count(df: DataFrame, target: str, col: str) -> DataFrame:
    return df.filter(F.col(col).isNotNull()).groupBy(col).agg(
        F.avg(target).alias("rate"), F.count(F.lit(1)).alias("n")
    )


# -- A14, A15 --------------------------------------------------------------
def group_means(df: DataFrame, by: str, cols: Sequence[str]) -> DataFrame:
    """Transposed ``groupby(by)[cols].mean()``: ``(feature, <by>, mean)``."""
    long = long_values(df, cols, [by], name="feature").filter(F.col(by).isNotNull())
    return long.groupBy("feature", by).agg(F.avg("value").alias("mean"))


def prevalence(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean of each 0/1 flag: ``(feature, prevalence)``."""
    means = df.agg(*[F.avg(F.col(c)).alias(c) for c in cols])
    return means.unpivot([], list(cols), "feature", "prevalence").orderBy(F.desc("prevalence"))


# -- A16-A18 ---------------------------------------------------------------
def pivot_mean(df: DataFrame, rows: str, cols: str, value: str, values: Sequence | None = None) -> DataFrame:
    base = df.filter(F.col(rows).isNotNull() & F.col(cols).isNotNull())
    return base.groupBy(rows).pivot(cols, list(values) if values else None).agg(F.avg(value))


def pivot_count(df: DataFrame, rows: str, cols: str, values: Sequence, names: Sequence[str]) -> DataFrame:
    """Counts per ``rows`` × ``cols`` value, missing cells 0, plus ``total``."""
    base = df.filter(F.col(rows).isNotNull())
    aggs = [F.sum((F.col(cols) == v).cast("long")).alias(n) for v, n in zip(values, names)]
    out = base.groupBy(rows).agg(*aggs)
    total = None
    for n in names:
        total = F.col(n) if total is None else total + F.col(n)
    return out.withColumn("total", total)


def pivot_count_top(df: DataFrame, rows: str, cols: str, values: Sequence, names: Sequence[str], top: int) -> DataFrame:
    return pivot_count(df, rows, cols, values, names).orderBy(F.desc("total"), rows).limit(top)


def crosstab(df: DataFrame, a: str, b: str, values: Sequence, names: Sequence[str]) -> DataFrame:
    return pivot_count(df.filter(F.col(b).isNotNull()), a, b, values, names).drop("total")


# -- A19 -------------------------------------------------------------------
def freq_of_freq(df: DataFrame, key: str, name: str = "per_key") -> DataFrame:
    """How many keys have 1, 2, … rows: ``(per_key, n_keys)``."""
    per = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return per.groupBy(name).agg(F.count(F.lit(1)).alias("n_keys"))


# -- A20 -------------------------------------------------------------------
def describe(df: DataFrame, cols: Sequence[str], accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    """``describe().T``: count, mean, std, min, 25%, 50%, 75%, max per column."""
    long = long_values(df, cols)
    stats = long.groupBy("feature").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    qs = quantile_table(df, cols, [0.25, 0.5, 0.75], names=["p25", "p50", "p75"], accuracy=accuracy)
    return stats.join(qs, "feature", "left")


def describe_categorical(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``describe(include=object)``: count, unique, top (ties → smallest), freq."""
    long = _long_text(df, cols, name="feature", value="value").filter(F.col("value").isNotNull())
    per = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("__c"))
    return per.groupBy("feature").agg(
        F.sum("__c").alias("count"),
        F.count(F.lit(1)).alias("unique"),
        F.min_by("value", F.struct(-F.col("__c"), F.col("value"))).alias("top"),
        F.max("__c").alias("freq"),
    )


# -- A21 -------------------------------------------------------------------
def histogram(df: DataFrame, col: str, bins: int = 40, by: str | None = None) -> DataFrame:
    """Equal-width bins over ``[min, max]``, last bin closed: ``(bin, lo, hi, count)``.

    Empty bins are present with count 0 (the bin list is generated from the
    one-row range per group, never from the data).
    """
    keys = [by] if by else []
    base = df.filter(F.col(col).isNotNull() & (F.col(by).isNotNull() if by else F.lit(True)))
    rng = base.groupBy(*keys).agg(F.min(col).cast("double").alias("__lo"), F.max(col).cast("double").alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    idx = F.least(
        F.floor((F.col(col) - F.col("__lo")) * (F.lit(float(bins)) / (F.col("__hi") - F.col("__lo")))),
        F.lit(bins - 1),
    )
    idx = F.when(F.col("__hi") == F.col("__lo"), F.lit(0)).otherwise(idx).cast("int")
    # one range row per group: AQE broadcasts it when small; no hint, since
    # the number of groups is not bounded in general
    joined = base.join(rng, keys, "inner") if by else base.crossJoin(F.broadcast(rng))
    counts = joined.groupBy(*keys, idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = rng.select(*keys, "__lo", "__hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(counts, [*keys, "bin"], "left").select(
        *keys,
        "bin",
        (F.col("__lo") + F.col("bin") * width).alias("lo"),
        (F.col("__lo") + (F.col("bin") + 1) * width).alias("hi"),
        F.coalesce(F.col("count"), F.lit(0)).alias("count"),
    )


# -- A22 -------------------------------------------------------------------
def box_stats(df: DataFrame, col: str, by: str | Sequence[str] | None = None, whis: float = 1.5,
              accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    """Quartiles, 1.5·IQR whiskers (most extreme data inside the fences) and
    outlier count, per group (rows with a missing group value are left out)."""
    keys = [by] if isinstance(by, str) else list(by or ())
    base = df.filter(F.col(col).isNotNull()).dropna(subset=keys) if keys else df.filter(F.col(col).isNotNull())
    long = exact_quantiles(base, col, [0.25, 0.5, 0.75], keys, accuracy)
    q = long.groupBy(*keys).agg(*[F.max(F.when(F.col("q") == p, F.col("quantile"))).alias(n)
                                  for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    q = q.withColumn("iqr", F.col("q3") - F.col("q1"))
    fences = q.withColumns({"__lf": F.col("q1") - whis * F.col("iqr"), "__uf": F.col("q3") + whis * F.col("iqr")})
    joined = base.join(fences, keys, "inner") if by else base.crossJoin(F.broadcast(fences))
    v = F.col(col)
    inside = (v >= F.col("__lf")) & (v <= F.col("__uf"))
    agg = joined.groupBy(*keys).agg(
        F.min(F.when(inside, v)).cast("double").alias("lower_whisker"),
        F.max(F.when(inside, v)).cast("double").alias("upper_whisker"),
        F.sum((~inside).cast("long")).alias("n_outliers"),
        F.count(F.lit(1)).alias("n"),
    )
    return q.join(agg, keys, "inner") if by else q.crossJoin(agg)


# -- A23, A24 --------------------------------------------------------------
#: Groups that partitions' blocks are merged in before the driver merges those.
MERGE_GROUPS = 64


class PairMoments:
    """Counts, means and centred sums of all pairs of columns over the rows that
    have both: ``n``, ``mean[i, j]`` and ``square[i, j]`` of column i where j is
    present, and ``cross``.  Blocks merge exactly as their rows would."""

    def __init__(self, n, mean, square, cross):
        self.n, self.mean, self.square, self.cross = n, mean, square, cross

    @staticmethod
    def empty(c: int) -> "PairMoments":
        return PairMoments(*(np.zeros((c, c)) for _ in range(4)))

    @staticmethod
    def of(x: np.ndarray) -> "PairMoments":
        """Of a block of rows (missing: NaN): masked matrix products."""
        there = ~np.isnan(x)
        count = there.sum(axis=0)
        shift = np.where(there, x, 0.0).sum(axis=0) / np.maximum(count, 1)  # keeps the products small
        z, m = np.where(there, x - shift, 0.0), there.astype(float)
        n = m.T @ m
        total, square, cross = z.T @ m, (z * z).T @ m, z.T @ z
        some = np.maximum(n, 1)
        return PairMoments(n, np.where(n > 0, shift[:, None] + total / some, 0.0), square - total ** 2 / some, cross - total * total.T / some)

    def __add__(self, other: "PairMoments") -> "PairMoments":
        n = self.n + other.n
        some = np.maximum(n, 1)
        gap = other.mean - self.mean
        share = self.n * other.n / some
        return PairMoments(n, self.mean + gap * other.n / some, self.square + other.square + gap ** 2 * share,
                           self.cross + other.cross + gap * gap.T * share)

    def correlations(self) -> np.ndarray:
        """NaN where either column does not vary over the pair's rows."""
        able = (self.n > 1) & (self.square > 0) & (self.square.T > 0)
        return np.where(able, self.cross / np.sqrt(np.where(able, self.square * self.square.T, 1.0)), np.nan)

    def to_bytes(self) -> bytes:
        return np.stack([self.n, self.mean, self.square, self.cross]).tobytes()

    @staticmethod
    def from_bytes(raw, c: int) -> "PairMoments":
        return PairMoments(*np.frombuffer(raw, float).reshape(4, c, c).copy())


def pair_moments(df: DataFrame, cols: Sequence[str]) -> PairMoments:
    """One pass over the columns: a block for each partition, merged in groups."""
    c = len(cols)

    def blocks(batches):
        total, part = PairMoments.empty(c), 0
        for b in batches:
            total += PairMoments.of(np.column_stack([col.to_numpy(zero_copy_only=False) for col in b.columns]).astype(float))
        if (context := TaskContext.get()) is not None:
            part = context.partitionId() % MERGE_GROUPS
        yield pa.record_batch([pa.array([part], pa.int32()), pa.array([total.to_bytes()], pa.binary())], names=["part", "block"])

    def merge(t: pa.Table) -> pa.Table:
        total = PairMoments.empty(c)
        for raw in t.column("block").to_pylist():
            total += PairMoments.from_bytes(raw, c)
        return pa.table([t.column("part").slice(0, 1), pa.array([total.to_bytes()], pa.binary())], names=["part", "block"])

    rows = df.select(*[F.coalesce(F.col(x).cast("double"), F.lit(float("nan"))).alias(f"c{i}") for i, x in enumerate(cols)])
    found = rows.mapInArrow(blocks, "part int, block binary").groupBy("part").applyInArrow(merge, "part int, block binary").collect()
    total = PairMoments.empty(c)
    for r in sorted(found, key=lambda r: r.part):
        total += PairMoments.from_bytes(r.block, c)
    return total


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Long ``(x, y, corr)`` for every ordered pair over the rows that have
    both, diagonal 1; null where a column does not vary or under two rows are
    left.  Three matrix products a block instead of aggregates a pair."""
    cols = list(cols)
    r = pair_moments(df, cols).correlations()
    value = lambda i, j: None if np.isnan(r[i, j]) else 1.0 if i == j else float(np.clip(r[i, j], -1.0, 1.0))
    return df.sparkSession.createDataFrame([(a, b, value(i, j)) for i, a in enumerate(cols) for j, b in enumerate(cols)], "x string, y string, corr double")


def pair_correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Pairwise-complete Pearson for each ``(x, y)`` pair: one row, one column
    ``{x}__{y}`` per pair, by covariance and variance aggregates; zero variance
    or < 2 rows → null."""
    out = []
    for a, b in pairs:
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        both = x.isNotNull() & y.isNotNull()
        va, vb = F.var_samp(F.when(both, x)), F.var_samp(F.when(both, y))
        r = F.when((va > 0) & (vb > 0), F.covar_samp(x, y) / (F.sqrt(va) * F.sqrt(vb)))
        out.append(r.alias(f"{a}__{b}"))
    return df.agg(*out)


def corr_with(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    one = pair_correlations(df, [(c, target) for c in cols])
    return one.select(*[F.col(f"{c}__{target}").alias(c) for c in cols]).unpivot([], list(cols), "feature", "corr")


def corr_top(df: DataFrame, target: str, cols: Sequence[str], k: int) -> DataFrame:
    """Top ``k`` features by absolute correlation with ``target`` (a top-k report)."""
    c = corr_with(df, target, cols).filter(F.col("corr").isNotNull())
    return c.orderBy(F.desc(F.rint(F.abs("corr") * 1e9)), "feature").limit(k)  # equal to nine places: a tie


# -- A25 -------------------------------------------------------------------
def scatter_bins(df: DataFrame, x: str, y: str, bins: int = 20, by: str | None = None) -> DataFrame:
    """2-D equal-width binned counts of complete ``(x, y)`` pairs — the scatter
    plot's data at any scale: ``(*by, bx, by_, count)``."""
    keys = [by] if by else []
    base = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    rng = base.agg(F.min(x).cast("double").alias("__x0"), F.max(x).cast("double").alias("__x1"),
                   F.min(y).cast("double").alias("__y0"), F.max(y).cast("double").alias("__y1"))

    def idx(c, lo, hi):
        raw = F.least(F.floor((F.col(c) - F.col(lo)) * (F.lit(float(bins)) / (F.col(hi) - F.col(lo)))), F.lit(bins - 1))
        return F.when(F.col(hi) == F.col(lo), F.lit(0)).otherwise(raw).cast("int")

    j = base.crossJoin(F.broadcast(rng))  # one-row side
    return j.groupBy(*keys, idx(x, "__x0", "__x1").alias("x_bin"), idx(y, "__y0", "__y1").alias("y_bin")).agg(
        F.count(F.lit(1)).alias("count")
    )


def density_curves(df: DataFrame, cols: Sequence[str], by: str, points: int = 200, cut: float = 3.0) -> DataFrame:
    """``(feature, by, x, density)``: Gaussian kernel densities per group at
    ``points`` even places, from ``cut`` bandwidths below the group's least value
    to as many above its largest; Scott's bandwidth, s n^(-1/5).

    Each value is dealt to the two places beside it, so groups become counts at
    the places (one aggregate), and only places meet places.  Rows without the
    value or the group are left out; groups of one row or of equal values have
    no curve."""
    long = df.select(by, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot([by], list(cols), "feature", "v").where(F.col("v").isNotNull() & F.col(by).isNotNull())
    stats = long.groupBy("feature", by).agg(F.count("v").alias("n"), F.stddev_samp("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi")).where("s > 0")
    h = F.col("s") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    stats = stats.select("feature", by, "n", h.alias("h"), (F.col("lo") - cut * h).alias("x0"), ((F.col("hi") - F.col("lo") + 2 * cut * h) / (points - 1)).alias("step"))
    at = (F.col("v") - F.col("x0")) / F.col("step")
    low = F.least(F.floor(at), F.lit(points - 2))
    dealt = long.join(F.broadcast(stats), ["feature", by])  # a row per feature and group
    dealt = dealt.select("feature", by, F.explode(F.array(F.struct(low.alias("k"), (1 - (at - low)).alias("w")), F.struct((low + 1).alias("k"), (at - low).alias("w")))).alias("p"))
    counts = dealt.groupBy("feature", by, F.col("p.k").alias("k")).agg(F.sum("p.w").alias("w")).where("w > 0")
    grid = stats.withColumn("__g", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    z = (F.col("__g") - F.col("k")) * F.col("step") / F.col("h")
    kernel = F.sum(F.col("w") * F.exp(-z * z / 2)) / (F.first("n") * F.first("h") * (2 * math.pi) ** 0.5)
    return (counts.join(grid, ["feature", by]).groupBy("feature", by, "__g").agg(kernel.alias("density"), F.first(F.col("x0") + F.col("__g") * F.col("step")).alias("x"))
            .select("feature", by, "x", "density"))
