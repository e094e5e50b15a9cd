"""Exact quantiles (linear interpolation, as pandas/NumPy) without one-task groups.

``percentile`` (exact) keeps every distinct value of a group in one
aggregation buffer, and sorting a whole group in one window does the same.
Instead:

1. one aggregate per group: ``count`` and ``percentile_approx`` at
   ``q ± 2/accuracy`` — the sketch's rank error is at most ``n/accuracy``,
   so the exact order statistics needed for ``q`` lie inside that band;
2. one pass counts the values below the band and reduces the values inside
   it to ``(value, multiplicity)``;
3. a window over each ``(group, q)`` band (≈ ``4n/accuracy`` distinct
   values, never the group) turns multiplicities into rank ranges, and the
   two order statistics around ``(n-1)·q`` are interpolated.

Ties cost nothing: a value repeated a billion times is one band row.

Many columns without groups (``column_quantiles``) need neither a row per value
nor a sketch per column: doubles map to 64-bit integers of the same order, and
passes over the columns as they are count them by 16 leading bits at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_ACCURACY = 10_000
DIGIT = 16  # bits that a pass of ``column_quantiles`` tells apart
_LOW = np.int64((1 << 63) - 1)
_BINS = "slot int, bin long, n long, lo long, hi long"


def _ranked_pick(base: DataFrame, bands: DataFrame, by: list[str], few: bool) -> DataFrame:
    """One pass over ``base`` ⋈ ``bands``: rows below / inside / above each
    band become (class, value, multiplicity) rows — two summary rows plus the
    distinct in-band values — ranked by one window per (group, q)."""
    keys = [*by, "q"]
    # ``few``: the caller knows that the number of groups does not grow with the data
    joined = base.join(F.broadcast(bands) if few else bands, by, "inner") if by else base.crossJoin(F.broadcast(bands))
    v, lo, hi = F.col("__v"), F.col("lo"), F.col("hi")
    cls = F.when(v < lo, 0).when(v > hi, 2).otherwise(1)
    red = joined.groupBy(*keys, cls.alias("__c"), F.when(cls == 1, v).alias("__iv")).agg(
        F.count(F.lit(1)).alias("__m"),
        F.max(v).alias("__vmax"),  # for class 0: the largest value below the band
        F.min(v).alias("__vmin"),  # for class 2: the smallest value above it
    )
    w = Window.partitionBy(*keys).orderBy("__c", "__iv").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        red.join(bands.select(*keys, "__h", "__r0", "__r1"), keys, "inner")
        .withColumn("__end", F.sum("__m").over(w))
        .withColumn("__start", F.col("__end") - F.col("__m"))
        .withColumn("__val", F.when(F.col("__c") == 1, F.col("__iv"))
                    .when(F.col("__c") == 0, F.col("__vmax")).otherwise(F.col("__vmin")))
    )
    # a summary row only stands for the single rank next to the band
    ok0 = F.when(F.col("__c") == 0, F.col("__r0") == F.col("__end") - 1).when(
        F.col("__c") == 2, F.col("__r0") == F.col("__start")).otherwise(
        (F.col("__start") <= F.col("__r0")) & (F.col("__r0") < F.col("__end")))
    ok1 = F.when(F.col("__c") == 0, F.col("__r1") == F.col("__end") - 1).when(
        F.col("__c") == 2, F.col("__r1") == F.col("__start")).otherwise(
        (F.col("__start") <= F.col("__r1")) & (F.col("__r1") < F.col("__end")))
    picked = ranked.groupBy(*keys).agg(
        F.max(F.when(ok0, F.col("__val"))).alias("__v0"),
        F.max(F.when(ok1, F.col("__val"))).alias("__v1"),
        F.first("__h").alias("__h"),
        F.first("__r0").alias("__r0"),
    )
    v0, v1 = F.col("__v0"), F.col("__v1")
    return picked.select(*keys, (v0 + (F.col("__h") - F.col("__r0")) * (v1 - v0)).alias("quantile"))


def exact_quantiles(
    df: DataFrame,
    value: str,
    qs: Sequence[float],
    by: Iterable[str] = (),
    accuracy: int = DEFAULT_ACCURACY,
    few: bool = False,
) -> DataFrame:
    """Rows ``(*by, q, quantile)``; null values are ignored, empty groups absent.

    ``few`` says that there are a fixed number of groups (such as a list of
    column names), so that the band table is small and may be broadcast.
    """
    by = list(by)
    eps = 2.0 / accuracy
    qs = [float(q) for q in qs]
    probes = sorted({min(1.0, max(0.0, q + d)) for q in qs for d in (-eps, 0.0, eps)})
    idx = {p: i for i, p in enumerate(probes)}

    base = df.select(*by, F.col(value).cast("double").alias("__v")).filter(F.col("__v").isNotNull())
    sketch = base.groupBy(*by).agg(
        F.count("__v").alias("__n"),
        F.percentile_approx("__v", probes, accuracy).alias("__a"),
    )
    bands = sketch.select(
        *by,
        "__n",
        F.explode(F.array(*[
            F.struct(
                F.lit(q).alias("q"),
                F.col("__a")[idx[min(1.0, max(0.0, q - eps))]].alias("lo"),
                F.col("__a")[idx[min(1.0, max(0.0, q + eps))]].alias("hi"),
            )
            for q in qs
        ])).alias("__b"),
    ).select(*by, "__n", "__b.q", "__b.lo", "__b.hi")
    # the band for q=0 / q=1 must reach the extremes exactly
    bands = bands.withColumns({
        "lo": F.when(F.col("q") <= eps, F.lit(float("-inf"))).otherwise(F.col("lo")),
        "hi": F.when(F.col("q") >= 1 - eps, F.lit(float("inf"))).otherwise(F.col("hi")),
        "__h": (F.col("__n") - 1) * F.col("q"),
    })
    bands = bands.withColumns({
        "__r0": F.floor("__h").cast("long"),
        "__r1": F.least(F.floor("__h").cast("long") + 1, F.col("__n") - 1),
    })
    return _ranked_pick(base, bands, by, few)


def long_values(df: DataFrame, cols: Sequence[str], by: Iterable[str] = (), name: str = "feature") -> DataFrame:
    """``(*by, column, value)`` rows for several numeric columns (one scan)."""
    by = list(by)
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias("value")) for c in cols
    ])).alias("__p")
    return df.select(*by, pairs).select(*by, f"__p.{name}", "__p.value")


def quantile_table(
    df: DataFrame, cols: Sequence[str], qs: Sequence[float], by: Iterable[str] = (), names: Sequence[str] | None = None,
    accuracy: int = DEFAULT_ACCURACY,
) -> DataFrame:
    """Wide ``(*by, feature, <name per q>)`` table of exact quantiles."""
    by = list(by)
    names = list(names) if names else [f"q{int(round(q * 100))}" for q in qs]
    long = exact_quantiles(long_values(df, cols, by), "value", qs, [*by, "feature"], accuracy, few=not by)
    out = long.groupBy(*by, "feature").agg(*[
        F.max(F.when(F.col("q") == float(q), F.col("quantile"))).alias(n) for q, n in zip(qs, names)
    ])
    return out


# -- many columns, no groups ----------------------------------------------------
def _keys(values: np.ndarray) -> np.ndarray:
    """Integers in the order of the doubles (-0 as 0, NaN last)."""
    x = values + 0.0
    x[np.isnan(x)] = np.nan
    bits = x.view(np.int64)
    return bits ^ ((bits >> 63) & _LOW)


def _value(key: int) -> float:
    k = np.array([key], np.int64)
    return float((k ^ ((k >> 63) & _LOW)).view(np.float64)[0])


def _bins_of(parts: list[tuple]) -> tuple:
    """``(bin, n, lowest key, highest key)`` of the parts, once per bin."""
    b, n, lo, hi = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(b, kind="stable")
    b = b[order]
    at = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
    return b[at], np.add.reduceat(n[order], at), np.minimum.reduceat(lo[order], at), np.maximum.reduceat(hi[order], at)


def _count_bins(shift: int, wanted: list[tuple[int, list[int] | None]]):
    """Counts of ``key >> shift`` per column; ``wanted`` has the slot of each
    column and the leading bits that its keys must have (None: any)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple]] = [[] for _ in wanted]
        for batch in batches:
            for parts, (_, prefixes), column in zip(held, wanted, batch.columns):
                keys = _keys(column.drop_null().to_numpy(zero_copy_only=False))
                if prefixes is not None:
                    keys = keys[np.isin(keys >> np.int64(shift + DIGIT), prefixes)]
                if not len(keys):
                    continue
                keys = np.sort(keys)
                bins = keys >> np.int64(shift)
                at = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
                end = np.append(at[1:], len(keys))
                parts.append((bins[at], end - at, keys[at], keys[end - 1]))
                if len(parts) == 32:
                    parts[:] = [_bins_of(parts)]
        for parts, (slot, _) in zip(held, wanted):
            if parts:
                b, *rest = _bins_of(parts)
                yield pa.record_batch([pa.array(np.full(len(b), slot, np.int32)), pa.array(b), *map(pa.array, rest)],
                                      names=["slot", "bin", "n", "lo", "hi"])

    return run


def column_quantiles(df: DataFrame, cols: Sequence[str], qs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """``(feature, <name per q>)`` of exact quantiles; nulls are ignored, columns
    without values absent.

    Each pass counts the keys of every column by ``DIGIT`` more bits, in the
    bins that hold a wanted rank; a task sends a row per bin that it meets.  A
    rank is found when it is the lowest or highest key of its bin, so small
    integers need one pass and no column more than four.  Runs at once and reads
    ``df`` in every pass: hand it a stored table."""
    cols, qs = list(cols), [float(q) for q in qs]
    total: dict[int, int] = {}
    found: dict[tuple[int, int], float] = {}
    open_: list[tuple[int, int, int, int]] = []  # slot, leading bits, rank among these, rank in the column
    for shift in range(64 - DIGIT, -1, -DIGIT):
        first = shift == 64 - DIGIT
        slots = list(range(len(cols))) if first else sorted({o[0] for o in open_})
        if not slots:
            break
        wanted = [(i, None if first else sorted({o[1] for o in open_ if o[0] == i})) for i in slots]
        read = df.select(*[F.col(cols[i]).cast("double").alias(f"c{i}") for i in slots])
        bins = read.mapInArrow(_count_bins(shift, wanted), _BINS).groupBy("slot", "bin").agg(
            F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        bins = bins.withColumn("prefix", F.lit(0).cast("long") if first else F.shiftright("bin", DIGIT))
        group = Window.partitionBy("slot", "prefix")  # at most 2^DIGIT bins
        bins = bins.withColumns({"end": F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)),
                                 "total": F.sum("n").over(group)})
        if first:
            below = [F.floor((F.col("total") - 1) * F.lit(q)) for q in qs]
            ranks = F.array_distinct(F.array(*below, *[F.least(r + 1, F.col("total") - 1) for r in below]))
            bins = bins.withColumn("rank", F.explode(ranks)).withColumn("whole", F.col("rank"))
        else:
            spark = df.sparkSession
            targets = spark.createDataFrame(open_, "slot int, prefix long, rank long, whole long")
            bins = bins.join(F.broadcast(targets), ["slot", "prefix"])
        open_ = []
        for r in bins.where((F.col("end") - F.col("n") <= F.col("rank")) & (F.col("rank") < F.col("end"))).collect():
            total.setdefault(r.slot, r.total)
            rank = r.rank - (r.end - r.n)
            if rank in (0, r.n - 1) or r.lo == r.hi:
                found[r.slot, r.whole] = _value(r.lo if rank == 0 else r.hi)
            else:
                open_.append((r.slot, r.bin, rank, r.whole))
    rows = []
    for i, n in sorted(total.items()):
        row = [cols[i]]
        for q in qs:
            h = (n - 1) * q
            r0 = int(h)
            v0, v1 = found[i, r0], found[i, min(r0 + 1, n - 1)]
            row.append(v0 + (h - r0) * (v1 - v0))
        rows.append(tuple(row))
    return df.sparkSession.createDataFrame(rows, "feature string, " + ", ".join(f"`{n}` double" for n in names))
