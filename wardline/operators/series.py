"""Daily series operators.

A series is a DataFrame ``(series, date, value)``; every window is
``partitionBy("series")`` ordered by date, so a window partition holds one
series — at most one row per calendar day — whatever the size of the detail
table it was aggregated from.  Many series run in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = "series"


def _w(order: str = "date") -> Window:
    return Window.partitionBy(SERIES).orderBy(order)


# -- A8 --------------------------------------------------------------------
def daily_sum(df: DataFrame, date_col: str, value_col: str, series: Column | str | None = None) -> DataFrame:
    """Sum of ``value_col`` per calendar day (null dates dropped)."""
    key = F.lit("all") if series is None else (F.col(series) if isinstance(series, str) else series)
    return (
        df.filter(F.col(date_col).isNotNull())
        .groupBy(key.alias(SERIES), F.to_date(date_col).alias("date"))
        .agg(F.coalesce(F.sum(F.col(value_col)), F.lit(0)).cast("double").alias("value"))  # all-missing sum is 0
    )


# -- J5, W3 ----------------------------------------------------------------
def calendar_fill(s: DataFrame) -> DataFrame:
    """Reindex each series to every day between its first and last date and
    fill the gaps by linear interpolation in time: ``(series, date, value,
    filled)``."""
    bounds = s.groupBy(SERIES).agg(F.min("date").alias("__d0"), F.max("date").alias("__d1"))
    cal = bounds.select(SERIES, F.explode(F.sequence("__d0", "__d1", F.expr("INTERVAL 1 DAY"))).alias("date"))
    full = cal.join(s, [SERIES, "date"], "left")
    prev_w = _w().rowsBetween(Window.unboundedPreceding, 0)
    next_w = _w().rowsBetween(0, Window.unboundedFollowing)
    known_d = F.when(F.col("value").isNotNull(), F.col("date"))
    full = full.withColumns({
        "__pd": F.last(known_d, ignorenulls=True).over(prev_w),
        "__pv": F.last("value", ignorenulls=True).over(prev_w),
        "__nd": F.first(known_d, ignorenulls=True).over(next_w),
        "__nv": F.first("value", ignorenulls=True).over(next_w),
    })
    gap = F.datediff("__nd", "__pd")
    frac = F.datediff("date", "__pd") / gap
    interp = F.when(F.col("value").isNotNull(), F.col("value")).when(
        F.col("__nd").isNull(), F.col("__pv")  # trailing gap: pandas carries the last value
    ).otherwise(F.col("__pv") + (F.col("__nv") - F.col("__pv")) * frac)
    return full.select(SERIES, "date", interp.alias("value"), F.col("value").isNull().alias("filled"))


def daily_series(df: DataFrame, date_col: str, value_col: str, series: str | None = None) -> DataFrame:
    """Daily sums, calendar reindex, time interpolation."""
    return calendar_fill(daily_sum(df, date_col, value_col, series))


def series_summary(s: DataFrame) -> DataFrame:
    return s.groupBy(SERIES).agg(
        F.min("date").alias("start"),
        F.max("date").alias("end"),
        F.count(F.lit(1)).alias("n_days"),
        F.sum(F.col("filled").cast("long")).alias("n_missing"),
        F.avg("value").alias("mean"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )


# -- A9, A10 ---------------------------------------------------------------
def weekly_mean(s: DataFrame) -> DataFrame:
    """``resample('W').mean()``: weeks end on Sunday and are labelled by it."""
    week_end = F.date_add(F.to_date(F.date_trunc("week", "date")), 6)
    return s.groupBy(SERIES, week_end.alias("week_end")).agg(F.avg("value").alias("mean"))


# Weekday names in reporting order, Monday first.
DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def weekday_profile(s: DataFrame) -> DataFrame:
    """Mean by weekday for every weekday, absent weekdays 0:
    ``(series, weekday, day_name, mean)``."""
    means = s.groupBy(SERIES, F.weekday("date").alias("weekday")).agg(F.avg("value").alias("mean"))
    grid = s.select(SERIES).distinct().select(SERIES, F.explode(F.sequence(F.lit(0), F.lit(6))).alias("weekday"))
    names = F.element_at(F.array(*[F.lit(n) for n in DAY_NAMES]), F.col("weekday") + 1)
    return grid.join(means, [SERIES, "weekday"], "left").select(
        SERIES, "weekday", names.alias("day_name"), F.coalesce("mean", F.lit(0.0)).alias("mean")
    )


# -- W1, W2 ----------------------------------------------------------------
def lag_features(s: DataFrame, lags: Sequence[int] = (1, 7), window: int = 7, include_current: bool = True) -> DataFrame:
    """``lag_k`` and ``rolling_mean_{window}`` (null until the window is full).

    ``include_current=True`` matches the training code (the window ends on the
    day being predicted); ``False`` gives the serving-time window that ends
    the day before.
    """
    w = _w()
    end = 0 if include_current else -1
    frame = w.rowsBetween(end - window + 1, end)
    full = F.count("value").over(frame) == window
    out = s.withColumns({f"lag_{k}": F.lag("value", k).over(w) for k in lags})
    return out.withColumn(f"rolling_mean_{window}", F.when(full, F.avg("value").over(frame)))


# -- W9 ----------------------------------------------------------------------
def last_k(s: DataFrame, k: int, before=None) -> DataFrame:
    """The last ``k`` days of each series (optionally on or before a date)."""
    base = s if before is None else s.filter(F.col("date") <= F.lit(before).cast("date"))
    w = Window.partitionBy(SERIES).orderBy(F.desc("date"))
    return base.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= k).drop("__rn")


# -- T2 ----------------------------------------------------------------------
def time_split(s: DataFrame, train_end: str, test_start: str) -> DataFrame:
    d = F.col("date")
    part = F.when(d <= F.lit(train_end).cast("date"), "train").when(d >= F.lit(test_start).cast("date"), "test")
    return s.withColumn("split", part)


# -- X3, W4 ------------------------------------------------------------------
def seasonal_decompose(s: DataFrame, period: int = 7) -> DataFrame:
    """Additive decomposition with a centred moving-average trend whose ends
    are extrapolated by least-squares lines through ``period`` trend points
    (front: the first ``period``; back: the ``period`` before the last), the
    seasonal part is the centred per-phase mean of the detrended series.
    Odd ``period`` only.  ``(series, date, idx, observed, trend, seasonal, resid)``.
    """
    if period % 2 != 1:
        raise ValueError("odd period required")
    h = period // 2
    w = _w()
    base = s.withColumn("idx", (F.row_number().over(w) - 1).cast("long"))
    ma_frame = w.rowsBetween(-h, h)
    base = base.withColumn(
        "__ma", F.when(F.count("value").over(ma_frame) == period, F.avg("value").over(ma_frame))
    )
    ends = base.groupBy(SERIES).agg(
        F.min(F.when(F.col("__ma").isNotNull(), F.col("idx"))).alias("__front"),
        F.max(F.when(F.col("__ma").isNotNull(), F.col("idx"))).alias("__back"),
    )
    b = base.join(ends, SERIES)
    in_front = (F.col("idx") >= F.col("__front")) & (F.col("idx") < F.least(F.col("__front") + period, F.col("__back")))
    in_back = (F.col("idx") >= F.greatest(F.col("__front"), F.col("__back") - period)) & (F.col("idx") < F.col("__back"))
    x = F.col("idx").cast("double")
    lines = b.groupBy(SERIES).agg(
        F.regr_slope(F.when(in_front, F.col("__ma")), F.when(in_front, x)).alias("__kf"),
        F.regr_intercept(F.when(in_front, F.col("__ma")), F.when(in_front, x)).alias("__nf"),
        F.regr_slope(F.when(in_back, F.col("__ma")), F.when(in_back, x)).alias("__kb"),
        F.regr_intercept(F.when(in_back, F.col("__ma")), F.when(in_back, x)).alias("__nb"),
    )
    b = b.join(lines, SERIES)
    trend = (
        F.when(F.col("idx") < F.col("__front"), F.col("__kf") * x + F.col("__nf"))
        .when(F.col("idx") > F.col("__back"), F.col("__kb") * x + F.col("__nb"))
        .otherwise(F.col("__ma"))
    )
    b = b.withColumn("trend", trend).withColumn("__phase", F.col("idx") % period)
    phase = b.groupBy(SERIES, "__phase").agg(F.avg(F.col("value") - F.col("trend")).alias("__pm"))
    phase = phase.withColumn("seasonal", F.col("__pm") - F.avg("__pm").over(Window.partitionBy(SERIES)))
    out = b.join(phase.select(SERIES, "__phase", "seasonal"), [SERIES, "__phase"])
    return out.select(
        SERIES, "date", "idx", F.col("value").alias("observed"), "trend", "seasonal",
        (F.col("value") - F.col("trend") - F.col("seasonal")).alias("resid"),
    )


# -- X4, X5 ------------------------------------------------------------------
def seasonal_strength(decomp: DataFrame, threshold: float = 0.30) -> DataFrame:
    """``max(0, 1 - var(resid) / var(seasonal + resid))`` (population variances);
    above ``threshold`` the series is seasonal and gets the seasonal model."""
    agg = decomp.groupBy(SERIES).agg(
        F.var_pop("resid").alias("__vr"),
        F.var_pop(F.col("seasonal") + F.col("resid")).alias("__vsr"),
    )
    strength = F.greatest(F.lit(0.0), F.lit(1.0) - F.try_divide(F.col("__vr"), F.col("__vsr")))
    return agg.select(
        SERIES,
        strength.alias("strength"),
        (strength > threshold).alias("is_seasonal"),
        F.when(strength > threshold, "SARIMAX").otherwise("ARIMA").alias("model_choice"),
    )
