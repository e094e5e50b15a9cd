"""Registered daily-series queries.

The series is the reference's: daily sum of ``num_ed_visits`` over the
admission date of the master dataset, reindexed to every calendar day.
"""

from __future__ import annotations

from wardline.operators import series as S
from wardline.plans import oracle as O
from wardline.plans.catalog import master, register

# The driver's orders span 1995-01-01 … 2001-08-01; the reference's cut
# (train through the last full year, test from the next day) is applied to
# that range.  Dates are parameters of every operator.
TRAIN_END = "2000-12-31"
TEST_START = "2001-01-01"


def daily(spark, sf_dir):
    return S.daily_series(master(spark, sf_dir), "admission_date", "num_ed_visits")


_W = "PARTITION BY series ORDER BY date"
SERIES_SQL = {
    "ds_sum": """
  SELECT 'all' AS series, CAST(admission_date AS DATE) AS date, CAST(coalesce(sum(num_ed_visits), 0) AS DOUBLE) AS value
  FROM master WHERE admission_date IS NOT NULL GROUP BY 1, 2""",
    "ds_cal": """
  SELECT series, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
  FROM ds_sum GROUP BY series""",
    "ds_nb": f"""
  SELECT c.series, c.date, d.value,
    last_value(CASE WHEN d.value IS NOT NULL THEN c.date END IGNORE NULLS) OVER (
      PARTITION BY c.series ORDER BY c.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pd,
    last_value(d.value IGNORE NULLS) OVER (
      PARTITION BY c.series ORDER BY c.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
    first_value(CASE WHEN d.value IS NOT NULL THEN c.date END IGNORE NULLS) OVER (
      PARTITION BY c.series ORDER BY c.date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nd,
    first_value(d.value IGNORE NULLS) OVER (
      PARTITION BY c.series ORDER BY c.date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv
  FROM ds_cal c LEFT JOIN ds_sum d ON c.series = d.series AND c.date = d.date""",
    "daily": """
  SELECT series, date,
    CASE WHEN value IS NOT NULL THEN value WHEN nd IS NULL THEN pv
         ELSE pv + (nv - pv) * (date_diff('day', pd, date) / date_diff('day', pd, nd)) END AS value,
    value IS NULL AS filled
  FROM ds_nb""",
    "dc_b1": f"""
  SELECT *, CASE WHEN count(value) OVER w7 = 7 THEN avg(value) OVER w7 END AS ma
  FROM (SELECT series, date, value, row_number() OVER ({_W}) - 1 AS idx FROM daily)
  WINDOW w7 AS ({_W} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""",
    "dc_b2": """
  SELECT b.*, e.front, e.back,
    b.idx >= e.front AND b.idx < least(e.front + 7, e.back) AS inf,
    b.idx >= greatest(e.front, e.back - 7) AND b.idx < e.back AS inb
  FROM dc_b1 b JOIN (SELECT series, min(CASE WHEN ma IS NOT NULL THEN idx END) AS front,
                            max(CASE WHEN ma IS NOT NULL THEN idx END) AS back FROM dc_b1 GROUP BY series) e
  USING (series)""",
    "dc_b3": """
  SELECT b.*, CASE WHEN idx < front THEN kf * idx + nf WHEN idx > back THEN kb * idx + nb ELSE ma END AS trend,
         idx % 7 AS phase
  FROM dc_b2 b JOIN (
    SELECT series,
      regr_slope(CASE WHEN inf THEN ma END, CASE WHEN inf THEN CAST(idx AS DOUBLE) END) AS kf,
      regr_intercept(CASE WHEN inf THEN ma END, CASE WHEN inf THEN CAST(idx AS DOUBLE) END) AS nf,
      regr_slope(CASE WHEN inb THEN ma END, CASE WHEN inb THEN CAST(idx AS DOUBLE) END) AS kb,
      regr_intercept(CASE WHEN inb THEN ma END, CASE WHEN inb THEN CAST(idx AS DOUBLE) END) AS nb
    FROM dc_b2 GROUP BY series) l USING (series)""",
    "decomp": """
  SELECT b.series, b.date, b.idx, b.value AS observed, b.trend, p.seasonal, b.value - b.trend - p.seasonal AS resid
  FROM dc_b3 b JOIN (
    SELECT series, phase, pm - avg(pm) OVER (PARTITION BY series) AS seasonal
    FROM (SELECT series, phase, avg(value - trend) AS pm FROM dc_b3 GROUP BY series, phase)) p
  USING (series, phase)""",
}


def q(body: str, *needed: str) -> str:
    return O.with_ctes(body, "master", *needed, extra=SERIES_SQL)


@register("daily_series", q("SELECT * FROM daily"), settle=["value"])
def _daily_series(spark, sf_dir):
    return daily(spark, sf_dir)


@register("series_summary", q("""
SELECT series, min(date) AS start, max(date) AS "end", count(*) AS n_days,
  CAST(sum(CAST(filled AS INTEGER)) AS BIGINT) AS n_missing, avg(value) AS mean, min(value) AS min, max(value) AS max
FROM daily GROUP BY series"""), settle=["mean", "min", "max"])
def _series_summary(spark, sf_dir):
    return S.series_summary(daily(spark, sf_dir))


@register("weekly_mean", q("""
SELECT series, CAST(date_trunc('week', date) AS DATE) + 6 AS week_end, avg(value) AS mean
FROM daily GROUP BY 1, 2"""), settle=["mean"])
def _weekly_mean(spark, sf_dir):
    return S.weekly_mean(daily(spark, sf_dir))


@register("weekday_profile", q(f"""
SELECT s.series, CAST(g.wd AS INTEGER) AS weekday,
  {repr(S.DAY_NAMES).replace('"', "'")}[g.wd + 1] AS day_name, coalesce(m.mean, 0.0) AS mean
FROM (SELECT DISTINCT series FROM daily) s CROSS JOIN range(7) g(wd)
LEFT JOIN (SELECT series, isodow(date) - 1 AS wd, avg(value) AS mean FROM daily GROUP BY 1, 2) m
  ON m.series = s.series AND m.wd = g.wd"""), settle=["mean"])
def _weekday_profile(spark, sf_dir):
    return S.weekday_profile(daily(spark, sf_dir))


@register("lag_features", q(f"""
SELECT series, date, value, filled, lag(value, 1) OVER ({_W}) AS lag_1, lag(value, 7) OVER ({_W}) AS lag_7,
  CASE WHEN count(value) OVER ({_W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) = 7
       THEN avg(value) OVER ({_W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) END AS rolling_mean_7
FROM daily"""), settle=["value", "lag_1", "lag_7", "rolling_mean_7"])
def _lag_features(spark, sf_dir):
    return S.lag_features(daily(spark, sf_dir))


@register("last_k", q(f"""
SELECT series, date, value, filled FROM daily WHERE date <= DATE '{TRAIN_END}'
QUALIFY row_number() OVER (PARTITION BY series ORDER BY date DESC) <= 7"""), settle=["value"])
def _last_k(spark, sf_dir):
    return S.last_k(daily(spark, sf_dir), 7, before=TRAIN_END)


@register("time_split", q(f"""
SELECT *, CASE WHEN date <= DATE '{TRAIN_END}' THEN 'train' WHEN date >= DATE '{TEST_START}' THEN 'test' END AS split
FROM daily"""), settle=["value"])
def _time_split(spark, sf_dir):
    return S.time_split(daily(spark, sf_dir), TRAIN_END, TEST_START)


@register("seasonal_decompose", q("SELECT * FROM decomp"), settle=["observed", "trend", "seasonal", "resid"])
def _seasonal_decompose(spark, sf_dir):
    return S.seasonal_decompose(daily(spark, sf_dir), 7)


@register("seasonal_strength", q("""
SELECT series, strength, strength > 0.30 AS is_seasonal,
  CASE WHEN strength > 0.30 THEN 'SARIMAX' ELSE 'ARIMA' END AS model_choice
FROM (SELECT series, greatest(0.0, 1.0 - var_pop(resid) / NULLIF(var_pop(seasonal + resid), 0)) AS strength
      FROM decomp GROUP BY series)"""), settle=["strength"])
def _seasonal_strength(spark, sf_dir):
    return S.seasonal_strength(S.seasonal_decompose(daily(spark, sf_dir), 7))
