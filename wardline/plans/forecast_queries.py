"""Registered forecasting queries.

Keys that report on a fitted model get the rows-only check; the same reports
are checked against SQL on a week-ago forecast, which needs no model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.operators import evaluate as E
from wardline.operators import forecast as FC
from wardline.operators import risk as R
from wardline.operators import series as S
from wardline.plans import oracle as O
from wardline.plans.catalog import master, register
from wardline.plans.series_queries import SERIES_SQL, TEST_START, TRAIN_END, daily, q
from wardline.plans.model_queries import _inputs
from wardline.session import cut_lineage
from wardline.sources.tables import load_forecaster, log_runs, save_forecaster, serving_folder

HORIZON = 30  # the dashboard's default horizon (7-180 allowed)


_SERIES: dict = {}
_BOOSTED: dict = {}


def _series(spark, sf_dir):
    """The daily series, checkpointed once per session and input dir."""
    key = _inputs(spark, sf_dir)
    if key not in _SERIES:
        _SERIES[key] = cut_lineage(daily(spark, sf_dir))
    return _SERIES[key]


def _boosted(spark, sf_dir):
    """The lag-feature GBT fit and its test predictions, shared by every
    key that reports on them."""
    key = _inputs(spark, sf_dir)
    if key not in _BOOSTED:
        model, pred = FC.boosted_forecast(_series(spark, sf_dir), TRAIN_END, TEST_START)
        _BOOSTED[key] = (model, cut_lineage(pred))
    return _BOOSTED[key]


@register("boosted_forecast")
def _boosted_forecast(spark, sf_dir):
    return _boosted(spark, sf_dir)[1]


@register("regression_metrics")
def _regression_metrics(spark, sf_dir):
    return E.regression_metrics(_boosted(spark, sf_dir)[1], "value", "forecast", "series")


def _recursive(spark, sf_dir):
    s = _series(spark, sf_dir)
    model, _ = _boosted(spark, sf_dir)
    path = serving_folder(spark, "forecast")
    save_forecaster(model, S.last_k(s, 7, before=TRAIN_END), FC.series_scale(s, TRAIN_END), path)
    model, seeds, scale = load_forecaster(spark, path)  # the forecast starts from what was saved
    return FC.recursive_forecast(spark, model, seeds, HORIZON, scale)


register("recursive_forecast")(_recursive)


@register("forecast_kpis")
def _forecast_kpis(spark, sf_dir):
    return R.forecast_kpis(_recursive(spark, sf_dir))


@register("forecast_table")
def _forecast_table(spark, sf_dir):
    return R.forecast_table(_recursive(spark, sf_dir))


@register("forecast_weekday_profile")
def _forecast_weekday_profile(spark, sf_dir):
    fc = _recursive(spark, sf_dir).select("series", "date", F.col("forecast").alias("value"))
    return S.weekday_profile(fc)


@register("fourier_forecast")
def _fourier_forecast(spark, sf_dir):
    return FC.fourier_forecast(_series(spark, sf_dir), TRAIN_END, TEST_START)


@register("forecast_comparison")
def _forecast_comparison(spark, sf_dir):
    """MAE / RMSE / R² per forecaster on the test period; lowest MAE wins."""
    from wardline.operators import arima as A

    s = _series(spark, sf_dir)
    preds = {
        "boosted_lags": _boosted(spark, sf_dir)[1],
        "fourier_trend": FC.fourier_forecast(s, TRAIN_END, TEST_START),
        "arima": A.arima_forecast(s, TRAIN_END, TEST_START),
    }
    rows = [E.regression_metrics(p, "value", "forecast", "series").withColumn("model", F.lit(n))
            for n, p in preds.items()]
    allm = reduce(DataFrame.unionByName, rows)
    best = allm.groupBy("series").agg(F.min_by("model", F.struct("mae", "model")).alias("__best"))
    return allm.join(best, "series").withColumn("is_best", F.col("model") == F.col("__best")).drop("__best")


@register("run_log_forecast")
def _run_log_forecast(spark, sf_dir):
    """Run records of the forecasters, appended to the log and read back."""
    cmp = _forecast_comparison(spark, sf_dir)
    return log_runs(cmp.select(
        F.concat_ws("_", F.lit("forecast"), "model", "series").alias("run_name"), F.lit("forecast").alias("stage"),
        F.create_map(F.lit("model"), F.col("model"), F.lit("series"), F.col("series")).alias("params"),
        F.create_map(*[x for m in ("mae", "rmse", "r2") for x in (F.lit(m), F.col(m))]).alias("metrics")))


# -- X2, X6, X7 ----------------------------------------------------------------
@register("adf_test")
def _adf_test(spark, sf_dir):
    from wardline.operators import arima as A

    return A.adf_test(_series(spark, sf_dir))


@register("arima_forecast")
def _arima_forecast(spark, sf_dir):
    from wardline.operators import arima as A

    return A.arima_forecast(_series(spark, sf_dir), TRAIN_END, TEST_START)


@register("arima_hr")
def _arima_hr(spark, sf_dir):
    from wardline.operators import arima as A

    fc = A.arima_forecast(_series(spark, sf_dir), TRAIN_END, TEST_START)
    return fc.groupBy("series", "p", "d", "q", "sp", "sq").agg(F.first("aic").alias("aic"),
                                                               F.count(F.lit(1)).alias("horizon"))


# -- E5, R8, R9, A10 on a forecast without a model ---------------------------------
_W7 = """(SELECT series, date, value, forecast, forecast AS lower, forecast AS upper FROM (
  SELECT series, date, value, lag(value, 7) OVER (PARTITION BY series ORDER BY date) AS forecast FROM daily)
  WHERE date >= DATE '%s')""" % TEST_START


def _week_ago(spark, sf_dir):
    """The value of seven days before as forecast of every test day."""
    s = S.lag_features(daily(spark, sf_dir), lags=(7,)).filter(F.col("date") >= F.lit(TEST_START).cast("date"))
    return s.select("series", "date", "value", *[F.col("lag_7").alias(c) for c in ("forecast", "lower", "upper")])


@register("week_ago_metrics", q(f"""
SELECT series, avg(abs(value - forecast)) AS mae, sqrt(avg((value - forecast) * (value - forecast))) AS rmse,
  1.0 - sum((value - forecast) * (value - forecast)) / NULLIF(var_pop(value) * count(*), 0) AS r2
FROM {_W7} WHERE value IS NOT NULL AND forecast IS NOT NULL GROUP BY series"""), settle=["mae", "rmse", "r2"])
def _week_ago_metrics(spark, sf_dir):
    return E.regression_metrics(_week_ago(spark, sf_dir), "value", "forecast", "series")


@register("week_ago_kpis", q(f"""
SELECT series, {O.rnd('avg(forecast)', 0)} AS avg_daily, {O.rnd('max(forecast)', 0)} AS peak,
  arg_min(date, (-forecast, date)) AS peak_date, {O.rnd('sum(forecast)', 0)} AS total, count(*) AS days
FROM {_W7} GROUP BY series"""))
def _week_ago_kpis(spark, sf_dir):
    return R.forecast_kpis(_week_ago(spark, sf_dir))


@register("week_ago_table", q(f"""
SELECT series, date, strftime(date, '%a') AS day, {O.rnd('forecast', 0)} AS forecast, {O.rnd('lower', 0)} AS low,
  {O.rnd('upper', 0)} AS high, isodow(date) >= 6 AS weekend FROM {_W7}"""))
def _week_ago_table(spark, sf_dir):
    return R.forecast_table(_week_ago(spark, sf_dir))


@register("week_ago_weekdays", q(f"""
SELECT s.series, CAST(g.wd AS INTEGER) AS weekday, {repr(S.DAY_NAMES).replace('"', "'")}[g.wd + 1] AS day_name, coalesce(m.mean, 0.0) AS mean
FROM (SELECT DISTINCT series FROM {_W7}) s CROSS JOIN range(7) g(wd)
LEFT JOIN (SELECT series, isodow(date) - 1 AS wd, avg(forecast) AS mean FROM {_W7} GROUP BY 1, 2) m
  ON m.series = s.series AND m.wd = g.wd"""), settle=["mean"])
def _week_ago_weekdays(spark, sf_dir):
    return S.weekday_profile(_week_ago(spark, sf_dir).select("series", "date", F.col("forecast").alias("value")))


# -- many series -------------------------------------------------------------------
def _by_type(spark, sf_dir):
    key = (*_inputs(spark, sf_dir), "admission_type")
    if key not in _SERIES:
        m = master(spark, sf_dir).filter(F.col("admission_type").isNotNull())
        _SERIES[key] = cut_lineage(S.daily_series(m, "admission_date", "num_ed_visits", "admission_type"))
    return _SERIES[key]


@register("daily_by_type", O.with_ctes("SELECT * FROM daily", "master", extra=SERIES_SQL | {"ds_sum": """
  SELECT admission_type AS series, CAST(admission_date AS DATE) AS date, CAST(coalesce(sum(num_ed_visits), 0) AS DOUBLE) AS value
  FROM master WHERE admission_date IS NOT NULL AND admission_type IS NOT NULL GROUP BY 1, 2"""}), settle=["value"])
def _daily_by_type(spark, sf_dir):
    return _by_type(spark, sf_dir)


@register("adf_by_type")
def _adf_by_type(spark, sf_dir):
    from wardline.operators import arima as A

    return A.adf_test(_by_type(spark, sf_dir))


@register("arima_by_type")
def _arima_by_type(spark, sf_dir):
    from wardline.operators import arima as A

    return A.arima_forecast(_by_type(spark, sf_dir), TRAIN_END, TEST_START)


@register("fourier_by_type")
def _fourier_by_type(spark, sf_dir):
    return FC.fourier_forecast(_by_type(spark, sf_dir), TRAIN_END, TEST_START)


@register("boosted_by_type")
def _boosted_by_type(spark, sf_dir):
    return FC.boosted_forecast(_by_type(spark, sf_dir), TRAIN_END, TEST_START)[1]
