"""Planted-signal checks for the stationarity test, ARIMA and tree tables."""

import datetime as dt

import numpy as np
import pytest

from wardline.operators import arima as A
from wardline.operators import forecast as FC


def test_adf_ar1_stationary_random_walk_not():
    rng = np.random.default_rng(11)
    e = rng.normal(size=800)
    ar1 = np.zeros(800)
    for t in range(1, 800):
        ar1[t] = 0.5 * ar1[t - 1] + e[t]
    walk = np.cumsum(e)
    assert A.adf(ar1)["p_value"] < 0.05
    assert A.adf(walk)["p_value"] > 0.05


def test_mackinnon_monotone_and_bounded():
    ps = [A.mackinnon_p(t) for t in np.linspace(-20, 3, 50)]
    assert all(0.0 <= p <= 1.0 for p in ps)
    assert all(a <= b + 1e-12 for a, b in zip(ps, ps[1:]))
    assert abs(A.mackinnon_p(-2.86) - 0.05) < 0.01  # 5% critical value, constant only


def test_arima_recovers_ar_and_forecasts_in_band():
    rng = np.random.default_rng(2)
    n = 1200
    y = np.zeros(n)
    for t in range(2, n):
        y[t] = 10 + 0.6 * (y[t - 1] - 10) + rng.normal()
    fit = A.select_arima(y[:1000] + 0.0, seasonal=False)
    assert fit["d"] == 0 and fit["p"] >= 1
    f, lo, hi = A.forecast_arima(fit, 200)
    inside = np.mean((y[1000:] >= lo) & (y[1000:] <= hi))
    assert inside > 0.85


def test_arima_seasonal_series_on_spark(spark):
    rng = np.random.default_rng(4)
    n = 500
    vals = 20 + 8 * np.tile([1, 0, 0, 0, 0, 0, 3], n // 7 + 1)[:n] + rng.normal(0, 1, n)
    start = dt.date(2020, 1, 1)
    rows = [("s", start + dt.timedelta(days=i), float(v)) for i, v in enumerate(vals)]
    s = spark.createDataFrame(rows, "series string, date date, value double")
    end = (start + dt.timedelta(days=449)).isoformat()
    nxt = (start + dt.timedelta(days=450)).isoformat()
    fc = A.arima_forecast(s, end, nxt).toPandas()
    assert len(fc) == 50
    naive_mae = np.mean(np.abs(fc.value - vals[:450].mean()))
    assert np.mean(np.abs(fc.value - fc.forecast)) < naive_mae


def test_tree_table_matches_spark_gbt(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    from wardline.operators.trees import Forest, tree_table

    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = np.where(x[:, 0] > 0, 3.0, -1.0) + x[:, 1] ** 2
    df = spark.createDataFrame([(float(a), float(b), float(c), float(t)) for (a, b, c), t in zip(x, y)],
                               "a double, b double, c double, y double")
    va = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features")
    model = GBTRegressor(labelCol="y", maxIter=20, maxDepth=3, seed=1).fit(va.transform(df))
    want = np.array([r.prediction for r in model.transform(va.transform(df)).select("prediction").collect()])
    got = Forest.from_pandas(tree_table(spark, model).toPandas()).predict(x)
    assert np.max(np.abs(want - got)) < 1e-9


def two_levels(spark, days=200):
    rows = [(name, dt.date(2020, 1, 1) + dt.timedelta(days=i), level + 3.0 * (i % 7 == 2) + 0.01 * ((i * 37) % 11))
            for name, level in (("low", 13.0), ("high", 1003.0)) for i in range(days)]
    return spark.createDataFrame(rows, "series string, date date, value double")


def test_every_series_keeps_its_level(spark):
    from wardline.operators import forecast as FC

    s = two_levels(spark)
    for pred in (FC.fourier_forecast(s, "2020-06-30", "2020-07-01"), FC.boosted_forecast(s, "2020-06-30", "2020-07-01")[1]):
        got = pred.toPandas()
        assert set(got.series) == {"low", "high"} and len(got) == 2 * 18
        assert (abs(got.forecast - got.value) < 6).all()


def test_short_and_untrained_series_have_every_test_day(spark):
    from wardline.operators import arima as A
    from wardline.operators import forecast as FC

    s = two_levels(spark, 60).filter("series = 'low' or date >= '2020-02-20'")
    got = A.arima_forecast(s, "2020-02-15", "2020-02-16").toPandas()
    assert (got[got.series == "low"].status == "mean").all() and (got.series == "low").sum() == 14
    assert (got[got.series == "high"].status == "no_training").all() and (got.series == "high").sum() == 10
    assert got[got.series == "low"].forecast.notna().all() and got[got.series == "high"].forecast.isna().all()
    fc = FC.fourier_forecast(s, "2020-02-15", "2020-02-16").toPandas()
    assert len(fc) == 24 and fc[fc.series == "high"].forecast.isna().all()


def test_all_missing_day_counts_as_zero(spark):
    from wardline.operators import series as S

    rows = [(dt.date(2020, 1, 1), 5.0), (dt.date(2020, 1, 2), None), (dt.date(2020, 1, 3), 9.0)]
    got = S.daily_series(spark.createDataFrame(rows, "d date, v double"), "d", "v").orderBy("date").collect()
    assert [r.value for r in got] == [5.0, 0.0, 9.0] and not any(r.filled for r in got)


def test_recursion_from_few_seed_days(spark):
    from wardline.operators import forecast as FC

    s = two_levels(spark, 120)
    model, _ = FC.boosted_forecast(s, "2020-04-10", "2020-04-11")
    seeds = s.filter("date > '2020-04-08' and date <= '2020-04-11'")
    got = FC.recursive_forecast(spark, model, seeds, 5, FC.series_scale(s, "2020-04-10")).toPandas()
    assert len(got) == 10 and (got[got.series == "high"].forecast > 900).all() and (got[got.series == "low"].forecast < 60).all()


def test_sparse_trend_finds_one_planted_break():
    days = np.arange(400.0)
    points = np.arange(15, 400, 15.0)
    x = np.column_stack([days, *(np.maximum(0, days - p) for p in points)])
    y = 0.1 * days - 0.3 * np.maximum(0, days - 210) + np.random.default_rng(0).normal(0, 0.5, 400)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    l1 = np.r_[0, np.full(len(points), 0.01 * y.std())]
    beta = FC.sparse_ridge(z, y - y.mean(), l1, np.full(len(l1), 1e-4))
    change = (beta / x.std(axis=0))[1:]
    near = np.abs(points - 210) <= 30
    assert change[near].sum() < -0.2 and np.abs(change[~near]).sum() < 0.25 * abs(change[near].sum())
    # where nothing is penalised, it is the least-squares fit
    some = np.column_stack([z[:, 0], np.sin(days / 9)])
    want = np.linalg.lstsq(some, y - y.mean(), rcond=None)[0]
    assert FC.sparse_ridge(some, y - y.mean(), np.zeros(2), np.zeros(2)) == pytest.approx(want, rel=1e-4)


def test_trend_band_widens():
    away = FC.trend_draws(np.array([1.0, 30, 90, 365]), 0.05, 0.1, 400, 1)
    assert away.shape == (400, 4) and (np.diff(away.std(axis=0)) > 0).all()
    assert not FC.trend_draws(np.array([1.0, 30]), 0.05, 0.0, 10, 1).any()
