"""Planted-signal checks for the series operators."""

import datetime as dt

import numpy as np

from wardline.operators import series as S


def make_series(spark, values, start=dt.date(2020, 1, 1), drop=()):
    rows = [("s", start + dt.timedelta(days=i), float(v)) for i, v in enumerate(values) if i not in drop]
    return spark.createDataFrame(rows, "series string, date date, value double")


def test_interpolation_fills_gaps_linearly(spark):
    s = make_series(spark, [0, 10, 20, 30, 40], drop={1, 2})
    out = S.calendar_fill(s).orderBy("date").collect()
    assert [r.value for r in out] == [0.0, 10.0, 20.0, 30.0, 40.0]
    assert [r.filled for r in out] == [False, True, True, False, False]


def test_weekly_pattern_is_seasonal_noise_is_not(spark):
    rng = np.random.default_rng(3)
    n = 700
    weekly = 10 * np.tile([1, 0, 0, 0, 0, 0, 2], n // 7) + rng.normal(0, 0.5, n)
    noise = rng.normal(0, 1, n)
    st = S.seasonal_strength(S.seasonal_decompose(make_series(spark, weekly))).first()
    sn = S.seasonal_strength(S.seasonal_decompose(make_series(spark, noise))).first()
    assert st.strength > 0.30 and st.model_choice == "SARIMAX"
    assert sn.strength < 0.30 and sn.model_choice == "ARIMA"


def test_decomposition_adds_back(spark):
    rng = np.random.default_rng(5)
    d = S.seasonal_decompose(make_series(spark, rng.normal(10, 2, 100))).toPandas()
    assert np.allclose(d.trend + d.seasonal + d.resid, d.observed)


def test_lag_and_rolling(spark):
    out = S.lag_features(make_series(spark, range(10))).orderBy("date").toPandas()
    assert out.lag_1.isna().sum() == 1 and out.lag_7.isna().sum() == 7
    assert out.rolling_mean_7.isna().sum() == 6 and out.rolling_mean_7.iloc[6] == 3.0
