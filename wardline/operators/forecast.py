"""Forecasting jobs on daily series.

The boosted regressor trains on Spark (``ml.GBTRegressor``) over lag columns
built with windows partitioned by series; the calendar regression is a small
solve per series.
Recursion — each day's prediction feeding the next day's lags — is per
series and bounded by the horizon, so it runs in ``applyInPandas`` with
the model's tree table (bounded by trees × nodes) shipped to the tasks.
"""

from __future__ import annotations

import datetime as dt
import zlib

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.operators import series as S
from wardline.operators.trees import Forest, tree_table
from wardline.session import cut_lineage

LAG_COLS = ["lag_1", "lag_7", "rolling_mean_7"]


# -- X9 ----------------------------------------------------------------------
def lag_frame(s: DataFrame, train_end: str, test_start: str) -> DataFrame:
    """Lags over the full series (so the first test day sees real training
    history), incomplete rows dropped, split by date."""
    lf = S.lag_features(s).dropna(subset=LAG_COLS)
    return S.time_split(lf, train_end, test_start)


def fit_boosted_regressor(train: DataFrame, seed: int = 42):
    """300 trees, learning rate 0.05, depth 4, row subsample 0.8."""
    va = VectorAssembler(inputCols=LAG_COLS, outputCol="features")
    gbt = GBTRegressor(labelCol="value", featuresCol="features", maxIter=300, stepSize=0.05, maxDepth=4,
                       subsamplingRate=0.8, seed=seed)
    return va, gbt.fit(va.transform(train))


def series_scale(s: DataFrame, train_end: str) -> DataFrame:
    """``(series, __mean, __std)`` of each series' training days."""
    train = s.filter(F.col("date") <= F.lit(train_end).cast("date"))
    std = F.stddev_pop("value")
    return train.groupBy("series").agg(F.avg("value").alias("__mean"), F.when(std > 0, std).otherwise(1.0).alias("__std"))


def boosted_forecast(s: DataFrame, train_end: str, test_start: str):
    """Returns (model, test predictions ``(series, date, value, forecast)``).

    One model serves all series: it learns on values in units of each series'
    own training mean and spread, so series of any level can share it.  A
    series without training days has no forecast (null)."""
    scale = series_scale(s, train_end)
    z = s.join(scale, "series", "left").withColumn("value", (F.col("value") - F.col("__mean")) / F.col("__std"))
    lf = cut_lineage(lag_frame(z, train_end, test_start))
    va, model = fit_boosted_regressor(lf.filter(F.col("split") == "train"))
    test = lf.filter(F.col("split") == "test")
    back = lambda c: F.col(c) * F.col("__std") + F.col("__mean")
    pred = model.transform(va.transform(test)).select("series", "date", back("prediction").alias("forecast"))
    days = s.filter(F.col("date") >= F.lit(test_start).cast("date")).select("series", "date", "value")
    return model, days.join(pred, ["series", "date"], "left").select("series", "date", "value", "forecast")


# -- X10 -----------------------------------------------------------------------
def recursive_forecast(spark, model, seeds: DataFrame, horizon: int, scale: DataFrame | None = None) -> DataFrame:
    """Predict ``horizon`` days after each series' last seed day, one day at a
    time; each prediction (floored at 0) becomes the next day's ``lag_1``.
    ``scale`` is ``series_scale`` of the data the model was fitted on.
    ``seeds`` holds the last 7 observed days per series; with fewer, the first
    of them stands for the day a week before.  Lower = upper =
    forecast (a tree ensemble gives no interval)."""
    if scale is None:
        scale = seeds.select("series", F.lit(0.0).alias("__mean"), F.lit(1.0).alias("__std")).distinct()
    seeds = seeds.join(scale, "series")
    forest = Forest.from_pandas(tree_table(spark, model).toPandas())  # bounded by trees × nodes

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        mean, std = float(pdf["__mean"].iloc[0]), float(pdf["__std"].iloc[0])
        hist = [(v - mean) / std for v in pdf["value"].astype(float)]
        last = pd.Timestamp(pdf["date"].iloc[-1]).date()
        out = []
        for i in range(horizon):
            x = np.array([[hist[-1], hist[-min(7, len(hist))], float(np.mean(hist[-7:]))]])
            p = max(0.0, float(forest.predict(x)[0]) * std + mean)
            hist.append((p - mean) / std)
            out.append((pdf["series"].iloc[0], last + dt.timedelta(days=i + 1), p, p, p))
        return pd.DataFrame(out, columns=["series", "date", "forecast", "lower", "upper"])

    return seeds.groupBy("series").applyInPandas(
        run, "series string, date date, forecast double, lower double, upper double")


# -- X8 ----------------------------------------------------------------------
def sparse_ridge(z: np.ndarray, y: np.ndarray, l1: np.ndarray, l2: np.ndarray, sweeps: int = 1000, tol: float = 1e-7) -> np.ndarray:
    """Coefficients of least (mean squared error) / 2 + l1 |b| + l2 b^2 / 2, by
    coordinate descent on the Gram matrix."""
    gram, goal, beta = z.T @ z / len(y), z.T @ y / len(y), np.zeros(z.shape[1])
    for _ in range(sweeps):
        most = 0.0
        for j in range(len(beta)):
            if gram[j, j] + l2[j] == 0:
                continue
            pull = goal[j] - gram[j] @ beta + gram[j, j] * beta[j]
            new = np.sign(pull) * max(0.0, abs(pull) - l1[j]) / (gram[j, j] + l2[j])
            most, beta[j] = max(most, abs(new - beta[j])), new
        if most < tol * (1 + np.abs(beta).max()):
            break
    return beta


def trend_draws(ahead: np.ndarray, rate: float, size: float, draws: int, seed: int) -> np.ndarray:
    """Simulated departures from the trend, ``ahead`` days after training: a
    day has a change with chance ``rate``, of Laplace size."""
    rng, days = np.random.default_rng(seed), int(ahead.max())
    change = (rng.random((draws, days)) < rate) * rng.laplace(0.0, size, (draws, days))
    return np.cumsum(np.cumsum(change, axis=1), axis=1)[:, ahead.astype(int) - 1]


def fourier_forecast(s: DataFrame, train_end: str, test_start: str, n_changepoints: int = 25,
                     reg: float = 0.05, interval: float = 0.8, change_penalty: float = 0.01, draws: int = 400) -> DataFrame:
    """Additive trend + yearly + weekly seasonality, fitted to every series on
    its own on standardised terms: trend changes have an L1 penalty
    (``change_penalty`` deviations of the series), so that few remain, seasonal
    terms a ridge.  The band is the central ``interval`` of training residuals
    plus ``draws`` simulated future trend changes, as frequent and as large on
    average as the fitted ones.  ``(series, date, value, forecast, lower,
    upper)`` per test day; a series without training days has nulls.  A group
    holds one series, at most a row per calendar day."""
    lo_q, hi_q = (1 - interval) / 2, 1 - (1 - interval) / 2
    cut = dt.date.fromisoformat(train_end)

    def terms(days: np.ndarray, span: float) -> np.ndarray:
        points = [round(span * 0.8 * (i + 1) / (n_changepoints + 1)) for i in range(n_changepoints)]
        cols = [days] + [np.maximum(0.0, days - p) for p in points]
        for period, order in ((365.25, 10), (7.0, 3)):
            for k in range(1, order + 1):
                cols += [np.sin(2 * np.pi * k * days / period), np.cos(2 * np.pi * k * days / period)]
        return np.column_stack(cols)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        train, test = pdf[pdf["date"] <= cut], pdf[pdf["split"] == "test"]
        out = test[["series", "date", "value"]].assign(forecast=np.nan, lower=np.nan, upper=np.nan)
        if len(train) and len(test):
            first = train["date"].iloc[0]
            days = lambda d: np.array([(x - first).days for x in d], dtype=float)
            span = days(train["date"])[-1]
            x, y = terms(days(train["date"]), span), train["value"].to_numpy(float)
            mean, std = x.mean(axis=0), x.std(axis=0)
            std[std == 0] = 1.0
            z = (x - mean) / std
            l1, l2 = np.zeros(z.shape[1]), np.full(z.shape[1], reg)
            l1[1:n_changepoints + 1] = change_penalty * y.std()
            l2[:n_changepoints + 1] = 1e-4
            beta = sparse_ridge(z, y - y.mean(), l1, l2)
            left = np.sort(y - y.mean() - z @ beta)
            out["forecast"] = y.mean() + (terms(days(test["date"]), span) - mean) / std @ beta
            changes = (beta / std)[1:n_changepoints + 1]
            rate = min(1.0, n_changepoints / max(1.0, 0.8 * span))
            seed = zlib.crc32(str(pdf["series"].iloc[0]).encode())
            away = trend_draws(days(test["date"]) - span, rate, float(np.abs(changes).mean()) if n_changepoints else 0.0, draws, seed)
            noise = np.random.default_rng(seed).permutation(np.quantile(left, np.linspace(0, 1, draws)))
            lo, hi = np.quantile(away + noise[:, None], [lo_q, hi_q], axis=0)
            out["lower"], out["upper"] = out["forecast"] + lo, out["forecast"] + hi
        return out

    return S.time_split(s, train_end, test_start).select("series", "date", "value", "split").groupBy("series").applyInPandas(
        run, "series string, date date, value double, forecast double, lower double, upper double")
