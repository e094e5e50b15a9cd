import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wardline.operators import ml_prep as M
from wardline.operators.quantiles import column_quantiles, exact_quantiles
from tests.test_scale_plans import plan


@pytest.mark.parametrize("accuracy", [20, 1000, 100_000])
def test_exact_quantiles_match_pandas(spark, accuracy):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({
        "g": rng.integers(0, 4, 5000),
        "x": np.where(rng.random(5000) < 0.3, np.round(rng.normal(size=5000), 1), rng.exponential(size=5000)),
    })
    pdf.loc[::11, "x"] = np.nan
    qs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = exact_quantiles(spark.createDataFrame(pdf), "x", qs, ["g"], accuracy=accuracy).toPandas()
    for _, r in got.iterrows():
        exp = pdf[pdf.g == r["g"]].x.dropna().quantile(r["q"])
        assert abs(exp - r["quantile"]) < 1e-9


def test_heavy_ties(spark):
    pdf = pd.DataFrame({"x": [5.0] * 4000 + [1.0, 2.0, 9.0]})
    got = exact_quantiles(spark.createDataFrame(pdf), "x", [0.0, 0.5, 1.0]).toPandas().sort_values("q")
    assert got["quantile"].tolist() == [1.0, 5.0, 9.0]


@pytest.mark.parametrize("accuracy", [20, 200])
def test_refined_band_is_still_exact(spark, accuracy):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 6000), "x": np.round(rng.lognormal(size=6000), 3)})
    qs = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = exact_quantiles(spark.createDataFrame(pdf), "x", qs, ["g"], accuracy=accuracy, few=True).toPandas()
    assert len(got) == 15
    for _, r in got.iterrows():
        assert abs(pdf[pdf.g == r["g"]].x.quantile(r["q"]) - r["quantile"]) < 1e-9


def test_column_quantiles_match_pandas(spark):
    """Close doubles, both signs, ties, nulls, infinities, an empty column; more
    than one batch a task."""
    rng = np.random.default_rng(3)
    n = 30_000
    pdf = pd.DataFrame({
        "close": 1 + rng.integers(0, 50_000, n) * 2.0 ** -52,
        "signs": rng.normal(size=n) * 10.0 ** rng.integers(-300, 300, n),
        "ties": rng.integers(-3, 4, n),
        "some": np.where(rng.random(n) < 0.9, np.nan, rng.exponential(size=n)),
        "ends": np.where(rng.random(n) < 0.1, np.inf, np.where(rng.random(n) < 0.1, -np.inf, rng.random(n))),
        "none": np.full(n, np.nan),
    })
    qs, names = [0.0, 0.1, 0.5, 0.9999], ["a", "b", "c", "d"]
    df = spark.createDataFrame(pdf).replace(float("nan"), None).repartition(5).cache()
    got = {r.feature: r for r in column_quantiles(df, list(pdf), qs, names).collect()}
    assert got.keys() == set(pdf) - {"none"}
    for c, r in got.items():
        x = np.sort(pdf[c].dropna().to_numpy(float))
        for q, v in zip(qs, r[1:]):
            h = (len(x) - 1) * q
            low, high = x[int(h)], x[min(int(h) + 1, len(x) - 1)]
            want = low + (h - int(h)) * (high - low) if abs(low) < np.inf and abs(high) < np.inf else None
            assert v == want if want is not None else not abs(v) < np.inf
    odd = spark.createDataFrame([(float("nan"),), (-0.0,), (0.0,)], "x double")
    assert column_quantiles(odd, ["x"], [0.0, 0.25], ["a", "b"]).first()[1:] == (0.0, 0.0)
    assert column_quantiles(odd.where("false"), ["x"], [0.5], ["a"]).count() == 0


def test_medians_make_no_row_per_value(spark, monkeypatch):
    """Tasks send counts of bins: neither sketches nor exploded columns."""
    seen, real = [], type(spark.range(1)).mapInArrow
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda df, *a, **k: seen.append(real(df, *a, **k)) or seen[-1])
    df = spark.range(20_000).selectExpr("id % 7 as a", "id / 3 as b", "cast(null as double) as c").cache()
    got = {r.feature: r.median for r in M.medians(df, ["a", "b", "c"]).collect()}
    assert got == {"a": 3.0, "b": pytest.approx(19_999 / 6)}
    assert len(seen) <= 4 and all("Generate" not in plan(x) for x in seen)
    assert [len(x.columns) for x in seen] == [5] * len(seen) and seen[0].count() < 1500


def test_many_columns_are_filled_and_scaled(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({f"x{i}": rng.normal(i, i, 200) for i in range(20)})
    pdf.loc[::7, "x3"] = np.nan
    df = spark.createDataFrame(pdf.assign(word=["a", "b", None, "b"] * 50)).replace(float("nan"), None).withColumn("empty", F.lit(None).cast("double"))
    num = [*pdf, "empty"]
    params = M.fit_impute_scale(df, num, ["word"])
    assert params.columns == [f"{c}__{s}" for s in ("med", "mean", "std") for c in num] + ["word__mode"]
    out = M.apply_impute_scale(df, params, num, ["word"])
    assert out.columns == df.columns and "Join" not in plan(out)
    got, filled = out.toPandas(), pdf.fillna(pdf.median())
    std = filled.std(ddof=0).replace(0, 1)
    assert np.allclose(got[list(pdf)].astype(float), (filled - filled.mean()) / std)
    assert got["empty"].isna().all() and sorted(set(got.word)) == ["a", "b"] and (got.word == "b").sum() == 150
