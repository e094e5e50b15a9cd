"""Merged correlation blocks and density curves against plain versions."""

import numpy as np
import pandas as pd

from wardline.operators import profile as PR


def test_blocks_merge_as_their_rows():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 4)) @ rng.normal(size=(4, 4)) + np.array([1e9, 0, -5, 3])
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 3] = np.where(np.isnan(x[:, 3]), np.nan, 7.0)
    parts = [x[:1], x[1:1], x[1:90], x[90:91], x[91:400], np.full((3, 4), np.nan), x[400:]]
    total = PR.PairMoments.empty(4)
    for p in parts:
        total = total + PR.PairMoments.from_bytes(PR.PairMoments.of(p).to_bytes(), 4)
    want = pd.DataFrame(x).corr(min_periods=2).to_numpy()
    got = total.correlations()
    assert np.allclose(got[:3, :3], want[:3, :3], rtol=1e-6, atol=1e-9) and np.isnan(got[3]).all()


def test_corr_matrix_on_spark(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=300)
    pdf = pd.DataFrame({"a": a, "b": a + rng.normal(size=300), "c": 1.0, "d": np.where(rng.random(300) < 0.5, np.nan, a)})
    rows = [tuple(None if pd.isna(v) else float(v) for v in r) for r in pdf.itertuples(index=False)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(5)
    got = {(r.x, r.y): r["corr"] for r in PR.corr_matrix(df, list("abcd")).collect()}
    assert len(got) == 16 and got["a", "a"] == 1.0 and got["c", "c"] is None and got["a", "c"] is None
    want = pdf.corr()
    for x, y in (("a", "b"), ("b", "d"), ("d", "a")):
        assert np.isclose(got[x, y], want.loc[x, y]) and got[x, y] == got[y, x]
    empty = PR.corr_matrix(df.limit(0), ["a", "b"]).collect()
    assert len(empty) == 4 and all(r["corr"] is None for r in empty)


def test_density_curves(spark):
    rng = np.random.default_rng(3)
    values = {0: rng.normal(0, 1, 400).tolist(), 1: rng.normal(3, 2, 150).tolist(), 2: [5.0], 3: [2.0, 2.0], None: [1.0, 2.0]}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs] + [(0, None)], "g int, v double").repartition(3)
    got = PR.density_curves(df, ["v"], "g").toPandas()
    assert set(got.g) == {0, 1} and (got.groupby("g").size() == 200).all()
    for g in (0, 1):
        part, v = got[got.g == g].sort_values("x"), np.array(values[g])
        h = v.std(ddof=1) * len(v) ** -0.2
        direct = np.exp(-0.5 * ((part.x.to_numpy()[:, None] - v) / h) ** 2).sum(axis=1) / (len(v) * h * np.sqrt(2 * np.pi))
        assert np.abs(part.density - direct).max() < 0.01 * direct.max()
        assert np.isclose(part.x.iloc[0], v.min() - 3 * h) and np.isclose(np.trapezoid(part.density, part.x), 1, atol=0.01)
    assert PR.density_curves(df.limit(0), ["v"], "g").count() == 0
