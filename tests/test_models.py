"""Planted-signal checks for the classifier jobs (the driver tables carry
no learnable signal, so model quality is tested here)."""

import numpy as np
from pyspark.sql import functions as F

from wardline.operators import evaluate as E
from wardline.operators import ml_prep as M
from wardline.operators import models as MD


def planted(spark, n=3000):
    rng = np.random.default_rng(8)
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    cat = rng.choice(["Emergency", "Elective", "Urgent"], n)
    logit = 2.0 * x1 - 1.0 * x2 + np.where(cat == "Emergency", 1.0, 0.0) - 1.5
    y = (rng.random(n) < 1 / (1 + np.exp(-logit))).astype(int)
    x2 = np.where(rng.random(n) < 0.1, np.nan, x2)  # some missing values to impute
    rows = [(i, float(a), None if np.isnan(b) else float(b), c, int(t)) for i, (a, b, c, t) in enumerate(zip(x1, x2, cat, y))]
    return spark.createDataFrame(rows, "id long, x1 double, x2 double, kind string, y int")


def test_models_beat_majority_baseline(spark):
    df = M.stratified_split(planted(spark), "id", "y")
    train, test = df.filter(F.col("split") == "train"), df.filter(F.col("split") == "test")
    prep = MD.fit_features(train, ["x1", "x2"], ["kind"])
    w = M.class_weights(train, "y")
    tr = prep.transform(M.with_weights(train, "y", w)).select("id", "y", "weight", "features")
    te = prep.transform(test).select("id", "y", "features")
    n = float(w.first()["n"])
    for est in (MD.logistic("y", "weight", n), MD.boosted("y", None, rounds=30, depth=3),
                MD.forest("y", "weight", trees=30, depth=6)):
        scored = MD.score(est.fit(tr), te, ["id", "y"])
        auc = E.roc_auc(scored, "y", "probability").first()["roc_auc"]
        assert auc > 0.75, (type(est).__name__, auc)


def test_unknown_category_encodes_as_zeros(spark):
    df = planted(spark, 300)
    prep = MD.fit_features(df, ["x1"], ["kind"])
    new = spark.createDataFrame([(0, 0.5, None, "Walk-In", 0)], "id long, x1 double, x2 double, kind string, y int")
    from pyspark.ml.functions import vector_to_array

    oh = prep.transform(new).select(vector_to_array("kind__oh").alias("v")).first()["v"]
    assert sum(oh) == 0.0 and len(oh) == 3  # three known categories, the unknown slot dropped


def test_sample_grid_distinct_and_reproducible():
    a = MD.sample_grid(MD.GRID_BOOSTED, 50, 42)
    b = MD.sample_grid(MD.GRID_BOOSTED, 50, 42)
    assert a == b and len({tuple(sorted(d.items())) for d in a}) == 50
    assert all(set(d) == set(MD.GRID_BOOSTED) for d in a)


def test_training_matrix_is_stored_and_levels_come_from_one_indexer(spark):
    df = spark.createDataFrame([(i, float(i % 7), "ab"[i % 2], "xyz"[i % 3]) for i in range(40)], "id long, n double, c string, d string")
    prep = MD.fit_features(df, ["n"], ["c", "d"])
    assert sum(type(s).__name__ == "StringIndexerModel" for s in prep.encoder.stages) == 1
    stored = MD.design(df, prep, ["id"])
    assert stored.inputFiles() and stored.count() == 40  # columns apart, in the shared folder
    assert prep.feature_names(df) == ["n", "c__oh_a", "c__oh_b", "d__oh_x", "d__oh_y", "d__oh_z"]


def test_both_tree_baselines_take_known_bins(spark, monkeypatch):
    from wardline.operators import boosting as B
    from wardline.operators import forests as FO
    from wardline.plans import model_queries as Q

    df = M.with_weights(planted(spark, 200), "y", M.class_weights(planted(spark, 200), "y"))
    job = Q.Job.__new__(Q.Job)
    job.target, job.n_weight = "y", 200.0
    job.train = MD.fit_features(df, ["x1"], ["kind"]).transform(df).select("id", "y", "weight", F.lit(1.0).alias("pos_w"), "features")
    job.estimators = lambda: {"random_forest": MD.forest("y", "weight", 2, 3), "boosted_trees": MD.boosted("y", "pos_w", 2, 2)}
    asked = []

    def counted(df, col, bins=64, *a, f=B.quantile_bins):
        asked.append(bins)
        return f(df, col, bins, *a)

    for module in (B, FO, Q):
        monkeypatch.setattr(module, "quantile_bins", counted)
    monkeypatch.setattr(Q, "job", lambda *a: job)
    monkeypatch.setattr(Q, "_inputs", lambda *a: ("test-known-bins", "x"))
    for name in ("random_forest", "boosted_trees"):
        assert Q.fitted(spark, "", name) is Q.fitted(spark, "", name)
    assert asked == [32]
