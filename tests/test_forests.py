"""Forests from groups of rows, and boosted trees from residuals."""

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from wardline.operators import forests as FO
from wardline.operators import models as MD


def rows(spark, n=900, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 6, (n, 5)).astype(float)
    y = (rng.random(n) < 1 / (1 + np.exp(2.5 - x[:, 0] + 0.5 * x[:, 1]))).astype(int)
    data = [(i, int(t), 1.0 + i % 3, Vectors.dense(v.tolist())) for i, (t, v) in enumerate(zip(y, x))]
    return spark.createDataFrame(data, ["id", "y", "w", "features"]).repartition(3).localCheckpoint(), x, y


def scores(model, df):
    return {r.id: r.probability for r in model.score(df, ["id"]).collect()}


def test_groups_grow_the_trees_that_one_task_grows(spark):
    df, _, _ = rows(spark)
    whole = FO.ForestClassifier("y", "w", trees=4, depth=7, subset="all").fit(df)
    split = FO.ForestClassifier("y", "w", trees=4, depth=7, subset="all", group_rows=60).fit(df)
    assert whole.parts.count() == 4 and split.parts.count() > 20
    a, b = scores(whole, df), scores(split, df)
    assert len(a) == 900 and max(abs(a[i] - b[i]) for i in a) < 1e-12


def test_a_tree_agrees_with_an_exhaustive_one(spark):
    df, x, y = rows(spark, 300)
    w = 1.0 + np.arange(300) % 3

    def gini(at):
        return w[at].sum() - (w[at][y[at] == 1].sum() ** 2 + w[at][y[at] == 0].sum() ** 2) / w[at].sum()

    def grown(at, depth):
        if depth == 0 or len(set(y[at])) < 2:
            return {i: w[at][y[at] == 1].sum() / w[at].sum() for i in at}
        cuts = [(gini(at[x[at, f] <= c]) + gini(at[x[at, f] > c]), f, c) for f in range(5) for c in np.unique(x[at, f])[:-1]]
        if not cuts or min(cuts)[0] >= gini(at) - 1e-9:
            return {i: w[at][y[at] == 1].sum() / w[at].sum() for i in at}
        _, f, c = min(cuts)
        return grown(at[x[at, f] <= c], depth - 1) | grown(at[x[at, f] > c], depth - 1)

    columns = x.T.astype(np.uint8)
    feature, cut, left, share = FO.grow_part(columns, y, w, np.ones(300), 3, 5, 1, 6, np.random.default_rng(0))
    got, want = share[FO.placed(columns, feature, cut, left)], grown(np.arange(300), 3)
    assert np.allclose(got, [want[i] for i in range(300)])


def test_pure_and_constant_rows(spark):
    df = spark.createDataFrame([(i, i % 2, Vectors.dense([1.0, 2.0])) for i in range(200)], ["id", "y", "features"])
    for most in (10, 10_000):
        p = scores(FO.ForestClassifier("y", None, trees=5, group_rows=most).fit(df), df)
        assert len(p) == 200 and len({round(v, 9) for v in p.values()}) == 1 and abs(p[0] - 0.5) < 0.2


def test_residual_trees_are_those_of_spark(spark):
    df, _, _ = rows(spark, 600)
    ours = {r.id: r.probability for r in MD.score(MD.boosted("y", "w", rounds=6, depth=3).fit(df), df, ["id"]).collect()}
    model = GBTClassifier(labelCol="y", weightCol="w", maxIter=6, maxDepth=3, stepSize=0.3, lossType="logistic").fit(df)
    theirs = {r.id: r.p for r in model.transform(df).select("id", vector_to_array("probability")[1].alias("p")).collect()}
    assert max(abs(ours[i] - theirs[i]) for i in ours) < 1e-6


def test_rows_are_dealt_by_codes_of_several_features(spark):
    df, _, _ = rows(spark, 300)
    bins = FO.quantile_bins(df, "features", FO.BINS)
    joint = FO.Joint(bins, FO.DEALT_CELLS)
    columns = np.random.default_rng(0).integers(0, np.diff(bins.first), (50, len(bins.cuts))).T
    assert len(joint.sizes) == 1 and joint.codes(columns).nbytes == 100  # five features in two bytes a row
    assert (joint.columns(joint.codes(columns), "<u1") == columns).all()
