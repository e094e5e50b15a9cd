"""Second-order trees against a plain version; the staged search."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from wardline.operators import boosting as B
from wardline.operators import search as S
from wardline.operators.attribution import tree_shap


def data(n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n).round(2), rng.integers(0, 3, n), rng.integers(0, 2, n), np.full(n, 7.0)])
    logit = 1.5 * x[:, 0] + (x[:, 1] == 2) * 1.2 - x[:, 2]
    y = (rng.random(n) < 1 / (1 + np.exp(-logit))).astype(float)
    return x, y, rng.choice([1.0, 2.5], n)


def plain_tree(x, g, h, p, depth=0):
    """Exhaustive second-order tree over all distinct values, recursively."""
    value = -p.rate * B.soft(g.sum(), p.alpha) / (h.sum() + p.lam)
    node = {"value": value, "cover": h.sum()}
    if depth == p.max_depth:
        return node
    part = lambda s: B.soft(g[s].sum(), p.alpha) ** 2 / (h[s].sum() + p.lam)
    best = None
    for f in range(x.shape[1]):
        for t in np.unique(x[:, f])[:-1]:
            s = x[:, f] <= t
            if h[s].sum() >= p.min_child_weight and h[~s].sum() >= p.min_child_weight:
                gain = part(s) + part(~s) - part(np.ones(len(g), bool))
                if best is None or gain > best[0] + 1e-9:
                    best = (gain, f, t)
    if best and best[0] > 1e-6:
        s = x[:, best[1]] <= best[2]
        left, right = plain_tree(x[s], g[s], h[s], p, depth + 1), plain_tree(x[~s], g[~s], h[~s], p, depth + 1)
        if best[0] >= p.gamma or "f" in left or "f" in right:
            node |= {"f": best[1], "t": best[2], "left": left, "right": right}
    return node


def plain_value(node, row):
    while "f" in node:
        node = node["left"] if row[node["f"]] <= node["t"] else node["right"]
    return node["value"]


@pytest.mark.parametrize("p", [B.Params(5, 3, 0.3), B.Params(4, 4, 0.1, min_child_weight=5, gamma=0.5, alpha=0.3, lam=2.0),
                               B.Params(3, 2, 0.5, loss="squared", lam=0.5)])
def test_trees_equal_the_plain_version(p):
    x, y, w = data()
    bins = B.Bins([np.unique(c)[:-1] for c in x.T])  # a bin per value: nothing is lost
    margin, seen = np.zeros(len(y)), []
    trees = B.fit_rows(bins.codes(x), bins, y, w, p, lambda r, m: seen.append(m.copy()))
    for k in range(p.rounds):
        g, h = B.gradients(y, w, margin, p.loss)
        tree = plain_tree(x, g, h, p)
        margin = margin + [plain_value(tree, row) for row in x]
        assert np.allclose(seen[k], margin)
    assert np.allclose(B.BoostedTrees(trees, p.loss).margin(x), margin)


def test_spark_aggregates_grow_the_same_trees(spark):
    x, y, w = data(300)
    df = spark.createDataFrame([(i, float(a), float(b), [float(v) for v in r]) for i, (r, a, b) in enumerate(zip(x, y, w))], "id long, y double, w double, a array<double>")
    df = df.select("id", "y", "w", array_to_vector("a").alias("features")).repartition(3)
    bins = B.quantile_bins(df, "features")
    p = B.Params(3, 3, 0.3, alpha=0.2, lam=1.5, gamma=0.1, columns=0.75)
    model = B.fit_spark(df, "features", "y", "w", p, bins)
    want = B.BoostedTrees(B.fit_rows(bins.codes(x), bins, y, w, p))
    assert np.allclose(model.margin(x), want.margin(x))
    scored = {r.id: r for r in model.score(df, ["id"]).collect()}
    assert np.allclose([scored[i].probability for i in range(len(y))], want.probability(x))
    assert len(B.fit_spark(df, "features", "y", None, B.Params(2, 2, subsample=0.5), bins).trees) == 2


def test_forest_options_hold():
    x, y, w = data(500)
    bins = B.Bins([np.unique(c)[:-1] for c in x.T])
    p = B.resolved(B.from_grid({"n_estimators": 25, "max_depth": None, "min_samples_split": 10, "min_samples_leaf": 4, "max_features": "sqrt"}), 4)
    entries = []
    trees = B.fit_rows(bins.codes(x), bins, y, np.ones(len(y)), p)
    for t in trees:
        inner = t.left >= 0
        assert (t.cover[inner] >= 10).all() and (t.cover[~inner] >= 4 - 1e-9).all()
        assert ((t.value >= -1e-9) & (t.value <= 1 + 1e-9)).all()
        entries.append(len(t.left))
    assert max(entries) > 31  # deeper than a few levels
    model = B.BoostedTrees(trees, "mean")
    assert S.auc(y, model.probability(x)) > 0.8


def test_attributions_add_up_for_all_tree_models():
    x, y, w = data(200)
    bins = B.Bins([np.unique(c)[:-1] for c in x.T])
    for p in (B.Params(6, 3), B.Params(6, 4, loss="mean", features=0.5)):
        model = B.BoostedTrees(B.fit_rows(bins.codes(x), bins, y, w, p), p.loss)
        phi, base = tree_shap(model.forest(), x[:20], 4)
        assert np.allclose(base + phi.sum(axis=1), model.margin(x[:20]))


def test_auc():
    assert S.auc(np.array([0, 1, 1, 0]), np.array([0.1, 0.9, 0.5, 0.5])) == 0.875
    assert S.auc(np.array([1, 1]), np.array([0.1, 0.9])) == 0.5


def test_staged_search_finds_what_a_plain_search_finds(spark):
    x, y, w = data(400, 3)
    fold = np.arange(len(y)) % 5
    bins = B.Bins([np.unique(c)[:-1] for c in x.T])
    s = S.Sample(bins.codes(x), y, w, fold, bins)
    base = {"max_depth": 2, "learning_rate": 0.2, "subsample": 1.0, "colsample_bytree": 1.0, "min_child_weight": 1, "gamma": 0, "reg_alpha": 0, "reg_lambda": 1.0}
    points = [{**base, "n_estimators": 10}, {**base, "n_estimators": 3}, {**base, "n_estimators": 5, "learning_rate": 0.005}, {**base, "n_estimators": 5, "max_depth": 4},
              {**base, "n_estimators": 2, "min_child_weight": 1000}]
    assert S.grouped(points) == [[0, 1], [2], [3], [4]]
    table = S.staged_search(spark, s, points)
    for i, q in enumerate(points):
        alone = [S.fold_scores(s, [q], k)[0] for k in range(5)]
        assert np.allclose(table.fold_auc[i], alone[:len(table.fold_auc[i])])
        assert table.stopped[i] == (len(table.fold_auc[i]) < 5)
    plain = [np.mean([S.fold_scores(s, [q], k)[0] for k in range(5)]) for q in points]
    assert S.winner(table) == int(np.argmax(plain)) and table.stopped[4]


def test_final_fit_in_a_task_and_by_aggregates(spark):
    x, y, w = data(250, 5)
    df = spark.createDataFrame([(i, float(a), float(b), i % 5, [float(v) for v in r]) for i, (r, a, b) in enumerate(zip(x, y, w))],
                               "id long, y double, w double, fold int, a array<double>").select("*", array_to_vector("a").alias("features"))
    s = S.sample_rows(df, "id", "y", "fold", "w", rows=100)
    assert len(s.y) == 100 and S.sample_rows(df, "id", "y", "fold", None).codes.shape == (250, 4)
    p = B.Params(3, 2)
    one, many = S.fit_all(df, "y", "w", p, s.bins), S.fit_all(df, "y", "w", p, s.bins, task_rows=10)
    assert np.allclose(one.margin(x), many.margin(x))
    assert df.filter(F.col("y").isNull()).count() == 0


def test_aggregate_fit_keeps_little(spark):
    x, y, w = data(200, 9)
    df = spark.createDataFrame([(float(a), [float(v) for v in r]) for r, a in zip(x, y)], "y double, a array<double>")
    df = df.select("y", array_to_vector("a").alias("features")).repartition(2)
    bins = B.quantile_bins(df, "features")
    assert {len(r.codes) for r in B.binned(df, bins, "features", "y", None).select("codes").collect()} == {x.shape[1]}  # a byte a feature
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    assert len(B.fit_spark(df, "features", "y", None, B.Params(4, 2), bins).trees) == 4
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held  # no round's rows stay behind


def test_joint_codes_hold_every_features_sums(monkeypatch):
    x, y, w = data(500, 4)
    bins = B.Bins([np.unique(c)[:-1] for c in x.T])
    joint = B.Joint(bins, 1 << 12)
    assert len(joint.sizes) < len(bins.cuts)
    codes = joint.codes((bins.codes(x) - bins.first[:-1]).T)
    slot = np.arange(500) % 3
    want = B.Entries(bins.codes(x), bins).sums([y - w, w, np.ones(500)], slot, 3)
    for fine in (0, B.FINE_ROWS):  # by whole codes, and by their parts
        monkeypatch.setattr(B, "FINE_ROWS", fine)
        halves = [(codes, at, slot[at], (y - w)[at], w[at]) for at in (np.arange(200), np.arange(200, 500))]
        assert np.allclose(joint.sums(3, iter(halves)), want)
    tree = B.fit_rows(bins.codes(x), bins, y, w, B.Params(1, 4))[0]
    assert (joint.leaves(tree, codes) == tree.of_codes(bins.codes(x))).all()


def test_of_two_siblings_only_the_smaller_is_counted():
    x, y, w = data(600, 6)
    bins = B.Bins([np.unique(c)[:-1] for c in x.T])
    p, codes, asked = B.Params(1, 4, min_child_weight=0.0), bins.codes(x), []

    def histograms(frontier, tree):
        asked.append(len(frontier))
        slot = np.full(len(tree.left), len(frontier))
        slot[frontier] = np.arange(len(frontier))
        return B.Entries(codes, bins).sums([*B.gradients(y, w, np.zeros(600), p.loss), np.ones(600)], slot[tree.of_codes(codes)], len(frontier))

    got = B.grow(histograms, bins, p, np.random.default_rng(p.seed), siblings=True)
    assert asked[1] == 1 and asked[2] <= 2
    assert np.allclose(got.value[got.of_codes(codes)], B.BoostedTrees(B.fit_rows(codes, bins, y, w, p)).margin(x))


def test_fits_of_held_columns_are_those_of_rows():
    x, y, w = data(400, 8)
    bins = B.Bins([np.unique(c)[:-1] for c in x.T])
    p, w[::5] = B.Params(4, 3, columns=0.75, gamma=0.1), 0.0
    joint, a, b = B.Joint(bins), [], []
    B.fit_rows(bins.codes(x), bins, y, w, p, lambda r, m: a.append(m.copy()))
    B.fit_columns(joint.codes((bins.codes(x) - bins.first[:-1]).T), joint, y, w, p, lambda r, m: b.append(m.copy()))
    assert np.allclose(a, b)  # rows of weight 0 are scored too
