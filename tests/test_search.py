"""The staged search takes all training rows, in tasks or over aggregates."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from wardline.operators import boosting as B
from wardline.operators import search as S
from wardline.plans import search_queries as Q

BOOSTED = {"max_depth": 2, "learning_rate": 0.2, "subsample": 1.0, "colsample_bytree": 1.0, "min_child_weight": 1, "gamma": 0, "reg_alpha": 0, "reg_lambda": 1.0}
FOREST = {"max_depth": 6, "min_samples_split": 4, "min_samples_leaf": 2, "max_features": "sqrt"}


def table(spark, n, null=0):
    rng = np.random.default_rng(11)
    x = np.column_stack([rng.normal(size=n).round(1), rng.integers(0, 3, n), rng.integers(0, 2, n)])
    y = (rng.random(n) < 1 / (1 + np.exp(-2 * x[:, 0] - x[:, 1]))).astype(float)
    rows = [(i // 2, None if i < null else float(a), 1.0 + i % 2, i % 5, [float(v) for v in r]) for i, (r, a) in enumerate(zip(x, y))]  # ids twice
    return spark.createDataFrame(rows, "id long, y double, w double, fold int, a array<double>").select("*", array_to_vector("a").alias("features")).repartition(3).localCheckpoint(), x, y


def test_a_search_of_the_queries_sees_every_row(spark, monkeypatch):
    df, _, _ = table(spark, 4600, null=7)
    seen = {}

    def one(spark, s, points, folds, *_):
        seen["rows"] = len(s.y)
        return S._staged(points, folds, lambda fold, work: [(i, 0.5) for members in work for i in members])

    monkeypatch.setattr(S, "staged_search", one)
    job = SimpleNamespace(train=df.withColumnRenamed("id", Q.ID), target="y")
    found = Q._searched(spark, job, "boosted", 3, "w").collect()
    assert seen["rows"] == 4593 and len(found) == 3 and sum(r.is_best for r in found) == 1


def test_held_rows_are_the_table_in_any_row_order(spark):
    df, x, y = table(spark, 500)
    bins = B.quantile_bins(df, "features")
    a = S.training_rows(df, "id", "y", "fold", "w", bins)
    b = S.training_rows(df.repartition(5, "a"), "id", "y", "fold", "w", bins)
    assert all((getattr(a, c) == getattr(b, c)).all() for c in ("columns", "y", "w", "fold"))
    kept = lambda codes, y, w, fold: sorted(zip(map(tuple, codes.tolist()), y.tolist(), w.tolist(), fold.tolist()))
    i = np.arange(500)
    assert kept(a.columns.T, a.y, a.w, a.fold) == kept(bins.codes(x) - bins.first[:-1], y, 1.0 + i % 2, i % 5)


def test_boosted_search_over_aggregates_is_the_search_in_tasks(spark):
    df, _, _ = table(spark, 300)
    points = [{**BOOSTED, "n_estimators": 6}, {**BOOSTED, "n_estimators": 3}, {**BOOSTED, "n_estimators": 4, "max_depth": 3}]
    a = S.search(df, "id", "y", "fold", "w", points, 2)
    b = S.search(df, "id", "y", "fold", "w", points, 2, most_bytes=0)
    assert [len(f) for f in a.fold_auc] == [2, 2, 2]
    assert np.allclose(list(a.fold_auc), list(b.fold_auc), atol=1e-9) and S.winner(a) == S.winner(b)


@pytest.mark.parametrize("most_bytes", [S.SEARCH_BYTES, 0])
def test_forest_search_learns(spark, most_bytes):
    df, _, y = table(spark, 400)
    points = [{**FOREST, "n_estimators": 6}, {**FOREST, "n_estimators": 3, "max_depth": None}]
    found = S.search(df, "id", "y", "fold", None, points, 2, most_bytes=most_bytes)
    assert all(v > 0.7 for f in found.fold_auc for v in f)


def test_nodes_of_few_rows_are_not_split():
    from wardline.operators.forests import grow_part

    rng = np.random.default_rng(2)
    columns, y = rng.integers(0, 9, (3, 400)).astype(np.uint8), rng.integers(0, 2, 400).astype(float)
    some = [grow_part(columns, y, np.ones(400), np.ones(400), 40, 3, 1, 9, np.random.default_rng(0), m)[0] for m in (2, 50, 401)]
    assert len(some[0]) > len(some[1]) > len(some[2]) == 1
