"""Exact class shares, independence of split and folds, empty and odd labels."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from wardline.operators import ml_prep as M


def labelled(spark, n=4000):
    rng = np.random.default_rng(5)
    rows = [(int(i), None if i % 400 == 7 else int(y)) for i, y in enumerate(rng.random(n) < 0.13)]
    return spark.createDataFrame(rows, "id long, y int")


def test_sizes_are_exact_per_class(spark):
    df = labelled(spark)
    whole = Counter(r.y for r in df.collect())
    split = M.stratified_split(df, "id", "y").collect()
    assert len(split) == 4000 and len({r.id for r in split}) == 4000
    for y, n in whole.items():
        assert sum(r.y == y and r.split == "train" for r in split) == int(n * 0.8 + 0.5)


def test_folds_are_even_and_independent_of_the_split(spark):
    df = M.stratified_split(labelled(spark), "id", "y")
    train = M.assign_folds(df.filter("split = 'train'"), "id", "y").collect()
    for y, n in Counter(r.y for r in train).items():
        sizes = Counter(r.fold for r in train if r.y == y)
        assert set(sizes) <= set(range(5)) and max(sizes.values()) - min(sizes.values()) <= 1 and sum(sizes.values()) == n
    both = M.assign_folds(df, "id", "y", out="fold").collect()  # folds over all rows: each holds a fifth of the test rows
    test = Counter(r.fold for r in both if r.split == "test")
    assert all(abs(c - 160) < 50 for c in test.values()) and len(test) == 5


def test_same_for_any_partitioning_and_empty(spark):
    df = labelled(spark, 500)
    a = sorted(tuple(r) for r in M.stratified_split(df, "id", "y").select("id", "split").collect())
    b = sorted(tuple(r) for r in M.stratified_split(df.repartition(7, F.rand(1)), "id", "y").select("id", "split").collect())
    assert a == b
    assert M.stratified_split(df.limit(0), "id", "y").count() == 0
