"""Tree tables of fitted Spark tree ensembles, and their evaluation.

A fitted GBT / forest model is written to the shared checkpoint folder and
its node data (``data/``) and tree weights (``treesMetadata/``) are read
back with Spark.  The result has one row per node; its size is set by the
model (trees × nodes), never by the training data, so it is the one thing
shipped to tasks (recursive forecasting, attributions).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.session import checkpoint_dir


def tree_table(spark: SparkSession, model) -> DataFrame:
    """``(tree, weight, node, prediction, left, right, feature, threshold,
    categories, cover)``; ``left``/``right`` are -1 at leaves."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/wardline-models/{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    # treesMetadata rows are (treeID, metadata json, tree weight) tuples
    weights = spark.read.parquet(f"{path}/treesMetadata").select(
        F.col("_1").alias("tree"), F.col("_3").alias("weight"))
    n = nodes.select(
        F.col("treeID").alias("tree"),
        F.col("nodeData.id").alias("node"),
        F.col("nodeData.prediction").alias("prediction"),
        F.col("nodeData.leftChild").alias("left"),
        F.col("nodeData.rightChild").alias("right"),
        F.col("nodeData.split.featureIndex").alias("feature"),
        F.col("nodeData.split.leftCategoriesOrThreshold").alias("__lct"),
        F.col("nodeData.split.numCategories").alias("__nc"),
        # weighted training count reaching the node (variance impurity stats
        # of the regression trees inside GBT: [Σw, Σwy, Σwy²])
        F.get(F.col("nodeData.impurityStats"), 0).alias("cover"),
    )
    n = n.withColumns({
        "threshold": F.when(F.col("__nc") < 0, F.get(F.col("__lct"), 0)),  # leaves: empty
        "categories": F.when(F.col("__nc") >= 0, F.col("__lct")),
    }).drop("__lct", "__nc")
    return n.join(weights, "tree")


@dataclass
class Forest:
    """Array form of a tree table for vectorised evaluation inside tasks."""
    weight: np.ndarray        # per tree
    root: np.ndarray          # row index of each tree's root
    left: np.ndarray          # child row indices, -1 at leaves
    right: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    categories: list          # None or set of left-going categories
    value: np.ndarray         # node prediction
    cover: np.ndarray         # training weight reaching the node

    @staticmethod
    def from_pandas(t: pd.DataFrame) -> "Forest":
        t = t.sort_values(["tree", "node"]).reset_index(drop=True)
        pos = {(tr, nd): i for i, (tr, nd) in enumerate(zip(t.tree, t.node))}
        left = np.array([pos.get((tr, l), -1) if l >= 0 else -1 for tr, l in zip(t.tree, t.left)])
        right = np.array([pos.get((tr, r), -1) if r >= 0 else -1 for tr, r in zip(t.tree, t.right)])
        trees = sorted(t.tree.unique())
        roots = np.array([pos[(tr, 0)] for tr in trees])
        w = t.groupby("tree").weight.first().reindex(trees).to_numpy()
        cats = [set(c) if c is not None and len(c) else None for c in t.categories]
        return Forest(w, roots, left, right, t.feature.fillna(-1).astype(int).to_numpy(),
                      t.threshold.fillna(0.0).to_numpy(), cats, t.prediction.to_numpy(), t.cover.to_numpy())

    def goes_left(self, node: int, x: np.ndarray) -> np.ndarray:
        f = self.feature[node]
        if self.categories[node] is not None:
            return np.isin(x[:, f], list(self.categories[node]))
        return x[:, f] <= self.threshold[node]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Weighted sum of tree outputs (GBT regression / GBT margin)."""
        x = np.asarray(x, dtype=float)
        out = np.zeros(len(x))
        for w, root in zip(self.weight, self.root):
            node = np.full(len(x), root)
            active = self.left[node] >= 0
            while active.any():
                idx = np.nonzero(active)[0]
                for nd in np.unique(node[idx]):
                    sel = idx[node[idx] == nd]
                    gl = self.goes_left(nd, x[sel])
                    node[sel] = np.where(gl, self.left[nd], self.right[nd])
                active = self.left[node] >= 0
            out += w * self.value[node]
        return out
