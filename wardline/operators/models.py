"""Classifier jobs on ``pyspark.ml``.

Feature preparation is fitted on the training rows only: median impute and
population-std scaling as DataFrame aggregates (``ml_prep``), then
``StringIndexer(keep, alphabetAsc)`` + ``OneHotEncoder(dropLast)`` — the
extra "unknown" index is the dropped slot, so unseen categories encode as
all zeros — and one ``VectorAssembler``.  The assembled training matrix is
stored in the shared checkpoint folder before any iterative fit, so
every optimiser pass reads it instead of recomputing the joins behind it.
"""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.operators import boosting as B
from wardline.operators import ml_prep as M
from wardline.operators.forests import BINS, ForestClassifier, ForestModel
from wardline.operators.search import fit_all
from wardline.session import cut_lineage, stored_rows


@dataclass
class FeaturePrep:
    num: list[str]
    cat: list[str]
    params: DataFrame          # one row: medians, means, stds, modes
    encoder: PipelineModel     # indexers, one-hot, assembler

    def transform(self, df: DataFrame) -> DataFrame:
        filled = M.apply_impute_scale(df, self.params, self.num, self.cat)
        return self.encoder.transform(filled)

    def feature_names(self, df: DataFrame) -> list[str]:
        """Slot names of the assembled vector, from the ML attribute metadata."""
        meta = self.transform(df.limit(0)).schema["features"].metadata["ml_attr"]["attrs"]
        slots = sorted((a["idx"], a["name"]) for kind in meta.values() for a in kind)
        return [n for _, n in slots]


def fit_features(train: DataFrame, num: Sequence[str], cat: Sequence[str]) -> FeaturePrep:
    num, cat = list(num), list(cat)
    params = cut_lineage(M.fit_impute_scale(train, num, cat))  # one row
    filled = M.apply_impute_scale(train, params, num, cat)
    stages = []
    if cat:
        # one indexer for all columns: their levels come from one pass
        stages.append(StringIndexer(inputCols=cat, outputCols=[f"{c}__idx" for c in cat], handleInvalid="keep",
                                    stringOrderType="alphabetAsc"))
        # the indexer's "unknown" index is the last slot, so dropLast removes
        # it: an unseen category encodes as all zeros
        stages.append(OneHotEncoder(inputCols=[f"{c}__idx" for c in cat], outputCols=[f"{c}__oh" for c in cat],
                                    dropLast=True))
    stages.append(VectorAssembler(inputCols=num + [f"{c}__oh" for c in cat], outputCol="features",
                                  handleInvalid="keep"))
    return FeaturePrep(num, cat, params, Pipeline(stages=stages).fit(filled))


def design(df: DataFrame, prep: FeaturePrep, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns + ``features``, stored, which cuts the lineage."""
    return stored_rows(prep.transform(df).select(*keep, "features"))


# -- M9-M11 ------------------------------------------------------------------
def logistic(label: str, weight: str | None, n_weight: float, C: float = 1.0, l1: bool = False,
             max_iter: int = 1000, tol: float = 1e-4) -> LogisticRegression:
    """sklearn's ``C·Σ w·loss + ½‖β‖²`` is Spark's ``mean_w(loss) + ½λ‖β‖²``
    with ``λ = 1/(C·Σw)``; inputs are already standardised; ``tol`` is
    sklearn's default (Spark's is 1e-6)."""
    kw = dict(labelCol=label, featuresCol="features", maxIter=max_iter, tol=tol, regParam=1.0 / (C * n_weight),
              elasticNetParam=1.0 if l1 else 0.0, standardization=False)
    if weight:
        kw["weightCol"] = weight
    return LogisticRegression(**kw)


def forest(label: str, weight: str | None, trees: int = 100, depth: int = 30, leaf: int = 1,
           subset: str = "sqrt", seed: int = 42) -> ForestClassifier:
    """Spark's own forest sends sums for every node of every level; with trees
    as deep as these, whose nodes are nearly as many as the rows, that is many
    times the data."""
    return ForestClassifier(label, weight, trees, depth, leaf, subset, seed)


@dataclass
class BoostedClassifier:
    """Trees fitted to the residuals of the logistic loss.  ``bins``: of the
    rows, where they are known."""
    label: str
    weight: str | None
    params: B.Params
    bins: B.Bins | None = None

    def fit(self, df: DataFrame) -> B.BoostedTrees:
        return fit_all(df, self.label, self.weight, self.params, self.bins or B.quantile_bins(df, "features", BINS))


def boosted(label: str, weight: str | None, rounds: int = 100, depth: int = 6, step: float = 0.3,
            subsample: float = 1.0, columns: float = 1.0, leaf: int = 1, seed: int = 42) -> BoostedClassifier:
    return BoostedClassifier(label, weight, B.Params(rounds, depth, step, subsample, columns, min_child_weight=0.0,
                                                     lam=0.0, min_leaf=leaf, loss="residual", seed=seed))


# -- M14 ---------------------------------------------------------------------
def score(model, df: DataFrame, keep: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """``(*keep, probability, prediction)`` with ``probability`` = P(class 1)."""
    if isinstance(model, B.BoostedTrees | ForestModel):
        return model.score(df, keep, threshold=threshold)
    out = model.transform(df)
    p = vector_to_array("probability")[1]
    return out.select(*keep, p.alias("probability"), (p >= threshold).cast("int").alias("prediction"))


# -- M13 ---------------------------------------------------------------------
def sample_grid(grid: Mapping[str, Sequence], n_iter: int, seed: int = 42) -> list[dict]:
    """``n_iter`` distinct combinations of a full grid, drawn without
    replacement by index (the grid is never materialised)."""
    keys = list(grid)
    sizes = [len(grid[k]) for k in keys]
    total = 1
    for s in sizes:
        total *= s
    picks = random.Random(seed).sample(range(total), min(n_iter, total))
    out = []
    for idx in picks:
        combo = {}
        for k, s in zip(reversed(keys), reversed(sizes)):
            combo[k] = grid[k][idx % s]
            idx //= s
        out.append({k: combo[k] for k in keys})
    return out


def random_search(estimator, param_maps: list[dict], train: DataFrame, label: str, fold_col: str, folds: int = 5,
                  parallelism: int = 4):
    """Cross-validated ROC-AUC for each parameter map (folds from a column),
    then a refit of the best map on all training rows.  Maps that say the same
    are fitted once.  ``parallelism`` bounds concurrent fits (each fit's jobs
    use the cores too).  Returns the fitted search and the metric of every map
    as given."""
    keys = [tuple(sorted(pm.items())) for pm in param_maps]
    distinct = list(dict.fromkeys(keys))
    maps = [{estimator.getParam(k): v for k, v in key} for key in distinct]
    ev = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="rawPrediction",
                                       metricName="areaUnderROC", numBins=0)
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=maps, evaluator=ev, numFolds=folds,
                        foldCol=fold_col, parallelism=parallelism, seed=42)
    found = cv.fit(train)
    metric = dict(zip(distinct, found.avgMetrics))
    return found, [metric[k] for k in keys]


# The reference's search grids, and how each maps onto Spark.
GRID_LOGISTIC = {"C": [0.001, 0.01, 0.1, 1, 10, 100], "penalty": ["l1", "l2"], "solver": ["liblinear", "saga"]}
GRID_FOREST = {"n_estimators": [100, 200, 300], "max_depth": [None, 10, 20, 30],
               "min_samples_split": [2, 5, 10], "min_samples_leaf": [1, 2, 4], "max_features": ["sqrt", "log2"]}
GRID_BOOSTED = {"n_estimators": [100, 200, 300, 500], "max_depth": [3, 4, 5, 6, 7, 9],
                "learning_rate": [0.005, 0.01, 0.05, 0.1, 0.2], "subsample": [0.5, 0.6, 0.8, 1.0],
                "colsample_bytree": [0.5, 0.6, 0.8, 1.0], "min_child_weight": [1, 3, 5, 10],
                "gamma": [0, 0.1, 0.3, 0.5], "reg_alpha": [0, 0.01, 0.1, 1.0], "reg_lambda": [0.5, 1.0, 2.0, 5.0]}


def spark_params(kind: str, combo: Mapping, n_weight: float) -> dict:
    """Reference grid point → Spark params (solver, min_samples_split and
    reg_alpha/lambda have no counterpart and are dropped)."""
    if kind == "logistic":
        return {"regParam": 1.0 / (combo["C"] * n_weight), "elasticNetParam": 1.0 if combo["penalty"] == "l1" else 0.0}
    if kind == "forest":
        return {"numTrees": combo["n_estimators"], "maxDepth": combo["max_depth"] or 30,
                "minInstancesPerNode": combo["min_samples_leaf"], "featureSubsetStrategy": combo["max_features"]}
    return {"maxIter": combo["n_estimators"], "maxDepth": combo["max_depth"], "stepSize": combo["learning_rate"],
            "subsamplingRate": combo["subsample"], "featureSubsetStrategy": str(combo["colsample_bytree"]),
            "minInstancesPerNode": combo["min_child_weight"], "minInfoGain": combo["gamma"]}


GRIDS = {"logistic": GRID_LOGISTIC, "forest": GRID_FOREST, "boosted": GRID_BOOSTED}


def describe_maps(maps: list[dict]) -> list[str]:
    return [", ".join(f"{k}={v}" for k, v in sorted(m.items())) for m in maps]
