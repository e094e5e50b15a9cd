"""Registered model jobs (M4, M5, M9-M14, R3, S7): rows-only checks.

Model keys read the whole master; the driver's tables carry no learnable
signal, so these keys check shape and determinism (model quality is tested
on planted data in ``tests/test_models.py``).
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.operators import evaluate as E
from wardline.operators import ml_prep as M
from wardline.operators import models as MD
from wardline.operators import risk as R
from wardline.operators.boosting import Bins, quantile_bins
from wardline.operators.forests import BINS
from wardline.plans import clinical as K
from wardline.plans.catalog import MASTER_INPUTS, master, register
from wardline.session import stored_rows
from wardline.sources.tables import (
    committed_runs, input_fingerprint, load_pipeline, log_runs, read_runs, runs_folder, save_pipeline, serving_folder,
)

T = K.TARGET
ID = "admission_id"


class Job:
    """One classifier job over the master: split, fitted features, design
    matrices (that of the training rows is stored, when first asked for) and
    class weights."""

    def __init__(self, spark, sf_dir, target: str = T, high_risk: bool = False, folds: bool = False):
        m = master(spark, sf_dir)
        if high_risk:
            m = K.high_risk_target(m, "high_risk")
            drop = K.HIGH_RISK_LEAKAGE + K.ID_DATE_COLS + ["high_risk"]
            target = "high_risk"
        else:
            drop = K.READMISSION_DROP
        self.target = target
        self.num, self.cat = M.feature_columns(m, drop)
        # stored once, with the columns that follow-up passes read: none of
        # them ranks the classes or reads the other columns again
        used = dict.fromkeys([ID, target, *self.num, *self.cat, *K.READMISSION_INPUTS])
        sp = stored_rows(M.stratified_split(m, ID, target, 0.2, 42).select(*used, "split"))
        self.train_rows = sp.filter(F.col("split") == "train")
        self.test_rows = sp.filter(F.col("split") == "test")
        self.prep = MD.fit_features(self.train_rows, self.num, self.cat)
        w = M.class_weights(self.train_rows, target).first()  # one aggregate row
        self.n_weight = float(w["n"])
        self.pos_weight = float(w["pos_weight"] or 1.0)
        self.folds = folds

    @cached_property
    def train(self) -> DataFrame:
        t = self.target
        tr = M.with_weights(self.train_rows, t, M.class_weights(self.train_rows, t))
        tr = tr.withColumn("pos_w", F.when(F.col(t) == 1, F.lit(self.pos_weight)).otherwise(F.lit(1.0)))
        if self.folds:
            tr = M.assign_folds(tr, ID, t, 5, 42)
        keep = [ID, t, "weight", "pos_w"] + (["fold"] if self.folds else [])
        return MD.design(tr, self.prep, keep)

    @cached_property
    def test(self) -> DataFrame:
        return self.prep.transform(self.test_rows).select(ID, self.target, "features")

    @cached_property
    def bins(self) -> Bins:
        """The training rows' bins, found once for both tree baselines."""
        return quantile_bins(self.train, "features", BINS)

    def estimators(self):
        t = self.target
        return {
            "logistic_regression": MD.logistic(t, "weight", self.n_weight),
            "random_forest": MD.forest(t, "weight"),
            "boosted_trees": MD.boosted(t, "pos_w"),
        }


_JOBS: dict = {}
_FITTED: dict = {}


def _inputs(spark, sf_dir) -> tuple[str, str]:
    """The application and a digest of its input files as they are now."""
    return spark.sparkContext.applicationId, input_fingerprint(spark, [f"{sf_dir.rstrip('/')}/{t}.parquet" for t in MASTER_INPUTS])


def job(spark, sf_dir, high_risk: bool = False, folds: bool = False) -> Job:
    """One Job per (session, inputs, kind): its checkpointed design matrices
    are shared by every key that trains on them."""
    key = (*_inputs(spark, sf_dir), high_risk, folds)
    if key not in _JOBS:
        _JOBS[key] = Job(spark, sf_dir, high_risk=high_risk, folds=folds)
    return _JOBS[key]


def fitted(spark, sf_dir, name: str, high_risk: bool = False):
    key = (*_inputs(spark, sf_dir), high_risk, name)
    if key not in _FITTED:
        j = job(spark, sf_dir, high_risk)
        estimator = j.estimators()[name]
        if name != "logistic_regression":
            estimator.bins = j.bins
        _FITTED[key] = estimator.fit(j.train)
    return _FITTED[key]


def _metrics_row(name: str, scored: DataFrame, label: str) -> DataFrame:
    auc = E.roc_auc(scored, label, "probability")
    prf = E.binary_metrics(scored, label, "prediction")
    return auc.crossJoin(prf).select(F.lit(name).alias("model"), "roc_auc", "f1", "precision", "recall")


# -- M4, M5 ------------------------------------------------------------------
def _one_hot_sql() -> str:
    from wardline.plans.master_schema import CATEGORICAL_FEATURES as CATS
    from wardline.plans.ml_queries import q

    cols = ", ".join(
        f"list_transform(oh_levels.{c}, lambda x: CASE WHEN f.{c} = x THEN 1.0e0 ELSE 0.0e0 END) AS {c}" for c in CATS)
    return q(f"SELECT f.admission_id, {cols} FROM oh_filled f, oh_levels WHERE f.split = 'test'", _oh_ctes())


def _oh_ctes() -> dict[str, str]:
    """Train-split modes, filled categorical columns and sorted levels."""
    from wardline.plans.master_schema import CATEGORICAL_FEATURES as CATS

    modes = ", ".join(
        f"(SELECT v FROM (SELECT {c} AS v, count(*) AS n FROM sp WHERE split = 'train' AND {c} IS NOT NULL "
        f"GROUP BY 1) ORDER BY n DESC, v LIMIT 1) AS {c}" for c in CATS)
    filled = ", ".join(f"coalesce(sp.{c}, oh_modes.{c}) AS {c}" for c in CATS)
    levels = ", ".join(
        f"(SELECT list(DISTINCT {c} ORDER BY {c}) FROM oh_filled WHERE split = 'train') AS {c}" for c in CATS)
    return {
        "oh_modes": f"\n  SELECT {modes}",
        "oh_filled": f"\n  SELECT sp.admission_id, sp.split, {filled} FROM sp, oh_modes",
        "oh_levels": f"\n  SELECT {levels}",
    }



@register("one_hot", _one_hot_sql())
def _one_hot(spark, sf_dir):
    j = job(spark, sf_dir)
    enc = j.prep.transform(j.test_rows)
    return enc.select(ID, *[vector_to_array(f"{c}__oh").alias(c) for c in j.cat])


def _feature_matrix_sql() -> str:
    from wardline.plans.master_schema import CATEGORICAL_FEATURES as CATS
    from wardline.plans.master_schema import NUMERIC_FEATURES as NUMS
    from wardline.plans.ml_queries import q

    oh = _oh_ctes()
    med = ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS {c}" for c in NUMS)
    mom = ", ".join(f"avg(coalesce(CAST(sp.{c} AS DOUBLE), fm_med.{c})) AS m_{c}, "
                    f"stddev_pop(coalesce(CAST(sp.{c} AS DOUBLE), fm_med.{c})) AS s_{c}" for c in NUMS)
    scaled = ", ".join(
        f"(coalesce(CAST(sp.{c} AS DOUBLE), fm_med.{c}) - fm_mom.m_{c}) / "
        f"CASE WHEN fm_mom.s_{c} = 0 OR fm_mom.s_{c} IS NULL THEN 1.0e0 ELSE fm_mom.s_{c} END" for c in NUMS)
    hots = ", ".join(
        f"list_transform(oh_levels.{c}, lambda x: CASE WHEN f.{c} = x THEN 1.0e0 ELSE 0.0e0 END)" for c in CATS)
    return q(f"""
SELECT sp.admission_id, sp.{T}, sp.split,
  list_transform(list_concat([{scaled}], {hots}), lambda x: round_even(x * 1e6, 0) / 1e6) AS features
FROM sp JOIN oh_filled f ON f.admission_id = sp.admission_id, fm_med, fm_mom, oh_levels""", {
        **oh,
        "fm_med": f"\n  SELECT {med} FROM sp WHERE split = 'train'",
        "fm_mom": f"\n  SELECT {mom} FROM sp, fm_med WHERE sp.split = 'train'",
    })


@register("feature_matrix", _feature_matrix_sql())
def _feature_matrix(spark, sf_dir):
    j = job(spark, sf_dir)
    arr = F.transform(vector_to_array("features"), lambda x: F.rint(x * 1e6) / 1e6).alias("features")
    tr = j.train.select(ID, T, F.lit("train").alias("split"), arr)
    te = j.test.select(ID, T, F.lit("test").alias("split"), arr)
    return tr.unionByName(te)


# -- M9-M11 --------------------------------------------------------------------
def _fit_one(name: str):
    def fn(spark, sf_dir):
        return MD.score(fitted(spark, sf_dir, name), job(spark, sf_dir).test, [ID, T])
    return fn


register("fit_logistic")(_fit_one("logistic_regression"))
register("fit_forest")(_fit_one("random_forest"))
register("fit_boosted")(_fit_one("boosted_trees"))


# -- M12 ---------------------------------------------------------------------
@register("model_comparison")
def _model_comparison(spark, sf_dir):
    j = job(spark, sf_dir)
    rows = [_metrics_row(n, MD.score(fitted(spark, sf_dir, n), j.test, [ID, T]), T) for n in j.estimators()]
    return reduce(DataFrame.unionByName, rows).orderBy(F.desc("roc_auc"))


@register("high_risk_comparison")
def _high_risk_comparison(spark, sf_dir):
    j = job(spark, sf_dir, high_risk=True)
    t = j.target
    maj = M.majority_class(j.train, t)
    base = j.test.select(ID, t).crossJoin(F.broadcast(maj)).select(
        ID, t, F.col("majority").cast("double").alias("probability"), F.col("majority").alias("prediction"))
    rows = [_metrics_row("majority_baseline", base, t)]
    rows += [_metrics_row(n, MD.score(fitted(spark, sf_dir, n, True), j.test, [ID, t]), t) for n in j.estimators()]
    return reduce(DataFrame.unionByName, rows).orderBy(F.desc("recall"))


# -- M13 ---------------------------------------------------------------------
@register("random_search")
def _random_search(spark, sf_dir):
    """20 sampled points of the logistic grid, 5 folds, ROC-AUC, refit."""
    j = job(spark, sf_dir, folds=True)
    combos = MD.sample_grid(MD.GRID_LOGISTIC, 20, 42)
    maps = [MD.spark_params("logistic", c, j.n_weight) for c in combos]
    cv, metrics = MD.random_search(j.estimators()["logistic_regression"], maps, j.train, T, "fold", 5)
    names = MD.describe_maps(combos)
    rows = [(i, names[i], float(m)) for i, m in enumerate(metrics)]
    best = max(range(len(rows)), key=lambda i: (rows[i][2], -i))
    scored = MD.score(cv.bestModel, j.test, [ID, T])
    test_auc = E.roc_auc(scored, T, "probability").first()["roc_auc"]
    return spark.createDataFrame(
        [(i, n, round(a, 4), i == best, test_auc if i == best else None) for i, n, a in rows],
        "candidate int, params string, cv_roc_auc double, is_best boolean, test_roc_auc double")


# -- J6 + M14 + R3 ---------------------------------------------------------------
def _batch_scores(spark, sf_dir):
    """Test patients given only the 13 form inputs, the other features from
    the defaults of all rows (median / mode), scored by the logistic model."""
    from pyspark.ml.classification import LogisticRegressionModel

    j = job(spark, sf_dir)
    path = serving_folder(spark, "readmission")
    save_pipeline(j.prep, fitted(spark, sf_dir, "logistic_regression"), path, M.feature_defaults(master(spark, sf_dir), j.num, j.cat))
    prep, model = load_pipeline(spark, path, LogisticRegressionModel)  # scoring starts from what was saved
    defaults = spark.read.parquet(f"{path}/defaults")
    wide = defaults.agg(*[F.max(F.when(F.col("feature") == c, F.col("num_default" if c in j.num else "cat_default")))
                          .alias(c) for c in j.num + j.cat])
    inputs = j.test_rows.select(ID, T, *K.READMISSION_INPUTS)
    rows = R.overlay_defaults(inputs, wide)
    design = prep.transform(rows).select(ID, T, "features")
    return MD.score(model, design, [ID, T]).withColumn("risk_band", R.risk_band("probability"))


register("batch_score")(_batch_scores)


@register("risk_band")
def _risk_band(spark, sf_dir):
    return _batch_scores(spark, sf_dir).groupBy("risk_band").agg(F.count(F.lit(1)).alias("n"))


# -- S7 ----------------------------------------------------------------------
def _logged(spark, sf_dir, stage: str, compare) -> DataFrame:
    """Records of one comparison, entered under a key of its inputs: where that
    comparison is in the log already, it is read and nothing is fitted."""
    key, root = f"{stage}-{_inputs(spark, sf_dir)[1]}", runs_folder(spark)
    if committed_runs(spark, root, key):
        return read_runs(spark, root, key)
    return log_runs(compare(spark, sf_dir).select(
        F.concat(F.lit(f"{stage}_"), F.col("model")).alias("run_name"),
        F.lit(stage).alias("stage"),
        F.create_map(F.lit("model"), F.col("model")).alias("params"),
        F.create_map(*[x for m in ("roc_auc", "f1", "precision", "recall") for x in (F.lit(m), F.col(m))]).alias("metrics"),
    ), key)


@register("run_log")
def _run_log(spark, sf_dir):
    """Run records of the readmission baselines: ``(run_name, stage, params,
    metrics, artifact, run_id, logged_at)``."""
    return _logged(spark, sf_dir, "baseline", _model_comparison)


@register("run_log_high_risk")
def _run_log_high_risk(spark, sf_dir):
    """Run records of the high-risk baselines."""
    return _logged(spark, sf_dir, "high_risk", _high_risk_comparison)


# -- R1, R2 ------------------------------------------------------------------
def _attributions(spark, sf_dir):
    """High-risk boosted model, attributions of every test row."""
    from wardline.operators.attribution import attributions

    model = fitted(spark, sf_dir, "boosted_trees", True)
    j = job(spark, sf_dir, True)
    names = j.prep.feature_names(j.test_rows)
    return attributions(spark, model, j.test, ID, len(names)), names


@register("attribution")
def _attribution(spark, sf_dir):
    return _attributions(spark, sf_dir)[0]


@register("attribution_top")
def _attribution_top(spark, sf_dir):
    from wardline.operators.attribution import top_positive

    attr, names = _attributions(spark, sf_dir)
    return top_positive(attr, names, 30)


# -- M15 on model output ---------------------------------------------------------
HIGH_RISK_THRESHOLD = 0.4  # fixed value: the high-risk job's decision threshold


@register("high_risk_threshold")
def _high_risk_threshold(spark, sf_dir):
    """The high-risk evaluation at the 0.4 threshold: ROC-AUC and
    precision / recall / F1 of the boosted model's test predictions."""
    j = job(spark, sf_dir, high_risk=True)
    scored = MD.score(fitted(spark, sf_dir, "boosted_trees", True), j.test, [ID, j.target], HIGH_RISK_THRESHOLD)
    return E.roc_auc(scored, j.target, "probability").crossJoin(
        E.binary_metrics(scored, j.target, "prediction")).select(
        F.lit(HIGH_RISK_THRESHOLD).alias("threshold"), "roc_auc", "f1", "precision", "recall", "accuracy")
