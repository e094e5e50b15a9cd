"""Registered model-preparation, evaluation and risk queries with SQL oracles
(T1, T3, M1-M3, M6-M8, M15, E1-E4, R4-R7, J6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.operators import evaluate as E
from wardline.operators import ml_prep as M
from wardline.operators import risk as R
from wardline.plans import clinical as K
from wardline.plans import oracle as O
from wardline.plans.catalog import master, register
from wardline.plans.master_schema import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from wardline.session import cut_lineage

T = K.TARGET
SEED = 42
IMPUTE_NUM = ["bmi", "heart_rate_std", "avg_ed_wait_minutes", "pct_abnormal_labs", "age", "cost_per_day",
              "icu_ratio"]
IMPUTE_CAT = ["age_group", "smoking_status", "admission_type"]
OVERLAY_EXTRA = ["bmi", "num_lab_tests", "avg_ed_wait_minutes", "ethnicity"]


def rank_sql(src: str, label: str, seed: int) -> str:
    """Rows of ``src`` with their rank ``rk`` in the class and its size ``cn``."""
    return (f"SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY md5('{seed}:' || CAST(admission_id AS VARCHAR)), "
            f"admission_id) - 1 AS rk, count(*) OVER (PARTITION BY {label}) AS cn FROM {src}")


SPLIT_SQL = {
    "sp": f"""
  SELECT * EXCLUDE (rk, cn), CASE WHEN rk < floor(cn * 0.8e0 + 0.5) THEN 'train' ELSE 'test' END AS split
  FROM ({rank_sql('master', T, SEED)})""",
}


def q(body: str, extra: dict[str, str] | None = None) -> str:
    return O.with_ctes(body, "master", extra={**SPLIT_SQL, **(extra or {})})


def split_master(spark, sf_dir):
    return M.stratified_split(master(spark, sf_dir), "admission_id", T, 0.2, SEED)


# -- T1, T3 --------------------------------------------------------------------
@register("stratified_split", q(f"SELECT admission_id, {T}, split FROM sp"))
def _stratified_split(spark, sf_dir):
    return split_master(spark, sf_dir).select("admission_id", T, "split")


@register("cv_folds", q(f"""
SELECT admission_id, {T}, CAST({' + '.join(f'CAST(rk >= floor(cn * {j / 5!r}e0 + 0.5) AS INTEGER)' for j in range(1, 5))} AS INTEGER) AS fold
FROM ({rank_sql("(SELECT * FROM sp WHERE split = 'train')", T, SEED + 1)})"""))
def _cv_folds(spark, sf_dir):
    tr = split_master(spark, sf_dir).filter(F.col("split") == "train")
    return M.assign_folds(tr, "admission_id", T, 5, SEED).select("admission_id", T, "fold")


# -- M1-M3 ---------------------------------------------------------------------
def _impute_sql() -> str:
    med = ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS {c}__med" for c in IMPUTE_NUM)
    mom = ", ".join(
        f"avg(coalesce(CAST({c} AS DOUBLE), {c}__med)) AS {c}__mean, "
        f"stddev_pop(coalesce(CAST({c} AS DOUBLE), {c}__med)) AS {c}__std" for c in IMPUTE_NUM)
    mode = ", ".join(
        f"(SELECT v FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM sp WHERE split = 'train' AND {c} IS NOT NULL "
        f"GROUP BY 1) ORDER BY n DESC, v LIMIT 1) AS {c}__mode" for c in IMPUTE_CAT)
    nums = ", ".join(
        f"(coalesce(CAST({c} AS DOUBLE), {c}__med) - {c}__mean) / "
        f"CASE WHEN {c}__std = 0 OR {c}__std IS NULL THEN 1.0 ELSE {c}__std END AS {c}" for c in IMPUTE_NUM)
    cats = ", ".join(f"coalesce({c}, {c}__mode) AS {c}" for c in IMPUTE_CAT)
    return f"""
SELECT admission_id, split, {nums}, {cats}
FROM sp,
  (SELECT {med} FROM sp WHERE split = 'train') med,
  (SELECT {mom} FROM sp, (SELECT {med} FROM sp WHERE split = 'train') m2 WHERE split = 'train') mom,
  (SELECT {mode}) mo"""


@register("impute_scale", q(_impute_sql()), settle=IMPUTE_NUM)
def _impute_scale(spark, sf_dir):
    # the part is written once; medians, moments, modes and the result read that
    df = cut_lineage(split_master(spark, sf_dir).select("admission_id", "split", *IMPUTE_NUM, *IMPUTE_CAT))
    params = M.fit_impute_scale(df.filter(F.col("split") == "train"), IMPUTE_NUM, IMPUTE_CAT)
    return M.apply_impute_scale(df, params, IMPUTE_NUM, IMPUTE_CAT)


# -- M6 --------------------------------------------------------------------------
def _defaults_sql(num, cat, src="master") -> str:
    parts = [f"SELECT '{c}' AS feature, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS num_default, "
             f"CAST(NULL AS VARCHAR) AS cat_default FROM {src}" for c in num]
    parts += [f"SELECT '{c}' AS feature, CAST(NULL AS DOUBLE) AS num_default, "
              f"(SELECT v FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM {src} WHERE {c} IS NOT NULL "
              f"GROUP BY 1) ORDER BY n DESC, v LIMIT 1) AS cat_default" for c in cat]
    return "\nUNION ALL\n".join(parts)


@register("feature_defaults", O.with_ctes(_defaults_sql(NUMERIC_FEATURES, CATEGORICAL_FEATURES), "master"),
          settle=["num_default"])
def _feature_defaults(spark, sf_dir):
    m = master(spark, sf_dir)
    num, cat = M.feature_columns(m, K.READMISSION_DROP)
    return M.feature_defaults(m, num, cat)


# -- M7, M8 ----------------------------------------------------------------------
@register("class_weights", q(f"""
SELECT count({T}) AS n, CAST(sum(CASE WHEN {T} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_0,
  CAST(sum(CASE WHEN {T} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_1,
  count({T}) / NULLIF(2 * sum(CASE WHEN {T} = 0 THEN 1 ELSE 0 END), 0) AS weight_0,
  count({T}) / NULLIF(2 * sum(CASE WHEN {T} = 1 THEN 1 ELSE 0 END), 0) AS weight_1,
  sum(CASE WHEN {T} = 0 THEN 1 ELSE 0 END) / NULLIF(sum(CASE WHEN {T} = 1 THEN 1 ELSE 0 END), 0) AS pos_weight
FROM sp WHERE split = 'train'"""), settle=["weight_0", "weight_1", "pos_weight"])
def _class_weights(spark, sf_dir):
    return M.class_weights(split_master(spark, sf_dir).filter(F.col("split") == "train"), T)


def _metrics_sql(src: str, label: str, pred: str) -> str:
    tp = f"sum(CASE WHEN {label} = 1 AND {pred} = 1 THEN 1 ELSE 0 END)"
    fp = f"sum(CASE WHEN {label} = 0 AND {pred} = 1 THEN 1 ELSE 0 END)"
    fn = f"sum(CASE WHEN {label} = 1 AND {pred} = 0 THEN 1 ELSE 0 END)"
    tn = f"sum(CASE WHEN {label} = 0 AND {pred} = 0 THEN 1 ELSE 0 END)"
    return f"""
SELECT {O.rnd(f'coalesce({tp} / NULLIF({tp} + {fp}, 0), 0.0)', 4)} AS precision,
  {O.rnd(f'coalesce({tp} / NULLIF({tp} + {fn}, 0), 0.0)', 4)} AS recall,
  {O.rnd(f'coalesce(2 * {tp} / NULLIF(2 * {tp} + {fp} + {fn}, 0), 0.0)', 4)} AS f1,
  {O.rnd(f'({tp} + {tn}) / NULLIF({tp} + {tn} + {fp} + {fn}, 0)', 4)} AS accuracy
FROM {src}"""


@register("majority_baseline", q(f"""
SELECT (SELECT majority FROM maj) AS majority, m.* FROM ({_metrics_sql('pr', T, 'prediction')}) m""", {
    "maj": f"""
  SELECT {T} AS majority FROM sp WHERE split = 'train' AND {T} IS NOT NULL
  GROUP BY {T} ORDER BY count(*) DESC, {T} LIMIT 1""",
    "pr": f"""
  SELECT sp.{T}, maj.majority AS prediction FROM sp, maj WHERE split = 'test'"""}))
def _majority_baseline(spark, sf_dir):
    sp = split_master(spark, sf_dir)
    maj = M.majority_class(sp.filter(F.col("split") == "train"), T)
    test = sp.filter(F.col("split") == "test").select(T).crossJoin(F.broadcast(maj)).withColumn(
        "prediction", F.col("majority"))
    return maj.crossJoin(E.binary_metrics(test, T, "prediction"))


# -- E1-E4, M15 ------------------------------------------------------------------
SCORE = "pct_abnormal_labs"   # a deterministic per-admission score
RULE = "is_high_utiliser"     # a deterministic 0/1 rule used as a prediction


@register("roc_auc", O.with_ctes(f"""
SELECT {O.rnd('sum(n1 * (below + 0.5 * n0)) / (CAST(sum(n0) AS DOUBLE) * sum(n1))', 4)} AS roc_auc
FROM (SELECT n0, n1, coalesce(sum(n0) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
      FROM (SELECT CAST({SCORE} AS DOUBLE) AS s, sum(CASE WHEN {T} = 0 THEN 1 ELSE 0 END) AS n0,
                   sum(CASE WHEN {T} = 1 THEN 1 ELSE 0 END) AS n1
            FROM master WHERE {T} IS NOT NULL AND {SCORE} IS NOT NULL GROUP BY 1))""", "master"))
def _roc_auc(spark, sf_dir):
    return E.roc_auc(master(spark, sf_dir), T, SCORE)


@register("binary_metrics", O.with_ctes(_metrics_sql("master", T, RULE), "master"))
def _binary_metrics(spark, sf_dir):
    return E.binary_metrics(master(spark, sf_dir), T, RULE)


@register("confusion_matrix", O.with_ctes(f"""
SELECT CAST(a.v AS INTEGER) AS actual, CAST(p.v AS INTEGER) AS predicted, count(m.{T}) AS count
FROM (VALUES (0), (1)) a(v) CROSS JOIN (VALUES (0), (1)) p(v)
LEFT JOIN master m ON m.{T} = a.v AND m.{RULE} = p.v GROUP BY 1, 2""", "master"))
def _confusion_matrix(spark, sf_dir):
    return E.confusion_matrix(master(spark, sf_dir), T, RULE)


def _report_sql() -> str:
    c = f"""(SELECT CAST(sum(CASE WHEN {T} = 0 AND {RULE} = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS tn,
                CAST(sum(CASE WHEN {T} = 0 AND {RULE} = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
                CAST(sum(CASE WHEN {T} = 1 AND {RULE} = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS fn,
                CAST(sum(CASE WHEN {T} = 1 AND {RULE} = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS tp FROM master)"""
    return f"""
SELECT * FROM (WITH c AS {c},
prf AS (SELECT *, coalesce(tp / NULLIF(tp + fp, 0), 0.0) AS p1, coalesce(tp / NULLIF(tp + fn, 0), 0.0) AS r1,
          coalesce(2 * tp / NULLIF(2 * tp + fp + fn, 0), 0.0) AS f1,
          coalesce(tn / NULLIF(tn + fn, 0), 0.0) AS p0, coalesce(tn / NULLIF(tn + fp, 0), 0.0) AS r0,
          coalesce(2 * tn / NULLIF(2 * tn + fn + fp, 0), 0.0) AS f0,
          tn + fp AS s0, tp + fn AS s1, tn + fp + tp + fn AS n FROM c)
SELECT '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1, CAST(s0 AS BIGINT) AS support FROM prf
UNION ALL SELECT '1', p1, r1, f1, CAST(s1 AS BIGINT) FROM prf
UNION ALL SELECT 'accuracy', NULL, NULL, (tp + tn) / NULLIF(n, 0), CAST(n AS BIGINT) FROM prf
UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, CAST(n AS BIGINT) FROM prf
UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / NULLIF(n, 0), (r0 * s0 + r1 * s1) / NULLIF(n, 0),
  (f0 * s0 + f1 * s1) / NULLIF(n, 0), CAST(n AS BIGINT) FROM prf)"""


@register("classification_report", O.with_ctes(_report_sql(), "master"), settle=["precision", "recall", "f1"])
def _classification_report(spark, sf_dir):
    return E.classification_report(master(spark, sf_dir), T, RULE)


@register("apply_threshold", O.with_ctes(f"""
SELECT admission_id, {SCORE}, CAST({SCORE} >= 0.4 AS INTEGER) AS prediction FROM master""", "master"))
def _apply_threshold(spark, sf_dir):
    return E.apply_threshold(master(spark, sf_dir).select("admission_id", SCORE), SCORE, 0.4)


# -- R4-R7 -----------------------------------------------------------------------
def _profile_sql(factors: list[tuple[str, str]]) -> str:
    rows = "\nUNION ALL\n".join(f"SELECT admission_id, {i} AS i, '{n}' AS factor, CAST({e} AS DOUBLE) AS value FROM master"
                                for i, (n, e) in enumerate(factors))
    return f"""
SELECT admission_id, factor, value,
  CASE WHEN value > 0.6 THEN 'high' WHEN value > 0.3 THEN 'moderate' WHEN value IS NOT NULL THEN 'low' END AS level,
  CAST(row_number() OVER (PARTITION BY admission_id ORDER BY value ASC NULLS LAST, i) AS INTEGER) AS position
FROM ({rows})"""


def _cap(c: str, d: int) -> str:
    v = f"(CAST({c} AS DOUBLE) / {d})"
    return f"CASE WHEN {v} > 1.0 THEN 1.0 ELSE {v} END"


_COMORB4 = " + ".join(R.FOUR_COMORBIDITIES)


@register("risk_profile", O.with_ctes(_profile_sql(
    [(n, _cap(c, d)) for n, c, d, _ in R.READMISSION_FACTORS] + [("Comorbidities", f"({_COMORB4}) / 4")]), "master"),
    settle=["value"])
def _risk_profile(spark, sf_dir):
    return R.readmission_profile(master(spark, sf_dir), "admission_id").withColumn(
        "position", F.col("position").cast("int"))


def _case_map(c: str, mapping: dict) -> str:
    return "CASE " + " ".join(f"WHEN {c} = '{k}' THEN {v}" for k, v in mapping.items()) + " END"


@register("risk_profile_hr", O.with_ctes(_profile_sql(
    [(n, _cap(c, d)) for n, c, d, _ in R.HIGH_RISK_FACTORS] + [
        ("Low Social Support", "1 - social_support_score / 10"),
        ("Comorbidities", f"({_COMORB4}) / 4"),
        ("Smoking", _case_map("smoking_status", R.SMOKE_MAP)),
        ("Alcohol Use", _case_map("alcohol_use", R.ALCOHOL_MAP)),
    ]), "master"), settle=["value"])
def _risk_profile_hr(spark, sf_dir):
    return R.high_risk_profile(master(spark, sf_dir), "admission_id").withColumn(
        "position", F.col("position").cast("int"))


@register("risk_flags", O.with_ctes(f"""
SELECT admission_id, array_to_string(fl, '; ') AS flags, CAST(len(fl) AS INTEGER) AS n_flags
FROM (SELECT admission_id, list_filter([
    CASE WHEN age >= 75 THEN '{R.FLAG_TEXT["age"]}' END,
    CASE WHEN length_of_stay_days >= 7 THEN '{R.FLAG_TEXT["los"]}' END,
    CASE WHEN charlson_comorbidity_index >= 3 THEN '{R.FLAG_TEXT["charlson"]}' END,
    CASE WHEN num_prior_admissions >= 3 THEN '{R.FLAG_TEXT["prior"]}' END,
    CASE WHEN ({_COMORB4}) >= 2 THEN CAST(({_COMORB4}) AS VARCHAR) || ' Comorbidities' END,
    CASE WHEN admission_type = 'Emergency' THEN '{R.FLAG_TEXT["emergency"]}' END], lambda x: x IS NOT NULL) AS fl
  FROM master)""", "master"))
def _risk_flags(spark, sf_dir):
    return R.risk_flags(master(spark, sf_dir), "admission_id")


# -- J6 --------------------------------------------------------------------------
_OVERLAY_NUM = [c for c in K.READMISSION_INPUTS + OVERLAY_EXTRA if c in NUMERIC_FEATURES]


@register("overlay_defaults", settle=_OVERLAY_NUM, sql=q(f"""
SELECT sp.admission_id, {', '.join(f'coalesce(sp.{c}, d.{c}) AS {c}' for c in K.READMISSION_INPUTS)},
  {', '.join(f'd.{c} AS {c}' for c in OVERLAY_EXTRA)}
FROM sp, (SELECT {', '.join(
        f'quantile_cont({c}, 0.5) AS {c}' if c in NUMERIC_FEATURES else
        f'(SELECT v FROM (SELECT {c} AS v, count(*) AS n FROM master WHERE {c} IS NOT NULL GROUP BY 1) ORDER BY n DESC, v LIMIT 1) AS {c}'
        for c in K.READMISSION_INPUTS + OVERLAY_EXTRA)} FROM master) d
WHERE sp.split = 'test'"""))
def _overlay_defaults(spark, sf_dir):
    m = master(spark, sf_dir)
    cols = K.READMISSION_INPUTS + OVERLAY_EXTRA
    num = [c for c in cols if c in NUMERIC_FEATURES]
    cat = [c for c in cols if c not in num]
    d = M.feature_defaults(m, num, cat)
    wide = d.agg(*[F.max(F.when(F.col("feature") == c, F.col("num_default" if c in num else "cat_default"))).alias(c)
                   for c in cols])
    inputs = M.stratified_split(m, "admission_id", T, 0.2, SEED).filter(F.col("split") == "test").select(
        "admission_id", *K.READMISSION_INPUTS)
    out = R.overlay_defaults(inputs.select("admission_id", *[F.col(c).cast("double") if c in num else F.col(c)
                                                             for c in K.READMISSION_INPUTS]), wide)
    return out


# -- R3 --------------------------------------------------------------------------
@register("risk_band_scores", O.with_ctes(f"""
SELECT admission_id, {SCORE} AS probability,
  CASE WHEN {SCORE} < 0.3 THEN 'Low Risk' WHEN {SCORE} < 0.6 THEN 'Moderate Risk' WHEN {SCORE} IS NOT NULL THEN 'High Risk' END AS risk_band
FROM master""", "master"))
def _risk_band_scores(spark, sf_dir):
    """Bands of a score that needs no model."""
    return master(spark, sf_dir).select("admission_id", F.col(SCORE).alias("probability"), R.risk_band(SCORE).alias("risk_band"))
