"""Registered quality and profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.operators import profile as PR
from wardline.operators import quality as Q
from wardline.operators.clean import select_dtypes
from wardline.plans import clinical as K
from wardline.plans import oracle as O
from wardline.plans.catalog import cleaned, master, register, tables

TARGET = "readmitted_within_30d"
RAW_KEYS = K.PRIMARY_KEYS
RAW_COLS = {
    "admissions": O.ADM_COLS, "patients": O.PAT_COLS, "lab_results": O.LAB_COLS, "medications": O.MED_COLS,
    "diagnoses": O.DIAG_COLS, "vitals": O.VIT_COLS, "ed_visits": O.ED_COLS, "readmissions": O.READM_COLS,
}
CATEGORICAL = K.EDA_CATEGORICAL
GROUP_MEAN_COLS = K.COMORBIDITY_COLS + ["age", "length_of_stay_days", "charlson_comorbidity_index",
                                        "num_medications", "systolic_bp_mean", "total_charges_usd"]
DESCRIBE_COLS = K.EDA_NUMERIC
VITAL_CORR_COLS = ["systolic_bp", "diastolic_bp", "heart_rate", "respiratory_rate", "temperature_c",
                   "spo2_percent", "gcs_score", "news2_score", "pain_score", "weight_kg", "height_cm"]


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


# -- Q1 ----------------------------------------------------------------------
@register("missing_report", O.with_ctes("""
SELECT feature, n_missing, n_missing / t AS pct_missing
FROM (UNPIVOT (SELECT count(*) - count(COLUMNS(*)) FROM master) ON COLUMNS(*) INTO NAME feature VALUE n_missing),
     (SELECT count(*) AS t FROM master)
WHERE n_missing > 0""", "master"), settle=["pct_missing"])
def _missing_report(spark, sf_dir):
    return Q.missing_report(master(spark, sf_dir))


@register("missing_report_raw", O.with_ctes(_union([
    f"SELECT '{t}' AS role, feature, n_missing, n_missing / t AS pct_missing FROM (UNPIVOT (SELECT "
    + ", ".join(f"count(*) - count({c}) AS {c}" for c in cols) + f" FROM raw_{t}) ON COLUMNS(*) INTO NAME feature VALUE n_missing), "
    f"(SELECT count(*) AS t FROM raw_{t}) WHERE n_missing > 0" for t, cols in RAW_COLS.items()]), *[f"raw_{t}" for t in RAW_COLS]),
    settle=["pct_missing"])
def _missing_report_raw(spark, sf_dir):
    t = tables(spark, sf_dir)
    return Q.stack_tables({r: Q.missing_report(t.role(r).select(*RAW_COLS[r])) for r in RAW_COLS}, "role")


# -- Q2, Q3 ------------------------------------------------------------------
@register("duplicate_keys", O.with_ctes(_union([
    f"SELECT '{t}' AS role, count(*) AS n_rows, "
    f"count(*) - (count(DISTINCT {k}) + max(CASE WHEN {k} IS NULL THEN 1 ELSE 0 END)) AS n_duplicates "
    f"FROM raw_{t}" for t, k in RAW_KEYS.items()]), *[f"raw_{t}" for t in RAW_KEYS]))
def _duplicate_keys(spark, sf_dir):
    t = tables(spark, sf_dir)
    return Q.stack_tables({r: Q.duplicate_keys(t.role(r), k) for r, k in RAW_KEYS.items()}, "role")


@register("duplicate_rows", O.with_ctes(_union([
    f"SELECT '{t}' AS role, CAST(sum(c) AS BIGINT) AS n_rows, CAST(sum(c - 1) AS BIGINT) AS n_duplicate_rows "
    f"FROM (SELECT count(*) AS c FROM raw_{t} GROUP BY {', '.join(cols)})" for t, cols in RAW_COLS.items()]),
    *[f"raw_{t}" for t in RAW_COLS]))
def _duplicate_rows(spark, sf_dir):
    t = tables(spark, sf_dir)
    return Q.stack_tables({r: Q.duplicate_rows(t.role(r).select(*RAW_COLS[r])) for r in RAW_COLS}, "role")


# -- Q4 ----------------------------------------------------------------------
@register("negative_report", O.with_ctes("""
SELECT feature, n_negative FROM (UNPIVOT (
  SELECT CAST(sum(CASE WHEN TRY_CAST(COLUMNS(*) AS DOUBLE) < 0 THEN 1 ELSE 0 END) AS BIGINT) FROM master
) ON COLUMNS(*) INTO NAME feature VALUE n_negative) WHERE n_negative > 0""", "master"))
def _negative_report(spark, sf_dir):
    return Q.negative_report(master(spark, sf_dir))


_RAW_NUMERIC = {"admissions": ["length_of_stay_days", "icu_days", "total_charges_usd", "insurance_paid_usd"],
                "patients": ["social_support_score"], "ed_visits": ["wait_time_minutes", "ed_los_minutes"],
                "readmissions": ["days_to_readmission"]}


@register("negative_report_raw", O.with_ctes(_union([
    f"SELECT '{t}' AS role, '{c}' AS feature, count(*) AS n_negative FROM raw_{t} WHERE {c} < 0 HAVING count(*) > 0"
    for t, cols in _RAW_NUMERIC.items() for c in cols]), *[f"raw_{t}" for t in _RAW_NUMERIC]))
def _negative_report_raw(spark, sf_dir):
    """The raw tables, before clipping, hold the negatives the cleaners remove."""
    t = tables(spark, sf_dir)
    return Q.stack_tables({r: Q.negative_report(t.role(r).select(*cols)) for r, cols in _RAW_NUMERIC.items()}, "role")


# -- Q6 ----------------------------------------------------------------------
# DuckDB type names and the Spark type names they correspond to.
SPARK_TYPE_NAMES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
                    "TIMESTAMP": "timestamp_ntz", "DATE": "date", "BOOLEAN": "boolean"}


def _dtype_sql(table: str, cols: list[str]) -> str:
    def spark_name(c: str) -> str:
        t = f"min(typeof({c}))"
        whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SPARK_TYPE_NAMES.items())
        return f"CASE {t} {whens} ELSE lower({t}) END"

    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS feature, {spark_name(c)} AS dtype, count({c}) AS non_null FROM {table}" for c in cols)


@register("dtype_report", O.with_ctes(_dtype_sql("clean_readmissions", O.READM_COLS), "clean_readmissions"))
def _dtype_report(spark, sf_dir):
    """``df_readmission.info()``: types and non-null counts of the cleaned readmissions."""
    return Q.dtype_report(cleaned(spark, sf_dir, "readmissions"))


@register("dtype_report_all", O.with_ctes(_union([
    f"SELECT '{t}' AS role, * FROM ({_dtype_sql(f'clean_{t}', [c for c in cols if c not in K.PII_COLS])})" for t, cols in RAW_COLS.items()]),
    *[f"clean_{t}" for t in RAW_COLS]))
def _dtype_report_all(spark, sf_dir):
    return Q.stack_tables({t: Q.dtype_report(cleaned(spark, sf_dir, t)) for t in RAW_COLS}, "role")


# -- Q5, F10 -----------------------------------------------------------------
_HR_SQL = """CAST(coalesce(readmitted_within_30d = 1, false) OR coalesce(length_of_stay_days > 7, false)
  OR coalesce(icu_days > 0, false) OR coalesce(total_comorbidities >= 3, false)
  OR coalesce(num_prior_admissions >= 3, false) AS INTEGER)"""


@register("class_balance", O.with_ctes(_union([
    f"SELECT '{t}' AS target, count({t}) AS n, CAST(sum(CASE WHEN {t} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_positive, "
    f"CAST(sum(CASE WHEN {t} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_negative, avg({t}) AS rate "
    f"FROM (SELECT *, {_HR_SQL} AS high_risk FROM master)" for t in (TARGET, "high_risk")]), "master"),
    settle=["rate"])
def _class_balance(spark, sf_dir):
    m = K.high_risk_target(master(spark, sf_dir))
    return Q.class_balance(m, TARGET).unionByName(Q.class_balance(m, "high_risk"))


@register("high_risk_target", O.with_ctes(f"SELECT admission_id, {_HR_SQL} AS high_risk FROM master", "master"))
def _high_risk_target(spark, sf_dir):
    return K.high_risk_target(master(spark, sf_dir)).select("admission_id", "high_risk")


# -- A11 ---------------------------------------------------------------------
@register("value_counts", O.with_ctes(f"""
SELECT drug_class AS value, count(*) AS count,
  {O.rnd('CAST(count(*) AS DOUBLE) * 100.0e0 / (SELECT count(drug_class) FROM clean_medications)', 2)} AS pct
FROM clean_medications WHERE drug_class IS NOT NULL GROUP BY drug_class
ORDER BY count DESC, value LIMIT 15""", "clean_medications"))
def _value_counts(spark, sf_dir):
    return PR.value_counts(cleaned(spark, sf_dir, "medications"), "drug_class", top=15)


# -- A12, A13 ----------------------------------------------------------------
@register("rate_by_category", O.with_ctes(f"""
SELECT feature, category, avg({TARGET}) AS rate, count(*) AS n
FROM (UNPIVOT (SELECT {TARGET}, {', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in CATEGORICAL)} FROM master)
      ON {', '.join(CATEGORICAL)} INTO NAME feature VALUE category)
WHERE category IS NOT NULL GROUP BY feature, category""", "master"), settle=["rate"])
def _rate_by_category(spark, sf_dir):
    return PR.rate_by_category(master(spark, sf_dir), TARGET, CATEGORICAL)


@register("rate_by_count", O.with_ctes(f"""
SELECT total_comorbidities, avg({TARGET}) AS rate, count(*) AS n FROM master
WHERE total_comorbidities IS NOT NULL GROUP BY total_comorbidities""", "master"), settle=["rate"])
def _rate_by_count(spark, sf_dir):
    return PR.rate_by_count(master(spark, sf_dir), TARGET, "total_comorbidities")


# -- A14, A15 ----------------------------------------------------------------
@register("group_means", O.with_ctes(f"""
SELECT feature, {TARGET}, avg(value) AS mean
FROM (SELECT {TARGET}, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in GROUP_MEAN_COLS)} FROM master)
     UNPIVOT INCLUDE NULLS (value FOR feature IN ({', '.join(GROUP_MEAN_COLS)}))
WHERE {TARGET} IS NOT NULL GROUP BY feature, {TARGET}""", "master"), settle=["mean"])
def _group_means(spark, sf_dir):
    return PR.group_means(master(spark, sf_dir), TARGET, GROUP_MEAN_COLS)


@register("prevalence", O.with_ctes(f"""
SELECT feature, prevalence FROM (UNPIVOT (SELECT {', '.join(f'avg({c}) AS {c}' for c in K.COMORBIDITY_COLS)}
  FROM f_patients) ON COLUMNS(*) INTO NAME feature VALUE prevalence)""", "f_patients"), settle=["prevalence"])
def _prevalence(spark, sf_dir):
    return PR.prevalence(K.patient_features(cleaned(spark, sf_dir, "patients")), K.COMORBIDITY_COLS)


# -- A16-A18 -----------------------------------------------------------------
INSURANCE = ["Automobile", "Building", "Furniture", "Household", "Machinery"]


@register("pivot_rate", O.with_ctes(f"""
SELECT age_group, {', '.join(f'avg(CASE WHEN insurance_type = {chr(39)}{v}{chr(39)} THEN {TARGET} END) AS {v}' for v in INSURANCE)}
FROM master WHERE age_group IS NOT NULL AND insurance_type IS NOT NULL GROUP BY age_group""", "master"),
    settle=INSURANCE)
def _pivot_rate(spark, sf_dir):
    """Readmission rate by age group × insurance (the flagship slice: scan,
    dedup, clip, binning, rollups, left joins and a pivot)."""
    return PR.pivot_mean(master(spark, sf_dir), "age_group", "insurance_type", TARGET, INSURANCE)


def _med_label(spark, sf_dir):
    meds = cleaned(spark, sf_dir, "medications")
    adm = cleaned(spark, sf_dir, "admissions").select("admission_id", TARGET)
    return meds.join(adm, "admission_id", "left")


@register("pivot_count_top", O.with_ctes(f"""
SELECT drug_class, not_readmitted, readmitted, not_readmitted + readmitted AS total FROM (
  SELECT drug_class, CAST(sum(CASE WHEN {TARGET} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS not_readmitted,
         CAST(sum(CASE WHEN {TARGET} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS readmitted
  FROM clean_medications m LEFT JOIN clean_admissions a USING (admission_id)
  WHERE drug_class IS NOT NULL AND {TARGET} IS NOT NULL GROUP BY drug_class)
ORDER BY total DESC, drug_class LIMIT 15""", "clean_medications", "clean_admissions"))
def _pivot_count_top(spark, sf_dir):
    df = _med_label(spark, sf_dir).filter(F.col(TARGET).isNotNull())
    return PR.pivot_count_top(df, "drug_class", TARGET, [0, 1], ["not_readmitted", "readmitted"], 15)


@register("crosstab", O.with_ctes("""
SELECT planned_readmission, CAST(sum(CASE WHEN same_diagnosis = 0 THEN 1 ELSE 0 END) AS BIGINT) AS same_dx_0,
       CAST(sum(CASE WHEN same_diagnosis = 1 THEN 1 ELSE 0 END) AS BIGINT) AS same_dx_1
FROM clean_readmissions WHERE planned_readmission IS NOT NULL AND same_diagnosis IS NOT NULL
GROUP BY planned_readmission""", "clean_readmissions"))
def _crosstab(spark, sf_dir):
    return PR.crosstab(cleaned(spark, sf_dir, "readmissions"), "planned_readmission", "same_diagnosis",
                       [0, 1], ["same_dx_0", "same_dx_1"])


# -- A19 ---------------------------------------------------------------------
@register("freq_of_freq", O.with_ctes(_union([
    f"SELECT '{m}' AS measure, per_key, count(*) AS n_keys FROM "
    f"(SELECT patient_id, count(*) AS per_key FROM {t} WHERE patient_id IS NOT NULL GROUP BY patient_id) GROUP BY per_key"
    for m, t in (("ed_visits", "clean_ed_visits"), ("readmissions", "clean_readmissions"))]),
    "clean_ed_visits", "clean_readmissions"))
def _freq_of_freq(spark, sf_dir):
    parts = {m: PR.freq_of_freq(cleaned(spark, sf_dir, m), "patient_id") for m in ("ed_visits", "readmissions")}
    return Q.stack_tables(parts, "measure")


# -- A20 ---------------------------------------------------------------------
@register("describe", O.with_ctes(f"""
SELECT feature, count(value) AS count, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min,
  max(value) AS max, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50,
  quantile_cont(value, 0.75) AS p75
FROM (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in DESCRIBE_COLS)} FROM master)
     UNPIVOT INCLUDE NULLS (value FOR feature IN ({', '.join(DESCRIBE_COLS)}))
GROUP BY feature""", "master"), settle=["mean", "std", "p25", "p50", "p75"])
def _describe(spark, sf_dir):
    return PR.describe(master(spark, sf_dir), DESCRIBE_COLS)


@register("describe_categorical", O.with_ctes(f"""
SELECT feature, CAST(sum(c) AS BIGINT) AS count, count(*) AS unique, arg_min(value, (-c, value)) AS top,
  max(c) AS freq
FROM (SELECT feature, value, count(*) AS c FROM
  (UNPIVOT (SELECT {', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in CATEGORICAL)} FROM master)
   ON COLUMNS(*) INTO NAME feature VALUE value) GROUP BY feature, value)
GROUP BY feature""", "master"))
def _describe_categorical(spark, sf_dir):
    return PR.describe_categorical(master(spark, sf_dir), CATEGORICAL)


# -- A21 ---------------------------------------------------------------------
def _hist_sql(src: str, col: str, bins: int) -> str:
    return f"""
SELECT CAST(g.bin AS INTEGER) AS bin, r.lo + g.bin * ((r.hi - r.lo) / {bins}) AS lo,
  r.lo + (g.bin + 1) * ((r.hi - r.lo) / {bins}) AS hi, coalesce(b.c, 0) AS count
FROM (SELECT CAST(min({col}) AS DOUBLE) AS lo, CAST(max({col}) AS DOUBLE) AS hi FROM {src} WHERE {col} IS NOT NULL) r
CROSS JOIN range({bins}) g(bin)
LEFT JOIN (
  SELECT CAST(CASE WHEN r2.hi = r2.lo THEN 0
              ELSE least(floor(({col} - r2.lo) * ({bins}.0e0 / (r2.hi - r2.lo))), {bins - 1}) END AS INTEGER) AS bin,
         count(*) AS c
  FROM {src}, (SELECT CAST(min({col}) AS DOUBLE) AS lo, CAST(max({col}) AS DOUBLE) AS hi FROM {src}) r2
  WHERE {col} IS NOT NULL GROUP BY 1) b ON b.bin = g.bin"""


@register("histogram", O.with_ctes(_hist_sql("master", "age", 40), "master"))
def _histogram(spark, sf_dir):
    return PR.histogram(master(spark, sf_dir), "age", 40)


@register("histograms", O.with_ctes(_union([
    f"SELECT '{c}' AS feature, * FROM ({_hist_sql('master', c, 40)})" for c in K.EDA_NUMERIC]), "master"), settle=["lo", "hi"])
def _histograms(spark, sf_dir):
    """Every profiled feature in one pass."""
    return PR.histogram(PR.long_values(master(spark, sf_dir), K.EDA_NUMERIC), "value", 40, by="feature")


# -- A22 ---------------------------------------------------------------------
def _box_sql(src: str, col: str, by: str) -> str:
    return f"""
SELECT q.{by}, q.q1, q.median, q.q3, q.q3 - q.q1 AS iqr,
  CAST(min(CASE WHEN v BETWEEN lf AND uf THEN v END) AS DOUBLE) AS lower_whisker,
  CAST(max(CASE WHEN v BETWEEN lf AND uf THEN v END) AS DOUBLE) AS upper_whisker,
  CAST(sum(CASE WHEN v BETWEEN lf AND uf THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers, count(*) AS n
FROM (SELECT {by}, quantile_cont({col}, 0.25) AS q1, quantile_cont({col}, 0.5) AS median,
             quantile_cont({col}, 0.75) AS q3
      FROM {src} WHERE {col} IS NOT NULL AND {by} IS NOT NULL GROUP BY {by}) q
JOIN (SELECT {by}, {col} AS v FROM {src} WHERE {col} IS NOT NULL) d ON d.{by} = q.{by},
LATERAL (SELECT q.q1 - 1.5 * (q.q3 - q.q1) AS lf, q.q3 + 1.5 * (q.q3 - q.q1) AS uf)
GROUP BY q.{by}, q.q1, q.median, q.q3"""


@register("box_stats", O.with_ctes(_box_sql("master", "length_of_stay_days", TARGET), "master"),
          settle=["q1", "median", "q3", "iqr"])
def _box_stats(spark, sf_dir):
    return PR.box_stats(master(spark, sf_dir), "length_of_stay_days", TARGET)


@register("box_stats_all", O.with_ctes(_union([
    f"SELECT '{c}' AS feature, * FROM ({_box_sql('master', c, TARGET)})" for c in K.EDA_NUMERIC]), "master"),
    settle=["q1", "median", "q3", "iqr", "lower_whisker", "upper_whisker"])
def _box_stats_all(spark, sf_dir):
    long = PR.long_values(master(spark, sf_dir), K.EDA_NUMERIC, [TARGET])
    return PR.box_stats(long, "value", ["feature", TARGET])


# -- A23, A24 ----------------------------------------------------------------
def _pair_sql(a: str, b: str) -> str:
    both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
    xa = f"CASE WHEN {both} THEN CAST({a} AS DOUBLE) END"
    xb = f"CASE WHEN {both} THEN CAST({b} AS DOUBLE) END"
    return f"covar_samp({xa}, {xb}) / NULLIF(stddev_samp({xa}) * stddev_samp({xb}), 0)"


def _corr_matrix_sql(src: str, cols: list[str]) -> str:
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    one = ", ".join([f"{_pair_sql(a, b)} AS {a}__{b}" for a, b in pairs] +
                    [f"stddev_samp(CAST({c} AS DOUBLE)) AS sd__{c}" for c in cols])
    rows = [f"SELECT '{a}' AS x, '{b}' AS y, {a}__{b} AS corr FROM cm" for a, b in pairs]
    rows += [f"SELECT '{b}' AS x, '{a}' AS y, {a}__{b} AS corr FROM cm" for a, b in pairs]
    rows += [f"SELECT '{c}' AS x, '{c}' AS y, CASE WHEN sd__{c} > 0 THEN 1.0e0 END AS corr FROM cm" for c in cols]
    return f"WITH cm AS (SELECT {one} FROM {src})\n" + _union(rows)


@register("corr_matrix", O.with_ctes(f"SELECT * FROM ({_corr_matrix_sql('clean_vitals', VITAL_CORR_COLS)})",
                                     "clean_vitals"), settle=["corr"])
def _corr_matrix(spark, sf_dir):
    return PR.corr_matrix(cleaned(spark, sf_dir, "vitals"), VITAL_CORR_COLS)


_CT_X = f"TRY_CAST(COLUMNS(* EXCLUDE ({TARGET})) AS DOUBLE)"
_CT_CORR = (
    f"covar_samp(CASE WHEN {_CT_X} IS NOT NULL THEN {_CT_X} END, CASE WHEN {_CT_X} IS NOT NULL THEN CAST({TARGET} AS DOUBLE) END)"
    f" / NULLIF(stddev_samp(CASE WHEN {_CT_X} IS NOT NULL THEN {_CT_X} END) * "
    f"stddev_samp(CASE WHEN {_CT_X} IS NOT NULL THEN CAST({TARGET} AS DOUBLE) END), 0)"
)


@register("corr_top", O.with_ctes(f"""
SELECT feature, corr FROM (UNPIVOT (SELECT {_CT_CORR} FROM master) ON COLUMNS(*) INTO NAME feature VALUE corr)
WHERE corr IS NOT NULL AND NOT isnan(corr)
ORDER BY round_even(abs(corr) * 1e9, 0) DESC, feature LIMIT 25""", "master"), settle=["corr"])
def _corr_top(spark, sf_dir):
    m = master(spark, sf_dir)
    cols = [c for c in select_dtypes(m, "numeric") if c != TARGET]
    return PR.corr_top(m, TARGET, cols, 25)


# -- A25 ---------------------------------------------------------------------
@register("scatter_bins", O.with_ctes(f"""
SELECT {TARGET}, CAST(CASE WHEN x1 = x0 THEN 0 ELSE least(floor((length_of_stay_days - x0) * (20.0e0 / (x1 - x0))), 19) END AS INTEGER) AS x_bin,
  CAST(CASE WHEN y1 = y0 THEN 0 ELSE least(floor((total_charges_usd - y0) * (20.0e0 / (y1 - y0))), 19) END AS INTEGER) AS y_bin,
  count(*) AS count
FROM master, (SELECT CAST(min(length_of_stay_days) AS DOUBLE) AS x0, CAST(max(length_of_stay_days) AS DOUBLE) AS x1,
                     CAST(min(total_charges_usd) AS DOUBLE) AS y0, CAST(max(total_charges_usd) AS DOUBLE) AS y1
              FROM master WHERE length_of_stay_days IS NOT NULL AND total_charges_usd IS NOT NULL)
WHERE length_of_stay_days IS NOT NULL AND total_charges_usd IS NOT NULL GROUP BY 1, 2, 3""", "master"))
def _scatter_bins(spark, sf_dir):
    return PR.scatter_bins(master(spark, sf_dir), "length_of_stay_days", "total_charges_usd", 20, TARGET)


# -- J4 ----------------------------------------------------------------------
@register("meds_by_label", O.with_ctes(f"""
SELECT m.admission_id, m.num_medications, m.num_high_alert, a.{TARGET}
FROM (SELECT admission_id, count(medication_id) AS num_medications,
             CAST(coalesce(sum(is_high_alert), 0) AS BIGINT) AS num_high_alert
      FROM clean_medications WHERE admission_id IS NOT NULL GROUP BY admission_id) m
LEFT JOIN clean_admissions a ON m.admission_id = a.admission_id""", "clean_medications", "clean_admissions"))
def _meds_by_label(spark, sf_dir):
    from wardline.operators.joins import merge
    from wardline.operators.rollup import rollup

    meds = rollup(cleaned(spark, sf_dir, "medications"), "admission_id", {
        "num_medications": F.count("medication_id"),
        "num_high_alert": F.coalesce(F.sum("is_high_alert"), F.lit(0)),
    })
    adm = cleaned(spark, sf_dir, "admissions").select("admission_id", TARGET)
    return merge(meds, adm, "admission_id", "left")


_VITAL_MEANS = ", ".join(f"avg({c}) AS {c}" for c in K.NUMERIC_VITALS)


@register("vitals_by_label", O.with_ctes(f"""
SELECT a.{TARGET}, count(*) AS n, {_VITAL_MEANS}
FROM (SELECT admission_id, {_VITAL_MEANS} FROM clean_vitals WHERE admission_id IS NOT NULL GROUP BY admission_id) v
JOIN clean_admissions a ON v.admission_id = a.admission_id WHERE a.{TARGET} IS NOT NULL GROUP BY a.{TARGET}""",
    "clean_vitals", "clean_admissions"), settle=K.NUMERIC_VITALS)
def _vitals_by_label(spark, sf_dir):
    """Mean vitals per admission, the label joined, then means by label."""
    from wardline.operators.joins import merge
    from wardline.operators.rollup import rollup

    means = rollup(cleaned(spark, sf_dir, "vitals"), "admission_id", {c: F.avg(c) for c in K.NUMERIC_VITALS})
    adm = cleaned(spark, sf_dir, "admissions").select("admission_id", TARGET)
    joined = merge(means, adm, "admission_id", "inner")
    return rollup(joined, TARGET, {"n": F.count(F.lit(1)), **{c: F.avg(c) for c in K.NUMERIC_VITALS}})


@register("stay_by_medications", O.with_ctes("""
SELECT num_medications, avg(length_of_stay_days) AS mean_stay, count(length_of_stay_days) AS n FROM master
WHERE num_medications IS NOT NULL GROUP BY num_medications""", "master"), settle=["mean_stay"])
def _stay_by_medications(spark, sf_dir):
    from wardline.operators.rollup import rollup

    return rollup(master(spark, sf_dir), "num_medications", {
        "mean_stay": F.avg("length_of_stay_days"), "n": F.count("length_of_stay_days")})


# -- A25, P15, P16, P17 --------------------------------------------------------
LABEL_NAMES = {0: "Not Readmitted", 1: "Readmitted"}  # fixed values


@register("pair_sample", O.with_ctes(f"""
SELECT admission_id, {', '.join(K.EDA_PAIRS)}, CASE {TARGET} WHEN 0 THEN 'Not Readmitted' WHEN 1 THEN 'Readmitted' END AS label
FROM master WHERE {' AND '.join(f'{c} IS NOT NULL' for c in [*K.EDA_PAIRS, TARGET])}
ORDER BY md5('42:' || CAST(admission_id AS VARCHAR)), admission_id LIMIT 3000""", "master"), settle=["news2_score_mean"])
def _pair_sample(spark, sf_dir):
    """Complete cases of the pair plot's features, a seeded sample of 3,000."""
    from wardline.operators import clean as C

    whole = C.complete_cases(master(spark, sf_dir).select("admission_id", *K.EDA_PAIRS, TARGET), [*K.EDA_PAIRS, TARGET])
    some = C.seeded_sample(whole, 3000, "admission_id", 42)
    return C.map_codes(some, TARGET, LABEL_NAMES, out="label").drop(TARGET)


def _scatter(name: str, x: str, y: str, by: str):
    x_bin, y_bin = (f"CAST(CASE WHEN {v}1 = {v}0 THEN 0 ELSE least(floor(({c} - {v}0) * (20.0e0 / ({v}1 - {v}0))), 19) END AS INTEGER) AS {v}_bin"
                    for v, c in (("x", x), ("y", y)))
    sql = f"""
SELECT {by}, {x_bin}, {y_bin}, count(*) AS count
FROM master, (SELECT CAST(min({x}) AS DOUBLE) AS x0, CAST(max({x}) AS DOUBLE) AS x1, CAST(min({y}) AS DOUBLE) AS y0,
                     CAST(max({y}) AS DOUBLE) AS y1 FROM master WHERE {x} IS NOT NULL AND {y} IS NOT NULL)
WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY 1, 2, 3"""
    register(name, O.with_ctes(sql, "master"))(lambda spark, sf_dir: PR.scatter_bins(master(spark, sf_dir), x, y, 20, by))


_scatter("scatter_age_charlson", "age", "charlson_comorbidity_index", "gender")
_scatter("scatter_stay_medications", "length_of_stay_days", "num_medications", TARGET)
_scatter("scatter_stay_charges_icu", "length_of_stay_days", "total_charges_usd", "had_icu_stay")
_scatter("scatter_pressure_news", "systolic_bp_mean", "news2_score_mean", TARGET)


# -- A25: the pair plot's diagonal -------------------------------------------------
def _density_sql(cols: list[str]) -> str:
    long = _union([f"SELECT '{c}' AS feature, {TARGET}, CAST({c} AS DOUBLE) AS v FROM master WHERE {c} IS NOT NULL AND {TARGET} IS NOT NULL" for c in cols])
    return f"""
WITH long AS ({long}),
st AS (SELECT feature, {TARGET}, n, h, lo - 3 * h AS x0, (hi - lo + 6 * h) / 199 AS step FROM (
  SELECT feature, {TARGET}, count(*) AS n, stddev_samp(v) * pow(count(*), -0.2e0) AS h, min(v) AS lo, max(v) AS hi
  FROM long GROUP BY ALL HAVING stddev_samp(v) > 0)),
near AS (SELECT feature, {TARGET}, least(floor((v - x0) / step), 198) AS k, (v - x0) / step AS pos FROM long JOIN st USING (feature, {TARGET})),
w AS (SELECT feature, {TARGET}, k, sum(w) AS w FROM (
  SELECT feature, {TARGET}, k, 1 - (pos - k) AS w FROM near UNION ALL SELECT feature, {TARGET}, k + 1, pos - k FROM near) GROUP BY ALL)
SELECT feature, {TARGET}, x0 + g * step AS x, sum(w * exp(-pow((g - k) * step / h, 2) / 2)) / (n * h * sqrt(2 * pi())) AS density
FROM w JOIN st USING (feature, {TARGET}), range(200) r(g) GROUP BY feature, {TARGET}, g, x0, step, n, h"""


@register("pair_density", O.with_ctes(f"SELECT * FROM ({_density_sql(K.EDA_PAIRS)})", "master"), settle=["x", "density"])
def _pair_density(spark, sf_dir):
    """Density curves of the pair plot's features, by label, over all rows."""
    return PR.density_curves(master(spark, sf_dir), K.EDA_PAIRS, TARGET)
