"""Registered scan and cleaning-scalar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.operators import clean as C
from wardline.operators import profile as PR
from wardline.operators import quality as Q
from wardline.plans import clinical as K
from wardline.plans import oracle as O
from wardline.plans.catalog import cleaned, master, register, tables
from wardline.plans.reports import RAW_COLS

_TOKENS = ", ".join("'" + t.replace("'", "''") + "'" for t in C.PANDAS_NULL_TOKENS)


# -- S1, S4 --------------------------------------------------------------------
@register("scan_profile", O.with_ctes("\nUNION ALL\n".join(
    f"SELECT '{t}' AS role, count(*) AS n_rows, {len(cols)} AS n_columns, '{','.join(cols)}' AS columns FROM raw_{t}"
    for t, cols in RAW_COLS.items()), *[f"raw_{t}" for t in RAW_COLS]))
def _scan_profile(spark, sf_dir):
    t = tables(spark, sf_dir)
    parts = {}
    for r in RAW_COLS:
        df = C.drop_columns(t.role(r), [K.POS])
        parts[r] = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            "n_rows", F.lit(len(df.columns)).alias("n_columns"), F.lit(",".join(df.columns)).alias("columns"))
    return Q.stack_tables(parts, "role")


# -- S2 ------------------------------------------------------------------------
_PAT_TEXT = ["first_name", "mrn", "gender", "ethnicity", "insurance_type", "smoking_status", "alcohol_use",
             "language_preference"]


@register("null_tokens", O.with_ctes(
    "SELECT * REPLACE (" + ", ".join(f"CASE WHEN {c} IN ({_TOKENS}) THEN NULL ELSE {c} END AS {c}" for c in _PAT_TEXT)
    + ") FROM raw_patients", "raw_patients"))
def _null_tokens(spark, sf_dir):
    return C.normalise_null_tokens(tables(spark, sf_dir).patients())


# -- P1 ------------------------------------------------------------------------
@register("coerce_datetime", O.with_ctes("""
SELECT admission_id, TRY_CAST(CASE WHEN admission_id % 13 = 0 THEN 'not a date' ELSE strftime(admission_date, '%Y-%m-%d %H:%M:%S') END
  AS TIMESTAMP) AS admission_date FROM raw_admissions""", "raw_admissions"))
def _coerce_datetime(spark, sf_dir):
    a = tables(spark, sf_dir).admissions()
    text = F.when(F.col("admission_id") % 13 == 0, F.lit("not a date")).otherwise(
        F.date_format("admission_date", "yyyy-MM-dd HH:mm:ss"))
    return C.coerce_datetimes(a.select("admission_id", text.alias("admission_date")), ["admission_date", "absent"])


# -- P2, P3 --------------------------------------------------------------------
@register("clip_bounds", O.with_ctes(f"""
SELECT a.admission_id, {O.clip('a.length_of_stay_days', 0)} AS length_of_stay_days, {O.clip('a.icu_days', 0)} AS icu_days,
  {O.clip('a.insurance_paid_usd', 0)} AS insurance_paid_usd,
  {O.clip('p.social_support_score', 0, 10)} AS social_support_score
FROM raw_admissions a LEFT JOIN raw_patients p ON a.patient_id = p.patient_id""", "raw_admissions", "raw_patients"))
def _clip_bounds(spark, sf_dir):
    t = tables(spark, sf_dir)
    a = C.clip_columns(t.admissions(), {c: (0, None) for c in ["length_of_stay_days", "icu_days", "insurance_paid_usd"]})
    p = C.clip_columns(t.patients(), {"social_support_score": (0, 10)})
    return a.join(p.select("patient_id", "social_support_score"), "patient_id", "left").select(
        "admission_id", "length_of_stay_days", "icu_days", "insurance_paid_usd", "social_support_score")


# -- P4 ------------------------------------------------------------------------
@register("range_to_null", O.with_ctes("SELECT " + ", ".join(
    ["vital_id"] + [O._vital_null(c, lo, hi) for c, (lo, hi) in K.VITAL_RANGES.items()]) + " FROM raw_vitals", "raw_vitals"))
def _range_to_null(spark, sf_dir):
    v = tables(spark, sf_dir).vitals().select("vital_id", *K.VITAL_RANGES)
    return C.range_to_null(v, K.VITAL_RANGES)


# -- P5 ------------------------------------------------------------------------
@register("drop_columns", O.with_ctes("SELECT * EXCLUDE (first_name, mrn) FROM raw_patients", "raw_patients"))
def _drop_columns(spark, sf_dir):
    return C.drop_columns(tables(spark, sf_dir).patients(), K.PII_COLS)


# -- P8, P9 --------------------------------------------------------------------
@register("fill_cast", O.with_ctes("""
SELECT r.readmission_id, CAST(coalesce(r.planned_readmission, 0) AS INTEGER) AS planned_readmission,
  CAST(coalesce(r.same_diagnosis, 0) AS INTEGER) AS same_diagnosis,
  coalesce(p.alcohol_use, 'Unknown') AS alcohol_use, coalesce(p.smoking_status, 'Unknown') AS smoking_status
FROM raw_readmissions r LEFT JOIN raw_patients p ON r.patient_id = p.patient_id""", "raw_readmissions", "raw_patients"))
def _fill_cast(spark, sf_dir):
    t = tables(spark, sf_dir)
    r = C.fill_cast_int(t.readmissions(), ["planned_readmission", "same_diagnosis"])
    p = C.fill_constant(t.patients(), {"alcohol_use": "Unknown", "smoking_status": "Unknown"})
    return r.join(p.select("patient_id", "alcohol_use", "smoking_status"), "patient_id", "left").select(
        "readmission_id", "planned_readmission", "same_diagnosis", "alcohol_use", "smoking_status")


# -- P10, P11 ------------------------------------------------------------------
@register("title_case", O.with_ctes(f"""
SELECT patient_id, {O.title('gender')} AS gender, {O.title('smoking_status')} AS smoking_status,
  {O.title('insurance_type')} AS insurance_type FROM raw_patients""", "raw_patients"))
def _title_case(spark, sf_dir):
    return C.title_columns(tables(spark, sf_dir).patients(), ["gender", "smoking_status", "insurance_type"]).select(
        "patient_id", "gender", "smoking_status", "insurance_type")


@register("upper_trim", O.with_ctes(f"""
SELECT lab_id, upper({O.strip('flag')}) AS flag, {O.LINE_ORDER} FROM raw_lab_results""", "raw_lab_results"))
def _upper_trim(spark, sf_dir):
    lab = C.upper_columns(tables(spark, sf_dir).lab_results(), ["flag"])
    return lab.select("lab_id", "flag", "_pos.*")


# -- P12 -----------------------------------------------------------------------
@register("dedup_first", O.with_ctes("SELECT * FROM dd_lab_results", "dd_lab_results"))
def _dedup_first(spark, sf_dir):
    lab = tables(spark, sf_dir).lab_results()
    return C.drop_columns(C.dedup_first(lab, "lab_id", ["_pos"]), ["_pos"])


# -- P14 + A12 ----------------------------------------------------------------
@register("high_alert_rate_top", O.with_ctes("""
SELECT drug_class, avg(is_high_alert) AS rate, count(*) AS n FROM clean_medications
WHERE drug_class IN (SELECT drug_class FROM clean_medications WHERE drug_class IS NOT NULL
                     GROUP BY drug_class ORDER BY count(*) DESC, drug_class LIMIT 15)
GROUP BY drug_class""", "clean_medications"), settle=["rate"])
def _high_alert_rate_top(spark, sf_dir):
    meds = C.keep_top_categories(cleaned(spark, sf_dir, "medications"), "drug_class", 15)
    return PR.rate_by_count(meds, "is_high_alert", "drug_class")


# -- P16 -----------------------------------------------------------------------
@register("seeded_sample", O.with_ctes(f"""
SELECT admission_id, length_of_stay_days, total_charges_usd, readmitted_within_30d FROM master
ORDER BY md5('42:' || CAST(admission_id AS VARCHAR)), admission_id LIMIT 500""", "master"))
def _seeded_sample(spark, sf_dir):
    m = master(spark, sf_dir).select("admission_id", "length_of_stay_days", "total_charges_usd", K.TARGET)
    return C.seeded_sample(m, 500, "admission_id", 42)
