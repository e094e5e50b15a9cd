"""Clinical recipes: table cleaners, feature tables and the master dataset.

Thin configurations over the generic operators.  Everything is lazy; the
first action is whatever the caller does with the result (usually a Parquet
write of the master, see ``wardline.sources.tables.write_master``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import exprs as X
from wardline.operators import clean as C
from wardline.operators.joins import merge
from wardline.operators.rollup import first_complete, rollup, stat_exprs

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for equal results.
# ---------------------------------------------------------------------------
DATETIME_COLS = {
    "admissions": ["admission_date", "discharge_date", "original_discharge_date"],
    "patients": ["date_of_birth", "registered_date"],
    "ed_visits": ["arrival_datetime", "departure_datetime"],
    "lab_results": ["drawn_at"],
    "medications": ["start_datetime", "end_datetime"],
    "vitals": ["measured_at"],
    "readmissions": ["original_discharge_date", "readmission_date"],
}
COMORBIDITY_COLS = [
    "has_diabetes", "has_hypertension", "has_heart_disease", "has_copd",
    "has_ckd", "has_depression", "has_obesity", "has_cancer",
]
EDA_NUMERIC = [
    "length_of_stay_days", "total_charges_usd", "icu_days",
    "age", "charlson_comorbidity_index", "total_comorbidities",
    "num_medications", "num_lab_tests", "num_diagnoses",
    "num_vital_readings", "systolic_bp_mean", "heart_rate_mean",
    "spo2_percent_mean", "news2_score_mean", "num_ed_visits",
    "cost_per_day", "out_of_pocket_cost",
]
EDA_CATEGORICAL = [
    "admission_type", "admission_source", "discharge_disposition",
    "insurance_type", "gender", "ethnicity",
    "smoking_status", "alcohol_use", "age_group",
]
EDA_PAIRS = [
    "length_of_stay_days", "num_diagnoses", "num_medications",
    "charlson_comorbidity_index", "news2_score_mean",
]
TITLE_COLS = {
    "admissions": ["admission_type", "admission_source", "discharge_disposition"],
    "patients": ["gender", "ethnicity", "insurance_type", "smoking_status", "alcohol_use", "language_preference"],
    "ed_visits": ["triage_category"],
    "medications": ["drug_class"],
}
LOWER_ZERO = {
    "admissions": ["length_of_stay_days", "total_charges_usd", "insurance_paid_usd", "icu_days"],
    "ed_visits": ["wait_time_minutes", "door_to_doctor_min", "ed_los_minutes"],
}
PII_COLS = ["first_name", "last_name", "mrn"]
VITAL_RANGES = {
    "systolic_bp": (50, 300),
    "diastolic_bp": (20, 200),
    "heart_rate": (20, 300),
    "spo2_percent": (50, None),
    "temperature_c": (30, 45),
    "weight_kg": (20, None),
    "height_cm": (100, None),
}
NUMERIC_VITALS = [
    "systolic_bp", "diastolic_bp", "heart_rate", "respiratory_rate",
    "temperature_c", "spo2_percent", "gcs_score", "news2_score", "pain_score",
]
AGE_EDGES = [0, 17, 34, 49, 64, 79, 120]
AGE_LABELS = ["0-17", "18-34", "35-49", "50-64", "65-79", "80+"]
PRIMARY_KEYS = {
    "admissions": "admission_id",
    "patients": "patient_id",
    "diagnoses": "diagnosis_id",
    "ed_visits": "ed_visit_id",
    "lab_results": "lab_id",
    "medications": "medication_id",
    "vitals": "vital_id",
    "readmissions": "readmission_id",
}
# ---------------------------------------------------------------------------

POS = "_pos"  # optional struct column standing for file order


def _dedup(df: DataFrame, table: str) -> DataFrame:
    order = [POS] if POS in df.columns else []
    return C.drop_columns(C.dedup_first(df, PRIMARY_KEYS[table], order), [POS])


# -- P18: table cleaners ---------------------------------------------------
def clean_admissions(df: DataFrame) -> DataFrame:
    df = _dedup(df, "admissions")
    df = C.coerce_datetimes(df, DATETIME_COLS["admissions"])
    df = C.clip_columns(df, {c: (0, None) for c in LOWER_ZERO["admissions"]})
    df = C.fill_cast_int(df, ["readmitted_within_30d"])
    return C.title_columns(df, TITLE_COLS["admissions"])


def clean_patients(df: DataFrame) -> DataFrame:
    df = _dedup(df, "patients")
    df = C.coerce_datetimes(df, DATETIME_COLS["patients"])
    df = C.drop_columns(df, PII_COLS)
    df = C.title_columns(df, TITLE_COLS["patients"])
    df = C.fill_constant(df, {"alcohol_use": "Unknown", "smoking_status": "Unknown"})
    return C.clip_columns(df, {"social_support_score": (0, 10)})


def clean_diagnoses(df: DataFrame) -> DataFrame:
    df = _dedup(df, "diagnoses")
    df = C.upper_columns(df, ["poa_flag"])
    return C.clip_columns(df, {"diagnosis_rank": (1, None)})


def clean_ed_visits(df: DataFrame) -> DataFrame:
    df = _dedup(df, "ed_visits")
    df = C.coerce_datetimes(df, DATETIME_COLS["ed_visits"])
    df = C.clip_columns(df, {c: (0, None) for c in LOWER_ZERO["ed_visits"]})
    return C.title_columns(df, TITLE_COLS["ed_visits"])


def clean_lab_results(df: DataFrame) -> DataFrame:
    df = _dedup(df, "lab_results")
    df = C.coerce_datetimes(df, DATETIME_COLS["lab_results"])
    df = C.upper_columns(df, ["flag"])
    return C.fill_constant(df, {"flag": "N"})


def clean_medications(df: DataFrame) -> DataFrame:
    df = _dedup(df, "medications")
    df = C.coerce_datetimes(df, DATETIME_COLS["medications"])
    df = C.fill_cast_int(df, ["is_high_alert"])
    return C.title_columns(df, TITLE_COLS["medications"])


def clean_vitals(df: DataFrame) -> DataFrame:
    df = _dedup(df, "vitals")
    df = C.coerce_datetimes(df, DATETIME_COLS["vitals"])
    return C.range_to_null(df, VITAL_RANGES)


def clean_readmissions(df: DataFrame) -> DataFrame:
    # The reference configures datetime columns for this table but never
    # parses them here; kept as is.
    df = _dedup(df, "readmissions")
    df = C.clip_columns(df, {"days_to_readmission": (0, None)})
    return C.fill_cast_int(df, ["planned_readmission", "same_diagnosis"])


CLEANERS = {
    "admissions": clean_admissions,
    "patients": clean_patients,
    "diagnoses": clean_diagnoses,
    "ed_visits": clean_ed_visits,
    "lab_results": clean_lab_results,
    "medications": clean_medications,
    "vitals": clean_vitals,
    "readmissions": clean_readmissions,
}


def clean_all(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {name: CLEANERS[name](df) for name, df in raw.items() if name in CLEANERS}


# -- F1-F5: admission features ---------------------------------------------
def admission_features(df: DataFrame) -> DataFrame:
    dow = X.weekday("admission_date")
    return df.withColumns({
        "admission_year": F.year("admission_date"),
        "admission_month": F.month("admission_date"),
        "admission_dayofweek": dow,
        "is_weekend_admission": X.flag(dow.isin(5, 6)),
        "cost_per_day": X.np_round(X.safe_div("total_charges_usd", "length_of_stay_days"), 2),
        "out_of_pocket_cost": X.clip(F.col("total_charges_usd") - F.col("insurance_paid_usd"), 0),
        "insurance_coverage_ratio": X.np_round(X.safe_div("insurance_paid_usd", "total_charges_usd"), 4),
        "icu_ratio": X.np_round(X.safe_div("icu_days", "length_of_stay_days"), 4),
        "had_icu_stay": X.flag(F.col("icu_days") > 0),
    })


# -- F6-F8: patient features -----------------------------------------------
def patient_features(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "age_group": X.cut_right("age", AGE_EDGES, AGE_LABELS),
        "total_comorbidities": X.row_sum([c for c in COMORBIDITY_COLS if c in df.columns]),
        "is_high_comorbidity": X.flag(F.col("charlson_comorbidity_index") >= 3),
        "is_high_utiliser": X.any_true(F.col("num_prior_admissions") >= 3, F.col("num_prior_ed_visits") >= 5),
        "low_social_support": X.flag(F.col("social_support_score") <= 3),
    })


# -- A1-A3, F9, J3: vitals rollup ------------------------------------------
def vitals_features(df: DataFrame) -> DataFrame:
    """One aggregate pass: stats, reading count and the first complete
    weight/height (ordered by ``measured_at, vital_id``) for BMI."""
    return rollup(df, "admission_id", _vital_aggs("vital_id")).withColumn("bmi", _bmi()).drop("__wh")


def _vital_aggs(key: str) -> list[Column]:
    wh = first_complete(["weight_kg", "height_cm"], ["measured_at", key]).alias("__wh")
    return [*stat_exprs(NUMERIC_VITALS), F.count(key).alias("num_vital_readings"), wh]


def _bmi() -> Column:
    return X.np_round(F.col("__wh.weight_kg") / F.pow(F.col("__wh.height_cm") / 100, 2), 1)


# -- A4 ----------------------------------------------------------------------
def lab_features(df: DataFrame) -> DataFrame:
    return rollup(df, "admission_id", _lab_aggs("lab_id")).withColumn("pct_abnormal_labs", _pct_abnormal())


def _lab_aggs(key: str) -> list[Column]:
    abnormal = F.coalesce(F.col("flag") != "N", F.lit(True)).cast("int")
    return [F.count(key).alias("num_lab_tests"), F.coalesce(F.sum(abnormal), F.lit(0)).alias("num_abnormal_labs")]


def _pct_abnormal() -> Column:
    return X.np_round(X.safe_div("num_abnormal_labs", "num_lab_tests"), 4)


# -- A5 ----------------------------------------------------------------------
def medication_features(df: DataFrame) -> DataFrame:
    return rollup(df, "admission_id", _medication_aggs("medication_id")).withColumn("has_high_alert_med", _has_high_alert())


def _medication_aggs(key: str) -> list[Column]:
    return [F.count(key).alias("num_medications"), F.coalesce(F.sum("is_high_alert"), F.lit(0)).alias("num_high_alert_meds"),
            F.count_distinct("drug_class").alias("num_unique_drug_classes")]


def _has_high_alert() -> Column:
    return X.flag(F.col("num_high_alert_meds") > 0)


# -- A6 ----------------------------------------------------------------------
def diagnosis_features(df: DataFrame) -> DataFrame:
    return rollup(df, "admission_id", _diagnosis_aggs("diagnosis_id"))


def _diagnosis_aggs(key: str) -> list[Column]:
    return [F.count(key).alias("num_diagnoses"),
            F.coalesce(F.sum(X.flag(F.col("poa_flag") == "Y")), F.lit(0)).alias("num_poa_diagnoses")]


# -- A1-A6, F9, J3 at once ---------------------------------------------------
def record_features(df: DataFrame) -> DataFrame:
    """The four rollups above in one aggregate, for records that hold vitals,
    lab flag, medication and diagnosis of one ``record_id`` (de-duplicated by
    it, drug classes in title case): the same columns, in the same order.

    A partial row of all these statistics is wider than the few records that
    an admission has, so the records are dealt by admission first: they are
    sorted and aggregated where they lie, and no partial rows are shuffled."""
    df = C.range_to_null(df, VITAL_RANGES)
    df = C.fill_constant(C.upper_columns(df, ["flag", "poa_flag"]), {"flag": "N"})
    df = C.fill_cast_int(df, ["is_high_alert"])
    key = "record_id"
    aggs = [*_vital_aggs(key), *_lab_aggs(key), *_medication_aggs(key), *_diagnosis_aggs(key)]
    agg = rollup(df.filter(F.col("admission_id").isNotNull()).repartition("admission_id"), "admission_id", aggs)
    stats = [f"{c}_{s}" for c in NUMERIC_VITALS for s in ("mean", "min", "max", "std")]
    return agg.select(
        "admission_id", *stats, "num_vital_readings", _bmi().alias("bmi"),
        "num_lab_tests", "num_abnormal_labs", _pct_abnormal().alias("pct_abnormal_labs"),
        "num_medications", "num_high_alert_meds", "num_unique_drug_classes", _has_high_alert().alias("has_high_alert_med"),
        "num_diagnoses", "num_poa_diagnoses")


# -- A7 ----------------------------------------------------------------------
def ed_features(df: DataFrame) -> DataFrame:
    agg = rollup(df, "patient_id", {
        "num_ed_visits": F.count("ed_visit_id"),
        "num_ed_admissions": F.coalesce(F.sum("admitted_from_ed"), F.lit(0)),
        "avg_ed_wait_minutes": F.avg("wait_time_minutes"),
        "avg_ed_los_minutes": F.avg("ed_los_minutes"),
    })
    return agg.withColumns({
        "avg_ed_wait_minutes": X.np_round("avg_ed_wait_minutes", 1),
        "avg_ed_los_minutes": X.np_round("avg_ed_los_minutes", 1),
    })


def feature_tables(clean: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {
        "admissions": admission_features(clean["admissions"]),
        "patients": patient_features(clean["patients"]),
        "vitals_agg": vitals_features(clean["vitals"]),
        "lab_agg": lab_features(clean["lab_results"]),
        "med_agg": medication_features(clean["medications"]),
        "diag_agg": diagnosis_features(clean["diagnoses"]),
        "ed_agg": ed_features(clean["ed_visits"]),
    }


# -- J1, J2, P7: master ------------------------------------------------------
def integrate(features: dict[str, DataFrame]) -> DataFrame:
    """Admission-grain master: left joins on admission_id, then patient_id.

    The admission rollups (four, or ``record_agg`` for all of them) leave their
    aggregates hash-partitioned on ``admission_id``, so the chain shuffles the admissions side once; the
    switch to ``patient_id`` costs one more shuffle of the widened rows.
    """
    master = features["admissions"]
    sides = ("record_agg",) if "record_agg" in features else ("vitals_agg", "lab_agg", "med_agg", "diag_agg")
    for name in sides:
        master = merge(master, features[name], "admission_id", "left")
    # patients are de-duplicated on patient_id (one null-key row at most) and the
    # ED rollup has one row per non-null key: both are joined first, at patient
    # grain, so that the widened admissions are shuffled on patient_id once and
    # by a plain join, which AQE can split where one patient is hot
    people = merge(features["patients"], features["ed_agg"], "patient_id", "outer")
    master = merge(master, people, "patient_id", "left", null_safe=True, right_unique=True)
    return C.fill_prefix(master, "num_", 0)


def build_master(raw: dict[str, DataFrame]) -> DataFrame:
    return integrate(feature_tables(clean_all(raw)))


# -- F10: composite high-risk target ---------------------------------------
def high_risk_target(df: DataFrame, out: str = "high_risk") -> DataFrame:
    return df.withColumn(out, X.any_true(
        F.col("readmitted_within_30d") == 1,
        F.col("length_of_stay_days") > 7,
        F.col("icu_days") > 0,
        F.col("total_comorbidities") >= 3,
        F.col("num_prior_admissions") >= 3,
    ))


# ---------------------------------------------------------------------------
# Columns removed before modelling.
# ---------------------------------------------------------------------------
TARGET = "readmitted_within_30d"
READMISSION_DROP = [
    "readmitted_within_30d", "admission_id", "patient_id", "admission_date",
    "discharge_date", "original_discharge_date", "date_of_birth", "registered_date",
]
HIGH_RISK_LEAKAGE = [
    "readmitted_within_30d", "length_of_stay_days", "icu_days", "total_comorbidities",
    "num_prior_admissions", "icu_admitted", "had_icu_stay", "icu_ratio", "cost_per_day",
    "is_high_utiliser", "readmission_reason", "discharge_disposition", "total_charges_usd",
    "insurance_paid_usd", "out_of_pocket_cost", "insurance_coverage_ratio",
    "primary_diagnosis_desc", "attending_physician_id", "zip_code", "hospital", "ward",
    "primary_hospital", "icu_admitted", "had_icu_stay", "is_high_comorbidity", "age_group",
    "low_social_support",
]
ID_DATE_COLS = [
    "admission_id", "patient_id", "admission_date", "discharge_date",
    "original_discharge_date", "date_of_birth", "registered_date",
]
READMISSION_INPUTS = [
    "age", "gender", "insurance_type", "admission_type", "admission_source", "length_of_stay_days",
    "charlson_comorbidity_index", "num_prior_admissions", "num_medications",
    "has_diabetes", "has_hypertension", "has_heart_disease", "has_copd",
]
HIGH_RISK_INPUTS = [
    "age", "gender", "admission_type", "charlson_comorbidity_index", "num_prior_admissions",
    "num_ed_visits", "social_support_score", "smoking_status", "alcohol_use",
    "has_diabetes", "has_hypertension", "has_heart_disease", "has_copd",
]
