"""DuckDB SQL for the correctness oracle.

The Spark side builds each role and feature table with DataFrame operators;
this module writes the same definitions as plain SQL over the driver's
views, by a different route where one exists (``lead`` windows for the next
order, ``QUALIFY row_number()`` for de-duplication, joins for BMI), so that
the comparison checks the operators rather than a shared code path.
"""

from __future__ import annotations

import re as _re

from wardline.plans import clinical as K

LINE_ORDER = "l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus"


def rnd(expr: str, places: int) -> str:
    """NumPy rounding: scale, half-even, unscale."""
    return f"(round_even(CAST({expr} AS DOUBLE) * 1e{places}, 0) / 1e{places})"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"


def title(expr: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({strip(expr)}, '\\pL+|[^\\pL]+'), "
        f"lambda x: upper(x[1]) || lower(x[2:])), '')"
    )


def clip(expr: str, lo=None, hi=None) -> str:
    parts = []
    if lo is not None:
        parts.append(f"WHEN {expr} < {lo} THEN {lo}")
    if hi is not None:
        parts.append(f"WHEN {expr} > {hi} THEN {hi}")
    return f"(CASE {' '.join(parts)} ELSE {expr} END)"


def sdiv(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0))"


def settle(sql: str, cols: list[str], places: int = 6) -> str:
    """Round the listed double columns of a query, as the Spark side does."""
    if not cols:
        return sql
    rep = ", ".join(f"{rnd(c, places)} AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) AS _s"


# ---------------------------------------------------------------------------
# Role tables over the driver views
# ---------------------------------------------------------------------------
def _has_cols() -> str:
    out = []
    for i, n in enumerate(K.COMORBIDITY_COLS):
        e = f"CAST((c_custkey >> {i}) & 1 AS INTEGER)"
        if n == "has_obesity":
            e = f"CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE {e} END"
        out.append(f"{e} AS {n}")
    return ",\n    ".join(out)


ROLE_SQL = {
    "orders_next": """
  SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice, o_orderpriority, o_orderstatus,
         lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next_date
  FROM orders""",
    "raw_admissions": """
  SELECT o_orderkey AS admission_id, o_custkey AS patient_id, o_orderdate AS admission_date,
    o_orderkey % 15 - 1 AS length_of_stay_days,
    o_orderkey % 12 - 10 AS icu_days,
    o_totalprice AS total_charges_usd,
    o_totalprice * (o_orderkey % 12) / 10 AS insurance_paid_usd,
    CASE WHEN o_orderkey % 97 = 0 THEN NULL
         ELSE CAST(coalesce(date_diff('day', o_orderdate, next_date) <= 30, false) AS INTEGER) END
      AS readmitted_within_30d,
    o_orderpriority AS admission_type,
    o_orderstatus AS admission_source,
    ' ' || lower(substr(o_orderpriority, 3)) || ' ' AS discharge_disposition
  FROM orders_next""",
    "raw_patients": f"""
  SELECT c_custkey AS patient_id, c_name AS first_name, 'MRN' || CAST(c_custkey AS VARCHAR) AS mrn,
    CASE WHEN c_nationkey % 3 = 0 THEN 'male' WHEN c_nationkey % 3 = 1 THEN ' FEMALE ' ELSE 'non-binary' END AS gender,
    CASE c_nationkey % 4 WHEN 0 THEN 'white' WHEN 1 THEN 'black' WHEN 2 THEN 'asian' ELSE 'hispanic' END AS ethnicity,
    lower(c_mktsegment) AS insurance_type,
    CASE c_custkey % 4 WHEN 0 THEN 'never' WHEN 1 THEN 'former' WHEN 2 THEN ' current' END AS smoking_status,
    CASE c_custkey % 3 WHEN 1 THEN 'moderate' WHEN 2 THEN 'HEAVY ' END AS alcohol_use,
    CASE WHEN c_nationkey % 2 = 0 THEN 'english' ELSE 'spanish' END AS language_preference,
    (c_custkey * 7) % 124 AS age,
    c_custkey % 7 AS charlson_comorbidity_index,
    c_custkey % 5 AS num_prior_admissions,
    c_custkey % 8 AS num_prior_ed_visits,
    c_acctbal / 1000 AS social_support_score,
    {_has_cols()}
  FROM customer""",
    "lines": """
  SELECT *, l_orderkey * 10 + l_linenumber AS rid FROM lineitem""",
    "raw_lab_results": """
  SELECT rid AS lab_id, l_orderkey AS admission_id, l_shipdate AS drawn_at,
    CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN lower(l_returnflag) || ' '
         ELSE l_returnflag END AS flag,
    """ + LINE_ORDER + """
  FROM lines""",
    "raw_medications": """
  SELECT rid AS medication_id, l_orderkey AS admission_id, l_shipdate AS start_datetime,
    CASE WHEN l_linenumber % 3 = 0 THEN ' ' || lower(p_type) ELSE p_type END AS drug_class,
    CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE CAST(l_linestatus = 'O' AS INTEGER) END AS is_high_alert,
    """ + LINE_ORDER + """
  FROM lines LEFT JOIN part ON l_partkey = p_partkey""",
    "raw_diagnoses": """
  SELECT rid AS diagnosis_id, l_orderkey AS admission_id,
    'I' || CAST(l_partkey % 100 AS VARCHAR) AS icd_code,
    CASE WHEN l_linestatus = 'O' THEN ' y' ELSE 'N ' END AS poa_flag,
    l_linenumber - 1 AS diagnosis_rank,
    """ + LINE_ORDER + """
  FROM lines""",
    "raw_vitals": """
  SELECT rid AS vital_id, l_orderkey AS admission_id, l_shipdate AS measured_at,
    l_quantity * 6 + 30 AS systolic_bp,
    l_quantity * 4 + 10 AS diastolic_bp,
    l_extendedprice / 300 AS heart_rate,
    CAST(l_linenumber * 2 + 10 AS DOUBLE) AS respiratory_rate,
    l_discount * 200 + 28 AS temperature_c,
    l_tax * 700 + 40 AS spo2_percent,
    l_quantity % 13 + 3 AS gcs_score,
    l_quantity % 20 AS news2_score,
    CAST(l_suppkey % 11 AS DOUBLE) AS pain_score,
    CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE l_quantity * 3 + 10 END AS weight_kg,
    CAST(l_partkey % 110 + 90 AS DOUBLE) AS height_cm,
    """ + LINE_ORDER + """
  FROM lines""",
    "raw_ed_visits": """
  SELECT event_id AS ed_visit_id, user_id AS patient_id, ts AS arrival_datetime,
    value - 2 AS wait_time_minutes,
    value / 2 - 1 AS door_to_doctor_min,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) AS ed_los_minutes,
    event_type AS triage_category,
    CAST(event_type = 'purchase' AS INTEGER) AS admitted_from_ed
  FROM events""",
    "raw_readmissions": """
  SELECT o_orderkey AS readmission_id, o_custkey AS patient_id,
    o_orderdate AS original_discharge_date, next_date AS readmission_date,
    date_diff('day', o_orderdate, next_date) - 1 AS days_to_readmission,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 3 = 0 AS INTEGER) END AS planned_readmission,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_custkey % 2 = 0 AS INTEGER) END AS same_diagnosis
  FROM orders_next WHERE next_date IS NOT NULL""",
}


def _dedup(raw: str, key: str, cols: list[str], line_order: bool) -> str:
    order = (LINE_ORDER + ", " if line_order else "") + ", ".join(f"{c} NULLS FIRST" for c in cols)
    return f"""
  SELECT {', '.join(cols)} FROM {raw}
  QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {order}) = 1"""


ADM_COLS = ["admission_id", "patient_id", "admission_date", "length_of_stay_days", "icu_days",
            "total_charges_usd", "insurance_paid_usd", "readmitted_within_30d", "admission_type",
            "admission_source", "discharge_disposition"]
PAT_COLS = ["patient_id", "first_name", "mrn", "gender", "ethnicity", "insurance_type", "smoking_status",
            "alcohol_use", "language_preference", "age", "charlson_comorbidity_index", "num_prior_admissions",
            "num_prior_ed_visits", "social_support_score"] + K.COMORBIDITY_COLS
LAB_COLS = ["lab_id", "admission_id", "drawn_at", "flag"]
MED_COLS = ["medication_id", "admission_id", "start_datetime", "drug_class", "is_high_alert"]
DIAG_COLS = ["diagnosis_id", "admission_id", "icd_code", "poa_flag", "diagnosis_rank"]
VIT_COLS = ["vital_id", "admission_id", "measured_at", "systolic_bp", "diastolic_bp", "heart_rate",
            "respiratory_rate", "temperature_c", "spo2_percent", "gcs_score", "news2_score", "pain_score",
            "weight_kg", "height_cm"]
ED_COLS = ["ed_visit_id", "patient_id", "arrival_datetime", "wait_time_minutes", "door_to_doctor_min",
           "ed_los_minutes", "triage_category", "admitted_from_ed"]
READM_COLS = ["readmission_id", "patient_id", "original_discharge_date", "readmission_date",
              "days_to_readmission", "planned_readmission", "same_diagnosis"]


def _t(c: str) -> str:
    return f"{title(c)} AS {c}"


def _vital_null(c: str, lo, hi) -> str:
    conds = []
    if lo is not None:
        conds.append(f"{c} < {lo}")
    if hi is not None:
        conds.append(f"{c} > {hi}")
    return f"CASE WHEN {' OR '.join(conds)} THEN NULL ELSE {c} END AS {c}"


CLEAN_SQL = {
    "dd_admissions": _dedup("raw_admissions", "admission_id", ADM_COLS, False),
    "clean_admissions": f"""
  SELECT admission_id, patient_id, admission_date,
    {clip('length_of_stay_days', 0)} AS length_of_stay_days,
    {clip('icu_days', 0)} AS icu_days,
    {clip('total_charges_usd', 0)} AS total_charges_usd,
    {clip('insurance_paid_usd', 0)} AS insurance_paid_usd,
    CAST(coalesce(readmitted_within_30d, 0) AS INTEGER) AS readmitted_within_30d,
    {_t('admission_type')}, {_t('admission_source')}, {_t('discharge_disposition')}
  FROM dd_admissions""",
    "dd_patients": _dedup("raw_patients", "patient_id", PAT_COLS, False),
    "clean_patients": f"""
  SELECT * EXCLUDE (first_name, mrn) REPLACE (
    {_t('gender')}, {_t('ethnicity')}, {_t('insurance_type')},
    coalesce({title('smoking_status')}, 'Unknown') AS smoking_status,
    coalesce({title('alcohol_use')}, 'Unknown') AS alcohol_use,
    {_t('language_preference')},
    {clip('social_support_score', 0, 10)} AS social_support_score)
  FROM dd_patients""",
    "dd_lab_results": _dedup("raw_lab_results", "lab_id", LAB_COLS, True),
    "clean_lab_results": f"""
  SELECT lab_id, admission_id, drawn_at, coalesce(upper({strip('flag')}), 'N') AS flag FROM dd_lab_results""",
    "dd_medications": _dedup("raw_medications", "medication_id", MED_COLS, True),
    "clean_medications": f"""
  SELECT medication_id, admission_id, start_datetime, {_t('drug_class')},
    CAST(coalesce(is_high_alert, 0) AS INTEGER) AS is_high_alert FROM dd_medications""",
    "dd_diagnoses": _dedup("raw_diagnoses", "diagnosis_id", DIAG_COLS, True),
    "clean_diagnoses": f"""
  SELECT diagnosis_id, admission_id, icd_code, upper({strip('poa_flag')}) AS poa_flag,
    {clip('diagnosis_rank', 1)} AS diagnosis_rank FROM dd_diagnoses""",
    "dd_vitals": _dedup("raw_vitals", "vital_id", VIT_COLS, True),
    "clean_vitals": "\n  SELECT * REPLACE (" + ", ".join(
        _vital_null(c, lo, hi) for c, (lo, hi) in K.VITAL_RANGES.items()) + ") FROM dd_vitals",
    "dd_ed_visits": _dedup("raw_ed_visits", "ed_visit_id", ED_COLS, False),
    "clean_ed_visits": f"""
  SELECT ed_visit_id, patient_id, arrival_datetime,
    {clip('wait_time_minutes', 0)} AS wait_time_minutes,
    {clip('door_to_doctor_min', 0)} AS door_to_doctor_min,
    {clip('ed_los_minutes', 0)} AS ed_los_minutes,
    {_t('triage_category')}, admitted_from_ed FROM dd_ed_visits""",
    "dd_readmissions": _dedup("raw_readmissions", "readmission_id", READM_COLS, False),
    "clean_readmissions": f"""
  SELECT readmission_id, patient_id, original_discharge_date, readmission_date,
    {clip('days_to_readmission', 0)} AS days_to_readmission,
    CAST(coalesce(planned_readmission, 0) AS INTEGER) AS planned_readmission,
    CAST(coalesce(same_diagnosis, 0) AS INTEGER) AS same_diagnosis FROM dd_readmissions""",
}


def _age_group(c: str = "age") -> str:
    e = K.AGE_EDGES
    whens = " ".join(
        f"WHEN {c} > {lo} AND {c} <= {hi} THEN '{lab}'" for lo, hi, lab in zip(e[:-1], e[1:], K.AGE_LABELS)
    )
    return f"CASE {whens} END"


def _comorb_sum() -> str:
    return " + ".join(f"coalesce(CAST({c} AS DOUBLE), 0)" for c in K.COMORBIDITY_COLS)


def _vital_stats() -> str:
    out = []
    for c in K.NUMERIC_VITALS:
        out += [f"avg({c}) AS {c}_mean", f"min({c}) AS {c}_min", f"max({c}) AS {c}_max",
                f"stddev_samp({c}) AS {c}_std"]
    return ",\n    ".join(out)


FEATURE_SQL = {
    "f_admissions": f"""
  SELECT *,
    CAST(year(admission_date) AS INTEGER) AS admission_year,
    CAST(month(admission_date) AS INTEGER) AS admission_month,
    CAST(isodow(admission_date) - 1 AS INTEGER) AS admission_dayofweek,
    CAST(coalesce(isodow(admission_date) - 1 IN (5, 6), false) AS INTEGER) AS is_weekend_admission,
    {rnd(sdiv('total_charges_usd', 'length_of_stay_days'), 2)} AS cost_per_day,
    {clip('(total_charges_usd - insurance_paid_usd)', 0)} AS out_of_pocket_cost,
    {rnd(sdiv('insurance_paid_usd', 'total_charges_usd'), 4)} AS insurance_coverage_ratio,
    {rnd(sdiv('icu_days', 'length_of_stay_days'), 4)} AS icu_ratio,
    CAST(coalesce(icu_days > 0, false) AS INTEGER) AS had_icu_stay
  FROM clean_admissions""",
    "f_patients": f"""
  SELECT *,
    {_age_group()} AS age_group,
    {_comorb_sum()} AS total_comorbidities,
    CAST(coalesce(charlson_comorbidity_index >= 3, false) AS INTEGER) AS is_high_comorbidity,
    CAST(coalesce(num_prior_admissions >= 3, false) OR coalesce(num_prior_ed_visits >= 5, false) AS INTEGER)
      AS is_high_utiliser,
    CAST(coalesce(social_support_score <= 3, false) AS INTEGER) AS low_social_support
  FROM clean_patients""",
    "v_first": """
  SELECT admission_id, weight_kg, height_cm FROM clean_vitals
  WHERE admission_id IS NOT NULL AND weight_kg IS NOT NULL AND height_cm IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY admission_id ORDER BY measured_at, vital_id) = 1""",
    "v_stats": f"""
  SELECT admission_id,
    {_vital_stats()},
    count(vital_id) AS num_vital_readings
  FROM clean_vitals WHERE admission_id IS NOT NULL GROUP BY admission_id""",
    "vitals_agg": f"""
  SELECT s.*, {rnd('f.weight_kg / pow(f.height_cm / 100, 2)', 1)} AS bmi
  FROM v_stats s LEFT JOIN v_first f USING (admission_id)""",
    "lab_agg": f"""
  SELECT admission_id, count(lab_id) AS num_lab_tests,
    CAST(coalesce(sum(CAST(coalesce(flag <> 'N', true) AS INTEGER)), 0) AS BIGINT) AS num_abnormal_labs,
    {rnd(sdiv('coalesce(sum(CAST(coalesce(flag <> ' + "'N'" + ', true) AS INTEGER)), 0)', 'count(lab_id)'), 4)}
      AS pct_abnormal_labs
  FROM clean_lab_results WHERE admission_id IS NOT NULL GROUP BY admission_id""",
    "med_agg": """
  SELECT admission_id, count(medication_id) AS num_medications,
    CAST(coalesce(sum(is_high_alert), 0) AS BIGINT) AS num_high_alert_meds,
    count(DISTINCT drug_class) AS num_unique_drug_classes,
    CAST(coalesce(sum(is_high_alert), 0) > 0 AS INTEGER) AS has_high_alert_med
  FROM clean_medications WHERE admission_id IS NOT NULL GROUP BY admission_id""",
    "diag_agg": """
  SELECT admission_id, count(diagnosis_id) AS num_diagnoses,
    CAST(coalesce(sum(CAST(coalesce(poa_flag = 'Y', false) AS INTEGER)), 0) AS BIGINT) AS num_poa_diagnoses
  FROM clean_diagnoses WHERE admission_id IS NOT NULL GROUP BY admission_id""",
    "ed_agg": f"""
  SELECT patient_id, count(ed_visit_id) AS num_ed_visits,
    CAST(coalesce(sum(admitted_from_ed), 0) AS BIGINT) AS num_ed_admissions,
    {rnd('avg(wait_time_minutes)', 1)} AS avg_ed_wait_minutes,
    {rnd('avg(ed_los_minutes)', 1)} AS avg_ed_los_minutes
  FROM clean_ed_visits WHERE patient_id IS NOT NULL GROUP BY patient_id""",
}

MASTER_NUM_FILL = [
    "num_vital_readings", "num_lab_tests", "num_abnormal_labs", "num_medications", "num_high_alert_meds",
    "num_unique_drug_classes", "num_diagnoses", "num_poa_diagnoses", "num_ed_visits", "num_ed_admissions",
    "num_prior_admissions", "num_prior_ed_visits",
]

FEATURE_SQL["master"] = """
  SELECT * REPLACE (""" + ", ".join(f"coalesce({c}, 0) AS {c}" for c in MASTER_NUM_FILL) + """)
  FROM (
    SELECT a.*, v.* EXCLUDE (admission_id), l.* EXCLUDE (admission_id), m.* EXCLUDE (admission_id),
           d.* EXCLUDE (admission_id), p.* EXCLUDE (patient_id), e.* EXCLUDE (patient_id)
    FROM f_admissions a
    LEFT JOIN vitals_agg v ON a.admission_id = v.admission_id
    LEFT JOIN lab_agg l ON a.admission_id = l.admission_id
    LEFT JOIN med_agg m ON a.admission_id = m.admission_id
    LEFT JOIN diag_agg d ON a.admission_id = d.admission_id
    LEFT JOIN f_patients p ON a.patient_id IS NOT DISTINCT FROM p.patient_id
    LEFT JOIN ed_agg e ON a.patient_id IS NOT DISTINCT FROM e.patient_id
  ) AS _m"""

ALL_CTES: dict[str, str] = {**ROLE_SQL, **CLEAN_SQL, **FEATURE_SQL}

# dependencies of each CTE, by name reference
_DEPS: dict[str, list[str]] = {}
for _name, _sql in ALL_CTES.items():
    _DEPS[_name] = [
        d for d in ALL_CTES if d != _name and _re.search(rf"\b{_re.escape(d)}\b", _sql)
    ]


def with_ctes(body: str, *needed: str, extra: dict[str, str] | None = None) -> str:
    """``WITH`` clause holding ``needed`` CTEs and their dependencies, then ``body``."""
    ctes = dict(ALL_CTES)
    deps = dict(_DEPS)
    if extra:
        for name, sql in extra.items():
            ctes[name] = sql
            deps[name] = [d for d in ctes if d != name and _re.search(rf"\b{_re.escape(d)}\b", sql)]
    order: list[str] = []

    def visit(n: str):
        if n in order:
            return
        for d in deps.get(n, []):
            visit(d)
        order.append(n)

    for n in needed:
        visit(n)
    if extra:
        for n in extra:
            visit(n)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({ctes[n]}\n)" for n in order) + "\n" + body
