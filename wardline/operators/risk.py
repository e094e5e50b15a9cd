"""Risk bands, patient risk profiles, flags and forecast reporting.

All row-level: column expressions only, no shuffle, except the forecast
KPIs (one aggregate per series) and the one-row defaults, which are broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import exprs as X

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's.
# ---------------------------------------------------------------------------
BAND_EDGES = (0.3, 0.6)  # < 0.3 Low Risk, < 0.6 Moderate Risk, else High Risk
BAND_LABELS = ("Low Risk", "Moderate Risk", "High Risk")
LEVEL_EDGES = (0.3, 0.6)  # factor colour: > 0.6 high, > 0.3 moderate, else low
SMOKE_MAP = {"Never": 0.0, "Former": 0.4, "Current": 1.0}
ALCOHOL_MAP = {"Unknown": 0.0, "Moderate": 0.4, "Heavy": 1.0}
FOUR_COMORBIDITIES = ["has_diabetes", "has_hypertension", "has_heart_disease", "has_copd"]
READMISSION_FACTORS = [  # (label, column, divisor, capped at 1)
    ("Age", "age", 90, True),
    ("Length of Stay", "length_of_stay_days", 30, True),
    ("Charlson Index", "charlson_comorbidity_index", 10, True),
    ("Prior Admissions", "num_prior_admissions", 10, True),
    ("Medications", "num_medications", 20, True),
]
HIGH_RISK_FACTORS = [
    ("Age", "age", 90, True),
    ("Charlson Index", "charlson_comorbidity_index", 10, True),
    ("Prior Admissions", "num_prior_admissions", 10, True),
    ("ED Visits", "num_ed_visits", 20, True),
]
FLAG_TEXT = {
    "age": "Age ≥ 75",
    "los": "LOS ≥ 7 days",
    "charlson": "Charlson ≥ 3",
    "prior": "≥ 3 Prior Admissions",
    "emergency": "Emergency Admission",
}
# ---------------------------------------------------------------------------


# -- R3 ----------------------------------------------------------------------
def risk_band(prob: Column | str) -> Column:
    p = X.col(prob)
    return F.when(p < BAND_EDGES[0], BAND_LABELS[0]).when(p < BAND_EDGES[1], BAND_LABELS[1]).when(
        p.isNotNull(), BAND_LABELS[2]
    )


def comorbidity_count(cols: Sequence[str] = FOUR_COMORBIDITIES) -> Column:
    total = None
    for c in cols:
        total = F.col(c) if total is None else total + F.col(c)
    return total


def _factor(col: str, div: float, cap: bool) -> Column:
    v = F.col(col).cast("double") / div
    return F.when(v > 1.0, F.lit(1.0)).otherwise(v) if cap else v


def _map(col: str, mapping: dict) -> Column:
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.try_element_at(m, F.col(col))


def _profile(df: DataFrame, key: str, factors: list[tuple[str, Column]]) -> DataFrame:
    """Long profile ``(key, factor, value, level, position)``; ``position``
    is the ascending order the chart uses (ties keep the factor order).  The
    few values of a row are sorted inside the row: no shuffle."""
    items = []
    for i, (name, expr) in enumerate(factors):
        v = expr.cast("double")
        items.append(F.struct(v.isNull().alias("__n"), v.alias("value"), F.lit(i).alias("__i"), F.lit(name).alias("factor")))
    long = df.select(key, F.posexplode(F.sort_array(F.array(*items))).alias("__p", "__f"))
    value = F.col("__f.value")
    level = F.when(value > LEVEL_EDGES[1], "high").when(value > LEVEL_EDGES[0], "moderate").when(value.isNotNull(), "low")
    return long.select(key, "__f.factor", value.alias("value"), level.alias("level"), (F.col("__p") + 1).alias("position"))


# -- R4, R6 ------------------------------------------------------------------
def readmission_profile(df: DataFrame, key: str) -> DataFrame:
    f = [(n, _factor(c, d, cap)) for n, c, d, cap in READMISSION_FACTORS]
    f.append(("Comorbidities", comorbidity_count() / 4))
    return _profile(df, key, f)


# -- R5 ----------------------------------------------------------------------
def high_risk_profile(df: DataFrame, key: str) -> DataFrame:
    f = [(n, _factor(c, d, cap)) for n, c, d, cap in HIGH_RISK_FACTORS]
    f += [
        ("Low Social Support", 1 - F.col("social_support_score") / 10),
        ("Comorbidities", comorbidity_count() / 4),
        ("Smoking", _map("smoking_status", SMOKE_MAP)),
        ("Alcohol Use", _map("alcohol_use", ALCOHOL_MAP)),
    ]
    return _profile(df, key, f)


# -- R7 ----------------------------------------------------------------------
def risk_flags(df: DataFrame, key: str) -> DataFrame:
    """Active flags in the reference's order, joined by ``; `` and counted."""
    n = comorbidity_count()
    items = [
        F.when(F.col("age") >= 75, F.lit(FLAG_TEXT["age"])),
        F.when(F.col("length_of_stay_days") >= 7, F.lit(FLAG_TEXT["los"])),
        F.when(F.col("charlson_comorbidity_index") >= 3, F.lit(FLAG_TEXT["charlson"])),
        F.when(F.col("num_prior_admissions") >= 3, F.lit(FLAG_TEXT["prior"])),
        F.when(n >= 2, F.concat(n.cast("string"), F.lit(" Comorbidities"))),
        F.when(F.col("admission_type") == "Emergency", F.lit(FLAG_TEXT["emergency"])),
    ]
    arr = F.array_compact(F.array(*items))
    return df.select(key, F.array_join(arr, "; ").alias("flags"), F.size(arr).alias("n_flags"))


# -- J6 ----------------------------------------------------------------------
def overlay_defaults(inputs: DataFrame, defaults: DataFrame) -> DataFrame:
    """Each column of ``inputs`` overrides the one-row ``defaults`` where not
    null; columns only in ``defaults`` are taken as they are (broadcast)."""
    d = defaults.select(*[F.col(c).alias(f"__d_{c}") for c in defaults.columns])
    j = inputs.crossJoin(F.broadcast(d))
    cols = [F.coalesce(F.col(c), F.col(f"__d_{c}")).alias(c) if c in defaults.columns else F.col(c)
            for c in inputs.columns]
    cols += [F.col(f"__d_{c}").alias(c) for c in defaults.columns if c not in inputs.columns]
    return j.select(*cols)


# -- R8 ----------------------------------------------------------------------
def forecast_kpis(fc: DataFrame, series: str = "series") -> DataFrame:
    """avg (rounded half-even), peak, earliest peak date, total, horizon."""
    return fc.groupBy(series).agg(
        X.np_round(F.avg("forecast"), 0).alias("avg_daily"),
        X.np_round(F.max("forecast"), 0).alias("peak"),
        F.min_by("date", F.struct(-F.col("forecast"), F.col("date"))).alias("peak_date"),
        X.np_round(F.sum("forecast"), 0).alias("total"),
        F.count(F.lit(1)).alias("days"),
    )


# -- R9 ----------------------------------------------------------------------
def forecast_table(fc: DataFrame) -> DataFrame:
    return fc.select(
        "series", "date",
        F.date_format("date", "EEE").alias("day"),
        X.np_round("forecast", 0).alias("forecast"),
        X.np_round("lower", 0).alias("low"),
        X.np_round("upper", 0).alias("high"),
        (F.weekday("date") >= 5).alias("weekend"),
    )
