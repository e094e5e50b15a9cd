"""Adapter: the driver's TPC-H-style tables presented in the clinical roles.

The driver ships ``orders``, ``customer``, ``lineitem``, ``part`` and
``events``; the clinical jobs expect admissions, patients, lab results,
medications, diagnoses, vitals, ED visits and readmissions.  Each role is a
projection of one driver table (medications add ``part``).  The DuckDB side
of the correctness check uses the same expressions, written as SQL in
``wardline.plans.oracle``; keep the two in step.

Missing values, untrimmed or lower-case text and out-of-range numbers are
injected by expressions on the keys, so that every cleaning rule has work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.exprs import strip_title
from wardline.operators.clean import dedup_first
from wardline.operators.sequence import next_in_sequence
from wardline.plans.clinical import COMORBIDITY_COLS

ROLES = (
    "admissions",
    "patients",
    "lab_results",
    "medications",
    "diagnoses",
    "vitals",
    "ed_visits",
    "readmissions",
)

# Order that stands in for "file order" when de-duplicating lineitem roles.
LINE_ORDER = [
    "l_shipdate",
    "l_partkey",
    "l_suppkey",
    "l_extendedprice",
    "l_quantity",
    "l_discount",
    "l_tax",
    "l_returnflag",
    "l_linestatus",
]


def _null_when(cond: Column, value: Column) -> Column:
    return F.when(cond, F.lit(None)).otherwise(value)


def _bit(c: Column, i: int) -> Column:
    return F.shiftright(c, i).bitwiseAND(F.lit(1)).cast("int")


def _lab_flag() -> Column:
    return (
        F.when(F.col("l_linenumber") == 7, F.lit(None))
        .when(F.col("l_linenumber") == 6, F.concat(F.lower("l_returnflag"), F.lit(" ")))
        .otherwise(F.col("l_returnflag"))
    )


def _third_drug() -> Column:
    return F.concat(F.lit(" "), F.lower("p_type"))


def _high_alert() -> Column:
    return _null_when(F.col("l_partkey") % 13 == 0, (F.col("l_linestatus") == "O").cast("int"))


def _poa_flag() -> Column:
    return F.when(F.col("l_linestatus") == "O", F.lit(" y")).otherwise(F.lit("N "))


def _vital_values() -> list[Column]:
    q, p, d, t = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    return [
        (q * 6 + 30).alias("systolic_bp"),
        (q * 4 + 10).alias("diastolic_bp"),
        (p / 300).alias("heart_rate"),
        (F.col("l_linenumber") * 2 + 10).cast("double").alias("respiratory_rate"),
        (d * 200 + 28).alias("temperature_c"),
        (t * 700 + 40).alias("spo2_percent"),
        (q % 13 + 3).alias("gcs_score"),
        (q % 20).alias("news2_score"),
        (F.col("l_suppkey") % 11).cast("double").alias("pain_score"),
        _null_when(F.col("l_suppkey") % 11 == 0, q * 3 + 10).alias("weight_kg"),
        (F.col("l_partkey") % 110 + 90).cast("double").alias("height_cm"),
    ]


class DriverTables:
    """Lazily built role DataFrames over one ``sf_dir``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def role(self, name: str) -> DataFrame:
        return getattr(self, name)()

    def roles(self) -> dict[str, DataFrame]:
        return {r: self.role(r) for r in ROLES}

    # -- admissions ------------------------------------------------------
    def _orders_with_next(self) -> DataFrame:
        o = self.table("orders").select(
            "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority", "o_orderstatus"
        )
        return next_in_sequence(o, "o_custkey", "o_orderdate", "o_orderkey", out="next_date")

    def admissions(self) -> DataFrame:
        o = self._orders_with_next()
        k = F.col("o_orderkey")
        gap = F.datediff(F.to_date("next_date"), F.to_date("o_orderdate"))
        readmit = F.coalesce(gap <= 30, F.lit(False)).cast("int")
        return o.select(
            k.alias("admission_id"),
            F.col("o_custkey").alias("patient_id"),
            F.col("o_orderdate").alias("admission_date"),
            (k % 15 - 1).alias("length_of_stay_days"),
            (k % 12 - 10).alias("icu_days"),
            F.col("o_totalprice").alias("total_charges_usd"),
            (F.col("o_totalprice") * (k % 12) / 10).alias("insurance_paid_usd"),
            _null_when(k % 97 == 0, readmit).alias("readmitted_within_30d"),
            F.col("o_orderpriority").alias("admission_type"),
            F.col("o_orderstatus").alias("admission_source"),
            F.concat(F.lit(" "), F.lower(F.substring("o_orderpriority", 3, 100)), F.lit(" ")).alias(
                "discharge_disposition"
            ),
        )

    # -- patients --------------------------------------------------------
    def patients(self) -> DataFrame:
        c = self.table("customer")
        k = F.col("c_custkey")
        nk = F.col("c_nationkey")
        gender = F.when(nk % 3 == 0, "male").when(nk % 3 == 1, " FEMALE ").otherwise("non-binary")
        ethnicity = (
            F.when(nk % 4 == 0, "white")
            .when(nk % 4 == 1, "black")
            .when(nk % 4 == 2, "asian")
            .otherwise("hispanic")
        )
        smoking = F.when(k % 4 == 0, "never").when(k % 4 == 1, "former").when(k % 4 == 2, " current")
        alcohol = F.when(k % 3 == 1, "moderate").when(k % 3 == 2, "HEAVY ")
        language = F.when(nk % 2 == 0, "english").otherwise("spanish")
        flags = [
            _null_when(k % 11 == 0, _bit(k, i)).alias(n) if n == "has_obesity" else _bit(k, i).alias(n)
            for i, n in enumerate(COMORBIDITY_COLS)
        ]
        return c.select(
            k.alias("patient_id"),
            F.col("c_name").alias("first_name"),
            F.concat(F.lit("MRN"), k.cast("string")).alias("mrn"),
            gender.alias("gender"),
            ethnicity.alias("ethnicity"),
            F.lower("c_mktsegment").alias("insurance_type"),
            smoking.alias("smoking_status"),
            alcohol.alias("alcohol_use"),
            language.alias("language_preference"),
            ((k * 7) % 124).alias("age"),
            (k % 7).alias("charlson_comorbidity_index"),
            (k % 5).alias("num_prior_admissions"),
            (k % 8).alias("num_prior_ed_visits"),
            (F.col("c_acctbal") / 1000).alias("social_support_score"),
            *flags,
        )

    # -- lineitem roles ----------------------------------------------------
    def _lines(self) -> DataFrame:
        return self.table("lineitem").withColumn(
            "rid", F.col("l_orderkey") * 10 + F.col("l_linenumber")
        )

    def lab_results(self) -> DataFrame:
        l = self._lines()
        flag = _lab_flag()
        return l.select(
            F.col("rid").alias("lab_id"),
            F.col("l_orderkey").alias("admission_id"),
            F.col("l_shipdate").alias("drawn_at"),
            flag.alias("flag"),
            F.struct(*LINE_ORDER).alias("_pos"),
        )

    def medications(self) -> DataFrame:
        l = self._lines()
        p = self.table("part").select("p_partkey", "p_type")
        m = l.join(p, l.l_partkey == p.p_partkey, "left")
        high = _high_alert()
        drug = F.when(F.col("l_linenumber") % 3 == 0, _third_drug()).otherwise(F.col("p_type"))
        return m.select(
            F.col("rid").alias("medication_id"),
            F.col("l_orderkey").alias("admission_id"),
            F.col("l_shipdate").alias("start_datetime"),
            drug.alias("drug_class"),
            high.alias("is_high_alert"),
            F.struct(*LINE_ORDER).alias("_pos"),
        )

    def diagnoses(self) -> DataFrame:
        l = self._lines()
        poa = _poa_flag()
        return l.select(
            F.col("rid").alias("diagnosis_id"),
            F.col("l_orderkey").alias("admission_id"),
            F.concat(F.lit("I"), (F.col("l_partkey") % 100).cast("string")).alias("icd_code"),
            poa.alias("poa_flag"),
            (F.col("l_linenumber") - 1).alias("diagnosis_rank"),
            F.struct(*LINE_ORDER).alias("_pos"),
        )

    def vitals(self) -> DataFrame:
        l = self._lines()
        return l.select(
            F.col("rid").alias("vital_id"),
            F.col("l_orderkey").alias("admission_id"),
            F.col("l_shipdate").alias("measured_at"),
            *_vital_values(),
            F.struct(*LINE_ORDER).alias("_pos"),
        )

    # -- all lineitem roles at once ------------------------------------------
    def line_records(self) -> DataFrame:
        """One row per line item with what labs, medications, diagnoses and
        vitals say of it.  The four roles share key and file order, so one
        de-duplication keeps the same line for all of them; ties within the
        order are lines of one admission that differ in nothing.  Parts that
        repeat a key count as the four roles' de-duplication counts them, by
        their smallest text."""
        cols = ["l_orderkey", "l_linenumber", *LINE_ORDER, "rid"]
        l = dedup_first(self._lines().select(*cols), "rid", [*LINE_ORDER, "l_orderkey", "l_linenumber"])
        p = self.table("part").groupBy("p_partkey").agg(
            F.min(F.struct("p_type"))["p_type"].alias("__plain"), F.min(F.struct(_third_drug().alias("t")))["t"].alias("__third"))
        p = p.select("p_partkey", *[strip_title(c).alias(c) for c in ("__plain", "__third")])
        drug = F.when(F.col("l_linenumber") % 3 == 0, F.col("__third")).otherwise(F.col("__plain"))
        return l.join(p, l.l_partkey == p.p_partkey, "left").select(
            F.col("rid").alias("record_id"),
            F.col("l_orderkey").alias("admission_id"),
            F.col("l_shipdate").alias("measured_at"),
            *_vital_values(),
            _lab_flag().alias("flag"),
            drug.alias("drug_class"),
            _high_alert().alias("is_high_alert"),
            _poa_flag().alias("poa_flag"),
        )

    # -- ED visits ---------------------------------------------------------
    def ed_visits(self) -> DataFrame:
        e = self.table("events")
        return e.select(
            F.col("event_id").alias("ed_visit_id"),
            F.col("user_id").alias("patient_id"),
            F.col("ts").alias("arrival_datetime"),
            (F.col("value") - 2).alias("wait_time_minutes"),
            (F.col("value") / 2 - 1).alias("door_to_doctor_min"),
            F.get_json_object("props", "$.k").cast("double").alias("ed_los_minutes"),
            F.col("event_type").alias("triage_category"),
            (F.col("event_type") == "purchase").cast("int").alias("admitted_from_ed"),
        )

    # -- readmissions ------------------------------------------------------
    def readmissions(self) -> DataFrame:
        o = self._orders_with_next().filter(F.col("next_date").isNotNull())
        k = F.col("o_orderkey")
        return o.select(
            k.alias("readmission_id"),
            F.col("o_custkey").alias("patient_id"),
            F.col("o_orderdate").alias("original_discharge_date"),
            F.col("next_date").alias("readmission_date"),
            (F.datediff(F.to_date("next_date"), F.to_date("o_orderdate")) - 1).cast("long").alias("days_to_readmission"),
            _null_when(k % 7 == 0, (k % 3 == 0).cast("int")).alias("planned_readmission"),
            _null_when(k % 5 == 0, (F.col("o_custkey") % 2 == 0).cast("int")).alias("same_diagnosis"),
        )
