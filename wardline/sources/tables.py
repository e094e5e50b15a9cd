"""Sources and sinks: raw CSV table set, master sink/re-read, run records,
model persistence (S1, S2, S5-S8), and materialised derived tables.

Derived tables live in the shared folder named by ``spark.checkpoint.dir``
(never a machine-local path on a cluster); only builds that Spark has marked
as complete are read, so a lost executor or an interrupted job never leaves a
half-written table that later jobs would read.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.operators.clean import normalise_null_tokens
from wardline.session import checkpoint_dir

S, I, D, TS = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampType()


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# Column sets as the reference's code uses them (see FIXTURES.md §1).
RAW_SCHEMAS = {
    "admissions": _schema(("admission_id", I), ("patient_id", I), ("admission_date", S), ("discharge_date", S),
                          ("original_discharge_date", S), ("length_of_stay_days", D), ("icu_days", D),
                          ("total_charges_usd", D), ("insurance_paid_usd", D), ("readmitted_within_30d", D),
                          ("admission_type", S), ("admission_source", S), ("discharge_disposition", S)),
    "patients": _schema(("patient_id", I), ("date_of_birth", S), ("registered_date", S), ("first_name", S),
                        ("last_name", S), ("mrn", S), ("gender", S), ("ethnicity", S), ("insurance_type", S),
                        ("smoking_status", S), ("alcohol_use", S), ("language_preference", S), ("age", I),
                        ("charlson_comorbidity_index", I), ("num_prior_admissions", I), ("num_prior_ed_visits", I),
                        ("social_support_score", D), ("has_diabetes", I), ("has_hypertension", I),
                        ("has_heart_disease", I), ("has_copd", I), ("has_ckd", I), ("has_depression", I),
                        ("has_obesity", I), ("has_cancer", I)),
    "diagnoses": _schema(("diagnosis_id", I), ("admission_id", I), ("icd_code", S), ("poa_flag", S),
                         ("diagnosis_rank", I)),
    "ed_visits": _schema(("ed_visit_id", I), ("patient_id", I), ("arrival_datetime", S), ("departure_datetime", S),
                         ("wait_time_minutes", D), ("door_to_doctor_min", D), ("ed_los_minutes", D),
                         ("triage_category", S), ("admitted_from_ed", I)),
    "lab_results": _schema(("lab_id", I), ("admission_id", I), ("drawn_at", S), ("flag", S)),
    "medications": _schema(("medication_id", I), ("admission_id", I), ("start_datetime", S), ("end_datetime", S),
                           ("drug_class", S), ("is_high_alert", D)),
    "vitals": _schema(("vital_id", I), ("admission_id", I), ("measured_at", S), ("systolic_bp", D),
                      ("diastolic_bp", D), ("heart_rate", D), ("respiratory_rate", D), ("temperature_c", D),
                      ("spo2_percent", D), ("gcs_score", D), ("news2_score", D), ("pain_score", D),
                      ("weight_kg", D), ("height_cm", D)),
    "readmissions": _schema(("readmission_id", I), ("patient_id", I), ("original_discharge_date", S),
                            ("readmission_date", S), ("days_to_readmission", D), ("planned_readmission", D),
                            ("same_diagnosis", D)),
}


# -- S1, S2 ------------------------------------------------------------------
def read_raw_csv(spark: SparkSession, base_path: str, names=None) -> dict[str, DataFrame]:
    """The raw table set: ``{base_path}/{name}.csv`` with a header.

    Every column is read as text (doubled quotes, and line breaks inside
    quotes, as pandas writes them), pandas' missing markers become null, and
    declared numbers are then cast: integers by way of double, since pandas
    writes an integer column with gaps as ``45.0``.  Text that is no number is
    null.  Datetime columns stay text until the cleaners coerce them; columns
    that are not declared stay text.  ``_pos`` keeps the rows' file order for
    de-duplication."""
    out = {}
    for name in names or RAW_SCHEMAS:
        df = (spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
              .csv(f"{base_path.rstrip('/')}/{name}.csv"))
        pos = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                       F.monotonically_increasing_id().alias("row"))
        df = normalise_null_tokens(df.select("*", pos.alias("_pos")))
        casts = {}
        for f in RAW_SCHEMAS[name]:
            if f.name in df.columns and f.dataType in (I, D):
                number = F.expr(f"try_cast(trim(`{f.name}`) AS double)")
                number = F.when(~F.isnan(number), number)
                casts[f.name] = F.expr(f"try_cast(try_cast(trim(`{f.name}`) AS double) AS bigint)") if f.dataType == I else number
        out[name] = df.withColumns(casts) if casts else df
    return out


# -- S5, S6 ------------------------------------------------------------------
def write_master(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("overwrite").format(fmt).option("header", True).save(path)


def read_master(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).option("header", True).option("inferSchema", fmt == "csv").load(path)


# -- S7 ----------------------------------------------------------------------
RUNS = "wardline-runs"


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) of a path in the shared folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _entry(spark: SparkSession, path: str) -> str | None:
    """A manifest entry's folder, or None while its line is not complete."""
    lines = spark.read.text(path, wholetext=True).collect()  # one short line
    text = lines[0][0] if lines else ""
    return text.strip() if text.endswith("\n") else None


def _entries(spark: SparkSession, root: str) -> dict[str, list[tuple[int, str]]]:
    """Per run key the attempts' entries, by number."""
    fs, folder = _hadoop(spark, f"{root}/manifest")
    found: dict[str, list[tuple[int, str]]] = {}
    for st in fs.listStatus(folder) if fs.exists(folder) else []:
        name = st.getPath().getName()
        if not name.startswith("."):
            key, _, attempt = name.rpartition("-")
            found.setdefault(key, []).append((int(attempt), st.getPath().toString()))
    return {k: sorted(v) for k, v in found.items()}


def committed_runs(spark: SparkSession, root: str, key: str | None = None) -> list[str]:
    """Folders of the committed records: for each key the first complete entry."""
    out = []
    for k, attempts in sorted(_entries(spark, root).items()):
        if key in (None, k):
            out += [f for _, path in attempts if (f := _entry(spark, path))][:1]
    return out


def commit_run(spark: SparkSession, root: str, key: str, folder: str) -> bool:
    """Enter a finished folder under ``key``; False if the key has one already.
    An entry is created exclusively, so of two writers one gets the number; an
    entry that a dead writer left incomplete does not count."""
    attempts = _entries(spark, root).get(key, [])
    if any(_entry(spark, path) for _, path in attempts):
        return False
    fs, path = _hadoop(spark, f"{root}/manifest/{key}-{len(attempts)}")
    fs.mkdirs(path.getParent())
    try:
        out = fs.create(path, False)
    except Exception as e:  # the other writer was first
        if "exist" in str(e).lower():
            return False
        raise
    out.write(bytearray(f"{folder}\n".encode()))
    out.close()
    return True


def append_runs(runs: DataFrame, root: str, key: str | None = None, artifacts: dict[str, DataFrame] | None = None) -> str:
    """Add run records ``(run_name, stage, params map, metrics map)`` to the log
    at ``root``; returns the key.  Records and artifacts (a table per run name)
    are written first, into folders of their own, and count with the manifest
    entry; a job that is run again under its key leaves its first record."""
    spark, run_id = runs.sparkSession, uuid.uuid4().hex
    key, paths = key or run_id, {}
    for name, df in (artifacts or {}).items():
        paths[name] = f"{root}/artifacts/{run_id}/{name}"
        df.write.parquet(paths[name])
    where = F.coalesce(*[F.when(F.col("run_name") == n, F.lit(p)) for n, p in paths.items()], F.lit(None).cast("string"))
    folder = f"{root}/records/{run_id}"
    runs.withColumns({"artifact": where, "run_id": F.lit(run_id), "logged_at": F.current_timestamp()}).write.parquet(folder)
    commit_run(spark, root, key, folder)
    return key


def read_runs(spark: SparkSession, root: str, key: str | None = None) -> DataFrame:
    """The committed records, of one key or all."""
    return spark.read.parquet(*committed_runs(spark, root, key))


def runs_folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{RUNS}"


def log_runs(runs: DataFrame, key: str | None = None, artifacts: dict[str, DataFrame] | None = None) -> DataFrame:
    """Add the records to the log in the shared folder and read them back from it."""
    spark = runs.sparkSession
    return read_runs(spark, runs_folder(spark), append_runs(runs, runs_folder(spark), key, artifacts))


# -- S8 ----------------------------------------------------------------------
def save_pipeline(prep, model, path: str, defaults: DataFrame | None = None) -> None:
    """Feature preparation (fitted parameters + encoder), the model and, for
    serving, the default of every feature."""
    if defaults is not None:
        defaults.write.mode("overwrite").parquet(f"{path}/defaults")
    prep.params.write.mode("overwrite").parquet(f"{path}/params")
    prep.encoder.write().overwrite().save(f"{path}/encoder")
    model.write().overwrite().save(f"{path}/model")
    spark = prep.params.sparkSession
    spark.createDataFrame([(json.dumps({"num": prep.num, "cat": prep.cat}),)], "spec string") \
        .write.mode("overwrite").json(f"{path}/spec")


def load_pipeline(spark: SparkSession, path: str, model_cls):
    from pyspark.ml import PipelineModel

    from wardline.operators.models import FeaturePrep

    spec = json.loads(spark.read.json(f"{path}/spec").first()["spec"])
    prep = FeaturePrep(spec["num"], spec["cat"], spark.read.parquet(f"{path}/params"),
                       PipelineModel.load(f"{path}/encoder"))
    return prep, model_cls.load(f"{path}/model")


def save_forecaster(model, last_days: DataFrame, scale: DataFrame, path: str) -> None:
    """What serving a forecast needs: the boosted regressor, each series' last
    days (their latest date is the last training date) and its scale."""
    model.write().overwrite().save(f"{path}/model")
    last_days.write.mode("overwrite").parquet(f"{path}/last_days")
    scale.write.mode("overwrite").parquet(f"{path}/scale")


def load_forecaster(spark: SparkSession, path: str):
    from pyspark.ml.regression import GBTRegressionModel

    return GBTRegressionModel.load(f"{path}/model"), spark.read.parquet(f"{path}/last_days"), spark.read.parquet(f"{path}/scale")


def serving_folder(spark: SparkSession, kind: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/wardline-serving/{kind}-{uuid.uuid4().hex}"


# -- materialised derived tables -------------------------------------------------
def _code_fingerprint() -> str:
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    h = hashlib.sha256()
    for dirpath, _, files in sorted(os.walk(root)):
        for f in sorted(files):
            if f.endswith(".py"):
                with open(os.path.join(dirpath, f), "rb") as fh:
                    h.update(f.encode() + fh.read())
    return h.hexdigest()[:16]


def input_fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Digest of the names, lengths and change times of all files below the
    paths, listed through Hadoop, so it works on any file system."""
    h = hashlib.sha256()
    conf = spark._jsc.hadoopConfiguration()
    for p in sorted(paths):
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        fs, todo, seen = path.getFileSystem(conf), [path], []
        while todo:
            for st in fs.listStatus(todo.pop()):
                if st.isDirectory():
                    todo.append(st.getPath())
                else:
                    seen.append((st.getPath().toString(), st.getLen(), st.getModificationTime()))
        h.update(repr((p, sorted(seen))).encode())
    return h.hexdigest()[:16]


def materialized(spark: SparkSession, name: str, inputs: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """Read ``name`` from the shared folder if it was built from the same
    inputs by the same code; otherwise build it and read that.

    Every build has a folder of its own and counts only once Spark has written
    its ``_SUCCESS`` file, so a build that was interrupted is never read, and
    nothing is renamed."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/wardline-tables"
    key = f"{name}-{input_fingerprint(spark, inputs)}-{_code_fingerprint()}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    built = [st.getPath().toString() for st in fs.listStatus(path)] if fs.exists(path) else []
    done = sorted(p for p in built if p.rsplit("/", 1)[1].startswith(f"{key}-")
                  and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{p}/_SUCCESS")))
    if not done:
        done = [f"{root}/{key}-{uuid.uuid4().hex}"]
        build().write.parquet(done[0])
    return spark.read.parquet(done[0])
