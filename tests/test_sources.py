import os
import tempfile

from pyspark.sql import functions as F

from wardline.sources import tables as TB


def test_read_raw_csv_null_tokens_and_bad_dates(spark):
    d = tempfile.mkdtemp(prefix="wardline-csv-")
    with open(os.path.join(d, "lab_results.csv"), "w") as f:
        f.write("lab_id,admission_id,drawn_at,flag\n1,10,2024-01-01 08:00:00,H\n2,10,garbage,None\n3,,,NA\n")
    raw = TB.read_raw_csv(spark, d, ["lab_results"])["lab_results"]
    from wardline.plans.clinical import clean_lab_results

    rows = {r.lab_id: r for r in clean_lab_results(raw).collect()}
    assert rows[1].flag == "H" and rows[1].drawn_at is not None
    assert rows[2].drawn_at is None and rows[2].flag == "N"   # 'None' is a missing marker
    assert rows[3].admission_id is None and rows[3].flag == "N"


def test_master_sink_roundtrip_and_materialized(spark):
    from wardline.plans.catalog import build_master, master

    sf = "/root/testdata/sf0.001"
    d = tempfile.mkdtemp(prefix="wardline-master-")
    m = build_master(spark, sf)
    TB.write_master(m, d)
    back = TB.read_master(spark, d)
    assert back.count() == m.count() and back.columns == m.columns
    a = master(spark, sf)
    b = master(spark, sf)  # second read comes from the shared folder
    assert a.inputFiles() == b.inputFiles()
    assert a.count() == m.count()


def test_pipeline_save_load(spark):
    from pyspark.ml.classification import LogisticRegressionModel

    from wardline.operators import models as MD

    df = spark.createDataFrame([(float(i % 7), "a" if i % 2 else "b", float(i % 2)) for i in range(60)],
                               "x double, c string, y double")
    prep = MD.fit_features(df, ["x"], ["c"])
    design = prep.transform(df)
    model = MD.logistic("y", None, 60.0).fit(design)
    d = tempfile.mkdtemp(prefix="wardline-model-")
    TB.save_pipeline(prep, model, d)
    prep2, model2 = TB.load_pipeline(spark, d, LogisticRegressionModel)
    p1 = MD.score(model, prep.transform(df), ["x"]).agg(F.sum("probability")).first()[0]
    p2 = MD.score(model2, prep2.transform(df), ["x"]).agg(F.sum("probability")).first()[0]
    assert abs(p1 - p2) < 1e-12


def test_csv_numbers_quotes_and_file_order(spark):
    d = tempfile.mkdtemp(prefix="wardline-csv-")
    with open(os.path.join(d, "medications.csv"), "w") as f:
        f.write('is_high_alert,medication_id,admission_id,drug_class,note\n'
                '1.0,45.0,7,"beta, ""blocker""\nsecond line",x\n'
                'NaN,46,,plain,\n'
                'nan,not a number,8.0,NULL,y\n'
                '0,45.0,9,later copy,z\n')
    raw = TB.read_raw_csv(spark, d, ["medications"])["medications"]
    rows = raw.orderBy("_pos").collect()
    assert [r.medication_id for r in rows] == [45, 46, None, 45]
    assert [r.admission_id for r in rows] == [7, None, 8, 9]
    assert [r.is_high_alert for r in rows] == [1.0, None, None, 0.0]
    assert rows[0].drug_class == 'beta, "blocker"\nsecond line' and rows[2].drug_class is None and rows[1].note is None
    from wardline.plans.clinical import clean_medications

    kept = {r.medication_id: r for r in clean_medications(raw).collect()}
    assert kept[45].admission_id == 7 and set(kept) == {45, 46, None}  # the first row in the file stays


def test_csv_round_trip_rebuilds_the_master(spark):
    from wardline.plans import clinical as K
    from wardline.plans.catalog import features, tables
    from wardline.plans.reports import RAW_COLS

    sf, d = "/root/testdata/sf0.001", tempfile.mkdtemp(prefix="wardline-csv-")
    t = tables(spark, sf)
    for role, cols in RAW_COLS.items():
        order = [K.POS] if K.POS in t.role(role).columns else []
        pdf = t.role(role).orderBy(*order, *cols).select(*cols).toPandas()
        pdf.to_csv(os.path.join(d, f"{role}.csv"), index=False)
    again = K.build_master(TB.read_raw_csv(spark, d))
    want = K.integrate(features(spark, sf))
    cols = ["admission_id", "patient_id", "length_of_stay_days", "num_lab_tests", "num_abnormal_labs", "num_medications", "num_diagnoses",
            "bmi", "age_group", "num_ed_visits", "avg_ed_wait_minutes", "drug_class" if "drug_class" in want.columns else "gender"]
    as_text = lambda df: sorted(str([r[c] if not isinstance(r[c], (int, float)) else round(float(r[c]), 6) for c in cols]) for r in df.select(*cols).collect())
    assert as_text(again) == as_text(want)


def test_stored_table_follows_its_input_and_ignores_unfinished_builds(spark):
    d = tempfile.mkdtemp(prefix="wardline-in-")
    path = f"{d}/t.parquet"
    spark.range(5).write.parquet(path)
    build = lambda: spark.read.parquet(path)
    first = TB.materialized(spark, "probe", [path], build)
    assert first.count() == 5
    spark.range(9).write.mode("overwrite").parquet(path)
    second = TB.materialized(spark, "probe", [path], build)
    assert second.count() == 9
    folder = os.path.dirname(second.inputFiles()[0].removeprefix("file://"))
    os.rename(f"{folder}/_SUCCESS", f"{folder}/_unfinished")
    third = TB.materialized(spark, "probe", [path], build)
    assert third.count() == 9 and third.inputFiles() != second.inputFiles()


def test_checkpoint_folder_is_never_invented_on_a_cluster():
    import pytest

    from wardline.session import checkpoint_dir

    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        checkpoint_dir(Session())
