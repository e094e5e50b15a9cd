"""The run log: one record per key, whoever writes, and artifacts."""

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from wardline.sources import tables as T


def record(spark, name):
    return spark.range(1).select(F.lit(name).alias("run_name"), F.lit("s").alias("stage"), F.create_map(F.lit("a"), F.lit("1")).alias("params"),
                                 F.create_map(F.lit("auc"), F.lit(0.5)).alias("metrics"))


def test_two_writers_and_a_retry_leave_one_record(spark, tmp_path):
    root = str(tmp_path / "runs")
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda n: T.append_runs(record(spark, n), root, "job-1"), ("x", "y")))
    first = T.read_runs(spark, root, "job-1").collect()
    assert len(first) == 1
    T.append_runs(record(spark, "z"), root, "job-1")
    assert T.read_runs(spark, root, "job-1").collect() == first
    T.append_runs(record(spark, "other"), root)
    assert T.read_runs(spark, root).count() == 2


def test_incomplete_entry_does_not_count(spark, tmp_path):
    root = tmp_path / "runs"
    (root / "manifest").mkdir(parents=True)
    (root / "manifest" / "job-0").write_text("")  # a writer that died
    assert T.committed_runs(spark, str(root), "job") == []
    T.append_runs(record(spark, "x"), str(root), "job", {"x": spark.range(3)})
    (row,) = T.read_runs(spark, str(root), "job").collect()
    assert row.run_name == "x" and spark.read.parquet(row.artifact).count() == 3
