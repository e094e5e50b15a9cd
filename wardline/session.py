"""Session and lineage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the library relies on.  On a cluster the operator of the cluster
# sets these; ``builder`` only fills what is missing (local runs, tests).
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def builder(master: str = "local[8]", app: str = "wardline", shuffle_partitions: int = 8):
    b = SparkSession.builder.master(master).appName(app)
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    return (
        b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("WARDLINE_DRIVER_MEMORY", "16g"))
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared lineage-cutting folder named by ``spark.checkpoint.dir``.

    On a cluster the setting names a shared (distributed) folder and is used
    as is; without it nothing can be written that all executors see, so that is
    an error.  Only in local mode, as in tests, a folder is created here.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="wardline-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder; survives executor loss."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored_rows(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back: cuts the
    lineage as a checkpoint does, but compressed, and later passes read only the
    columns that they use."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/wardline-rows/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def size_shuffles(spark: SparkSession, paths: list[str], target_bytes: int = 128 << 20,
                  max_partitions: int = 200_000) -> int:
    """Opt-in: size the initial shuffle partition count from the input bytes
    (file listing only, no data read) so that, before AQE coalesces them,
    shuffle partitions hold about ``target_bytes`` each.  Never lowers a
    count the cluster already set higher.  Returns the count in effect."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    total = 0
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        total += path.getFileSystem(conf).getContentSummary(path).getLength()
    want = min(max_partitions, max(1, -(-total // target_bytes)))
    current = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if want > current:
        spark.conf.set("spark.sql.shuffle.partitions", str(want))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(want))
    return max(want, current)
