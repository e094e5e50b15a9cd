"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.session import checkpoint_dir

T = TypeVar("T")

#: Rows of texts that go to a Python worker at once.
BATCH_ROWS = 1_000
#: Upper bound of a driver-side list of range boundaries, whatever the cluster's settings.
MAX_RANGES = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_batches(docs: DataFrame) -> DataFrame:
    """``docs``, with batches of at most ``BATCH_ROWS`` rows going to Python
    workers in this session (long texts make Spark's default of 10,000 heavy);
    a smaller setting is left as it is."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name, "10000")) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return docs


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which all executors see."""
    return f"{checkpoint_dir(spark).rstrip('/')}/wardline-llm/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame, kind: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back, which
    cuts the lineage: a lost executor costs no recomputation of ``df``."""
    path = shared_folder(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranges(spark: SparkSession, per_partition: int = 1) -> int:
    """How many key ranges to cut: a multiple of the shuffle partitions."""
    return min(MAX_RANGES, per_partition * int(spark.conf.get("spark.sql.shuffle.partitions")))


def range_bounds(df: DataFrame, col: str, n: int) -> list[int]:
    """First values of at most ``n`` ranges of about equal row counts, ascending.
    Every bound is a value of ``col``, the first one its minimum; nulls do not
    count.  One column is read, and ``n`` numbers come to the driver."""
    probs = [i / n for i in range(1, n)] or [0.5]
    row = df.agg(F.min(col), F.percentile_approx(col, probs, 10_000)).first()
    return [] if row[0] is None else sorted({row[0], *row[1]}) if n > 1 else [row[0]]


def range_of(col: Column, bounds: list[int]) -> Column:
    """Index of the range that holds the value (nulls: one past the last)."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    every = F.lit(bounds)
    coarse = F.size(F.filter(F.lit(bounds[::step]), lambda b: b <= col)) - 1
    fine = F.size(F.filter(F.slice(every, coarse * step + 1, F.lit(step)), lambda b: b <= col)) - 1
    return F.when(col.isNull(), F.lit(len(bounds))).otherwise(coarse * step + fine).cast("int")


_kept: dict[str, object] = {}


def release_kept() -> None:
    """Let go of what the worker keeps, and of freed memory that it still holds
    (from this stage or from one that kept nothing)."""
    if _kept:
        _kept.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def kept_in_worker(key: str, make: Callable[[], T]) -> T:
    """The one large object that a Python worker keeps between its tasks; one
    of another key takes its place, so that stages do not add up."""
    if key not in _kept:
        release_kept()
        _kept[key] = make()
    return _kept[key]


def strings(column: pa.Array) -> list[str]:
    """Python strings, a null as the empty text."""
    return [x or "" for x in column.to_pylist()]


def row_blocks(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Consecutive row ranges of at most ``most`` bytes each, or of one row."""
    out, start, total = [], 0, 0
    for i, s in enumerate(sizes.tolist()):
        if i > start and total + s > most:
            out.append((start, i))
            start, total = i, 0
        total += s
    if len(sizes) > start:
        out.append((start, len(sizes)))
    return out
