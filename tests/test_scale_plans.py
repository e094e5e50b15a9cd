"""Plan-shape and hot-key checks for the skew-safe operators."""

import io
import contextlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wardline.operators.clean import dedup_first
from wardline.operators.quantiles import exact_quantiles
from wardline.operators.sequence import next_in_sequence


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def hot_frame(spark, n=30000):
    rng = np.random.default_rng(1)
    key = np.where(rng.random(n) < 1 / 3, 0, rng.integers(1, 2000, n))  # key 0 holds a third of the rows
    day = rng.integers(0, 400, n)
    pdf = pd.DataFrame({"id": np.arange(n), "key": key, "day": day, "v": rng.normal(size=n)})
    pdf["ts"] = pd.Timestamp("2020-01-01") + pd.to_timedelta(pdf.day, unit="D")
    return pdf, spark.createDataFrame(pdf)


def test_dedup_reduces_map_side(spark):
    _, df = hot_frame(spark)
    p = plan(dedup_first(df, "key", ["day", "id"]))
    # one row per key leaves each map task: the limit stands on both sides of the one shuffle
    assert p.count("WindowGroupLimit") >= 2 and "SortAggregate" not in p


def test_dedup_hot_key_correct(spark):
    pdf, df = hot_frame(spark)
    got = {r.key: r.id for r in dedup_first(df, "key", ["day", "id"]).collect()}
    want = pdf.sort_values(["day", "id"]).drop_duplicates("key").set_index("key").id.to_dict()
    assert got == want


def test_next_event_window_runs_on_reduced_rows(spark):
    pdf, df = hot_frame(spark)
    out = next_in_sequence(df, "key", "ts", "id", out="nxt")
    p = plan(out)
    # the window's input is the (key, ts) aggregate, not the raw rows
    assert "Window" in p and "HashAggregate" in p
    got = out.select("id", "nxt").toPandas().set_index("id").nxt
    s = pdf.sort_values(["key", "ts", "id"])
    want = s.groupby("key").ts.shift(-1)
    want.index = s.id
    assert (got.sort_index().fillna(pd.Timestamp(0)) == want.sort_index().fillna(pd.Timestamp(0))).all()


def test_quantiles_never_use_exact_percentile_buffer(spark):
    _, df = hot_frame(spark)
    p = plan(exact_quantiles(df, "v", [0.5], ["key"]))
    assert "percentile_approx" in p and " percentile(" not in p
