"""The line items' four roles, cleaned and rolled up together for the master."""

import contextlib
import datetime as dt
import io

import pytest
from pyspark.sql import functions as F

from wardline.operators.joins import merge
from wardline.plans import clinical as K
from wardline.plans.catalog import build_master, features
from wardline.sources.fixtures import DriverTables

LINE = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Repeated and null keys in lines and parts."""
    d = str(tmp_path_factory.mktemp("odd"))
    day = lambda n: dt.datetime(1999, 1, 1) + dt.timedelta(days=n)
    rows = [(o, (o * 7 + n) % 5 or None, (o + n) % 3, n, float(o % 9 + n), 300.0 * n, 0.04, 0.02, "ARN"[(o + n) % 3], "OF"[n % 2], day((o * n) % 4))
            for o in range(1, 12) for n in range(1, 8)]
    rows += rows[::5]  # whole copies
    rows += [(o, p, 1, n, 5.0, 9000.0, 0.1, 0.05, "A", "O", day(n or 0)) for o in (3, 4, None) for n in (2, 3, 7, None) for p in (1, 4, None)]
    rows += [(2, 1, None, 13, None, None, None, None, None, None, None), (3, 2, 1, 3, 1.0, 1.0, 0.0, 0.0, None, "F", None)]  # one id, two orders
    spark.createDataFrame(rows, LINE).repartition(3).write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(1, "steel b"), (1, "STEEL A"), (2, None), (2, "Tin x"), (3, " copper-old "), (None, "none"), (4, "TIN x")],
                          "p_partkey long, p_type string").write.parquet(f"{d}/part.parquet")
    return d


def test_records_equal_the_four_rollups(spark, odd):
    t = DriverTables(spark, odd)
    clean = K.clean_all({r: t.role(r) for r in ("vitals", "lab_results", "medications", "diagnoses")})
    want = K.vitals_features(clean["vitals"])
    for x in (K.lab_features(clean["lab_results"]), K.medication_features(clean["medications"]), K.diagnosis_features(clean["diagnoses"])):
        want = merge(want, x, "admission_id", "outer")
    got = K.record_features(t.line_records())
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in want.schema]
    doubles = [f.name for f in got.schema if f.dataType.simpleString() == "double"]
    settled = [sorted(map(tuple, x.withColumns({c: F.round(c, 8) for c in doubles}).collect()), key=str) for x in (got, want)]
    assert settled[0] == settled[1] and len(settled[0]) == 11


def test_master_reads_the_line_items_once(spark):
    from tests.conftest import SF_SMALL

    def scans(df):
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            df.explain("formatted")
        return out.getvalue().count("lineitem.parquet]")

    assert scans(build_master(spark, SF_SMALL)) == 1
    assert scans(K.integrate(features(spark, SF_SMALL))) == 4  # role by role
