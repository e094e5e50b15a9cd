"""Spark result == DuckDB oracle on the sf0.001 tables, for every query with SQL.

Set WARDLINE_ORACLE_KEYS=all to sweep every key; by default a
representative subset runs.
"""

import os

import pytest

from check_oracle import compare, duck
from tests.conftest import SF_SMALL

SUBSET = ["master", "clean_vitals", "dedup_first" , "missing_report", "describe", "pivot_rate",
          "daily_series", "seasonal_decompose", "impute_scale", "roc_auc", "risk_flags"]


def keys():
    from wardline.plans.registered import REGISTRY

    if os.environ.get("WARDLINE_ORACLE_KEYS") == "all":
        return [k for k, q in REGISTRY.items() if q.sql]
    return [k for k in SUBSET if k in REGISTRY and REGISTRY[k].sql]


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", keys())
def test_matches_oracle(spark, con, name):
    from wardline.plans.registered import REGISTRY

    ok, msg = compare(spark, con, name, REGISTRY[name], SF_SMALL)
    assert ok, msg
