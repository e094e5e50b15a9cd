"""Same answers with 1 and 8 shuffle partitions, and with shuffled input rows."""

import pandas as pd
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL


def _rows(df):
    pdf = df.toPandas()
    pdf = pdf[sorted(pdf.columns)]
    return pdf.sort_values(list(pdf.columns)).reset_index(drop=True)


def test_master_independent_of_shuffle_partitions(spark):
    from wardline.plans.catalog import build_master

    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = _rows(build_master(spark, SF_SMALL))
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        eight = _rows(build_master(spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    pd.testing.assert_frame_equal(one, eight)


def test_cleaning_independent_of_row_order(spark):
    from wardline.plans import clinical as K
    from wardline.sources.fixtures import DriverTables

    lab = DriverTables(spark, SF_SMALL).lab_results()
    shuffled = lab.repartition(7).orderBy(F.rand(3))
    a = _rows(K.clean_lab_results(lab))
    b = _rows(K.clean_lab_results(shuffled))
    pd.testing.assert_frame_equal(a, b)
