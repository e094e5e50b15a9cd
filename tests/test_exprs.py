"""Hand-made edge tables for the pandas-semantics traps."""

import math

from pyspark.sql import functions as F

from wardline.functions import exprs as X
from wardline.operators import clean as C


def rows(df, col):
    return [r[0] for r in df.select(col).collect()]


def test_clip_keeps_null(spark):  # N1
    df = spark.createDataFrame([(-1.0,), (None,), (5.0,), (12.0,)], "x double")
    assert rows(df.select(X.clip("x", 0).alias("y")), "y") == [0.0, None, 5.0, 12.0]
    assert rows(df.select(X.clip("x", 0, 10).alias("y")), "y") == [0.0, None, 5.0, 10.0]


def test_flag_null_is_false(spark):  # N2
    df = spark.createDataFrame([(None,), (4,), (2,)], "x int")
    assert rows(df.select(X.flag(F.col("x") >= 3).alias("f")), "f") == [0, 1, 0]
    both = X.any_true(F.col("x") >= 3, F.col("x") < 0)
    assert rows(df.select(both.alias("f")), "f") == [0, 1, 0]


def test_np_round_half_even(spark):  # N7, N18
    df = spark.createDataFrame([(0.575,), (0.285,), (2.5,), (-0.5,), (None,)], "x double")
    assert rows(df.select(X.np_round("x", 2).alias("r")), "r")[:2] == [0.57, 0.28]
    assert rows(df.select(X.np_round("x", 0).alias("r")), "r")[2:] == [2.0, -0.0, None]


def test_title_case_like_python(spark):  # N8
    words = [" non-binary ", "SELF-PAY", "o'neil", "5-low", "4-NOT SPECIFIED", "", "abc1def"]
    df = spark.createDataFrame([(w,) for w in words], "s string")
    assert rows(df.select(X.strip_title("s").alias("t")), "t") == [w.strip().title() for w in words]


def test_safe_div(spark):  # N9
    df = spark.createDataFrame([(10.0, 0), (10.0, 4), (None, 2)], "a double, b int")
    assert rows(df.select(X.safe_div("a", "b").alias("q")), "q") == [None, 2.5, None]


def test_coerce_bad_datetime(spark):  # N10
    df = spark.createDataFrame([("2024-01-05 10:00:00",), ("not a date",), (None,)], "d string")
    out = rows(C.coerce_datetimes(df, ["d", "absent"]), "d")
    assert out[0] is not None and out[1] is None and out[2] is None


def test_null_tokens(spark):  # N11
    df = spark.createDataFrame([("None",), ("NA",), (" NA",), ("Heavy",)], "s string")
    assert rows(C.normalise_null_tokens(df), "s") == [None, None, " NA", "Heavy"]


def test_dedup_first_in_order_null_is_one_key(spark):  # N12
    df = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (None, 5, "x"), (None, 2, "y"), (2, 9, "z")],
                               "k int, pos int, v string")
    out = sorted(C.dedup_first(df, "k", ["pos"]).collect(), key=lambda r: (r.k is None, r.k or 0))
    assert [(r.k, r.v) for r in out] == [(1, "a"), (2, "z"), (None, "y")]


def test_cut_right_closed(spark):  # N13
    df = spark.createDataFrame([(0,), (17,), (18,), (120,), (121,), (None,)], "age int")
    labels = rows(df.select(X.cut_right("age", [0, 17, 34, 49, 64, 79, 120],
                                        ["0-17", "18-34", "35-49", "50-64", "65-79", "80+"]).alias("g")), "g")
    assert labels == [None, "0-17", "18-34", "80+", None, None]


def test_weekday_monday_zero(spark):  # N14
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-07",)], "d string").select(F.to_date("d").alias("d"))
    assert rows(df.select(X.weekday("d").alias("w")), "w") == [0, 6]


def test_row_sum_skips_nulls(spark):  # F7, N5
    df = spark.createDataFrame([(1, None, 1), (None, None, None)], "a int, b int, c int")
    assert rows(df.select(X.row_sum(["a", "b", "c"]).alias("s")), "s") == [2.0, 0.0]


def test_corr_constant_is_null(spark):  # N17
    from wardline.operators.profile import corr_matrix

    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, b double")
    m = {(r.x, r.y): r.corr for r in corr_matrix(df, ["a", "b"]).collect()}
    assert m[("a", "b")] is None and m[("b", "b")] is None and m[("a", "a")] == 1.0


def test_null_safe_merge_paths_agree(spark):  # N4
    from wardline.operators.joins import merge

    left = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c"), (3, "d")], "k int, l string")
    right = spark.createDataFrame([(1, 10.0), (None, 99.0), (2, 20.0)], "k int, r double")
    want = sorted(merge(left, right, "k", "left", null_safe=True).collect(), key=str)
    got = sorted(merge(left, right, "k", "left", null_safe=True, right_unique=True).collect(), key=str)
    assert got == want
    assert {(x.l, x.r) for x in got} == {("a", 10.0), ("b", 99.0), ("c", 20.0), ("d", None)}


def test_title_case_random_strings(spark):  # N8, many strings in one pass
    import random

    rng = random.Random(5)
    alphabet = "abcXYZ éÉß-'_ 019\t"
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) for _ in range(500)]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, s string")
    got = {r.i: r.t for r in df.select("i", X.title_case("s").alias("t")).collect()}
    bad = [(w, got[i], w.title()) for i, w in enumerate(words) if got[i] != w.title()]
    assert not bad, bad[:5]
