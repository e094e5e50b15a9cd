"""Cleaning operators: projections, filters and exact scalar rewrites.

Each operator takes column names as parameters and returns a new lazy
DataFrame; none of them triggers a job.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.functions import exprs as X

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
DATETIME = (T.TimestampType, T.TimestampNTZType, T.DateType)
TEXT = (T.StringType,)

# Markers the pandas CSV reader treats as missing (fixed values).
PANDAS_NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]


def present(df: DataFrame, cols: Iterable[str]) -> list[str]:
    have = set(df.columns)
    return [c for c in cols if c in have]


# -- P1 --------------------------------------------------------------------
def coerce_datetimes(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Parse listed columns to timestamps, skip absent ones, bad text → null."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    out = {}
    for c in present(df, cols):
        if isinstance(fields[c], DATETIME):
            continue
        # wall-clock timestamps (no zone), like pandas' naive datetimes
        out[c] = F.try_to_timestamp(F.col(c).cast("string")).cast("timestamp_ntz")
    return df.withColumns(out) if out else df


# -- P2, P3 ----------------------------------------------------------------
def clip_columns(df: DataFrame, bounds: Mapping[str, tuple]) -> DataFrame:
    """``{col: (lower, upper)}``; either bound may be None; null stays null."""
    return df.withColumns({c: X.clip(c, lo, hi) for c, (lo, hi) in bounds.items()})


# -- P4 --------------------------------------------------------------------
def range_to_null(df: DataFrame, ranges: Mapping[str, tuple]) -> DataFrame:
    """Values strictly outside ``[lower, upper]`` become null."""
    out = {}
    for c, (lo, hi) in ranges.items():
        bad = None
        if lo is not None:
            bad = F.col(c) < lo
        if hi is not None:
            bad = (F.col(c) > hi) if bad is None else (bad | (F.col(c) > hi))
        out[c] = F.when(F.coalesce(bad, F.lit(False)), F.lit(None)).otherwise(F.col(c))
    return df.withColumns(out)


# -- P5 --------------------------------------------------------------------
def drop_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop if present; absent names are ignored."""
    return df.drop(*present(df, names))


# -- P6 --------------------------------------------------------------------
def select_dtypes(df: DataFrame, kind: str) -> list[str]:
    """Column names by kind: ``numeric``, ``text``, ``datetime``, ``not_datetime``."""
    kinds = {"numeric": NUMERIC, "text": TEXT, "datetime": DATETIME}
    if kind == "not_datetime":
        return [f.name for f in df.schema.fields if not isinstance(f.dataType, DATETIME)]
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds[kind])]


# -- P7 --------------------------------------------------------------------
def fill_prefix(df: DataFrame, prefix: str, value=0) -> DataFrame:
    cols = [c for c in df.columns if c.startswith(prefix)]
    return df.fillna(value, subset=cols) if cols else df


# -- P8 --------------------------------------------------------------------
def fill_cast_int(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("int") for c in present(df, cols)})


# -- P9 --------------------------------------------------------------------
def fill_constant(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items() if c in df.columns})


# -- P10, P11 --------------------------------------------------------------
def title_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.withColumns({c: X.strip_title(c) for c in present(df, cols)})


def upper_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.withColumns({c: X.strip_upper(c) for c in present(df, cols)})


# -- S2 --------------------------------------------------------------------
def normalise_null_tokens(df: DataFrame, tokens: Iterable[str] = PANDAS_NULL_TOKENS) -> DataFrame:
    tokens = list(tokens)
    return df.withColumns({c: X.null_tokens(c, tokens) for c in select_dtypes(df, "text")})


# -- P12 -------------------------------------------------------------------
def dedup_first(df: DataFrame, key: str, order: Iterable[str] = ()) -> DataFrame:
    """Keep the first row per ``key`` in ``order``; null keys form one group.

    Spark plans ``row_number() = 1`` with a group limit on either side of the
    shuffle: each map task keeps one row per key, so a key holding a third of
    the table never lands whole in one reducer, and every row is sent once.
    The remaining columns extend the order so the choice is deterministic.
    """
    order = list(order)
    w = Window.partitionBy(key).orderBy(*order, *[c for c in df.columns if c not in order and c != key])
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1).drop("__rn")


# -- P13, P15 --------------------------------------------------------------
def complete_cases(df: DataFrame, subset: Iterable[str] | None = None) -> DataFrame:
    return df.dropna(subset=list(subset) if subset else None)


# -- P14 -------------------------------------------------------------------
def keep_top_categories(df: DataFrame, col: str, k: int) -> DataFrame:
    """Rows whose ``col`` is among the ``k`` most frequent values.

    The top-k list is a k-row DataFrame (bounded by ``k``), joined left-semi.
    Ties on the count are broken by the value, ascending.
    """
    top = (
        df.filter(F.col(col).isNotNull())
        .groupBy(col)
        .count()
        .orderBy(F.desc("count"), F.asc(col))
        .limit(k)
        .select(col)
    )
    return df.join(F.broadcast(top), col, "left_semi")


# -- P16 -------------------------------------------------------------------
def seeded_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows chosen by a seeded digest of ``key``; a sampling operator.

    ``orderBy(...).limit(n)`` plans as TakeOrderedAndProject: every task keeps
    its own top ``n`` and only those reach the final merge.
    """
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return df.withColumn("__h", h).orderBy("__h", key).limit(n).drop("__h")


# -- P17 -------------------------------------------------------------------
def map_codes(df: DataFrame, col: str, mapping: Mapping, out: str | None = None, default=None) -> DataFrame:
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    hit = F.try_element_at(m, F.col(col))
    value = F.coalesce(hit, F.lit(default)) if default is not None else hit
    return df.withColumn(out or col, value)
