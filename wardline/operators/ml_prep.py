"""Model preparation: splits, folds, imputation, scaling, defaults, weights.

Splits and folds rank the rows of every class by a seeded digest of the row
id, so they are deterministic, hold exact shares of each class, and can be
written as ``row_number()`` in any SQL engine.  Every fitted statistic (median,
mode, mean, std) is an aggregate over the training rows; the fitted values
are one-row DataFrames (their size is the number of feature columns, not of
rows), read back before rows are filled and scaled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.operators.quantiles import column_quantiles

#: Columns whose moments share one aggregate: code for many more is too long
#: for the JVM to compile.
MOMENT_COLUMNS = 8
BUCKET_DIGITS = 3  # leading hex digits of the draw: 4,096 buckets per class


def draw(id_col: str, seed: int) -> Column:
    """A seeded digest of the id; different seeds give independent orders."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))


def stratified_parts(df: DataFrame, id_col: str, label: str, shares: Sequence[float], seed: int, out: str) -> DataFrame:
    """Adds the integer ``out``: with ``n`` rows of a class ranked by
    ``draw``, how many of the cuts ``floor(n * share + 0.5)`` a row's rank has
    reached.  Class sizes are exact; a missing label is a class of its own.

    No class is sorted: rows are counted per (class, leading digits of the
    draw), and only the buckets that a cut falls into (one per cut) are ranked
    to find the row that each cut begins with.  Both passes read the id and the
    label alone.  The cut rows, a few per class, are broadcast, and every row
    compares itself with them, so ``df`` is read once more and no branch of it
    repeats.  Rows that repeat an id stay together.
    """
    own = df.select(F.col(label).alias("__l"), F.col(id_col).alias("__i"), draw(id_col, seed).alias("__d"))
    own = own.withColumn("__k", F.substring("__d", 1, BUCKET_DIGITS))
    counts = own.groupBy("__l", "__k").agg(F.count(F.lit(1)).alias("__c"))
    before = Window.partitionBy("__l").orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)
    n = F.sum("__c").over(Window.partitionBy("__l"))
    cuts = F.array(*[F.floor(n * F.lit(float(s)) + 0.5) for s in shares])
    buckets = counts.withColumns({"__start": F.coalesce(F.sum("__c").over(before), F.lit(0)), "__cuts": cuts})
    inside = F.filter("__cuts", lambda m: (m >= F.col("__start")) & (m < F.col("__start") + F.col("__c")))
    buckets = buckets.withColumn("__cuts", inside).where(F.size("__cuts") > 0).select(F.col("__l").alias("__bl"), F.col("__k").alias("__bk"), "__start", "__cuts")
    ranked = own.join(F.broadcast(buckets), F.col("__l").eqNullSafe(F.col("__bl")) & (F.col("__k") == F.col("__bk")))
    rank = F.col("__start") + F.row_number().over(Window.partitionBy("__l", "__k").orderBy("__d", "__i")) - 1
    starts = ranked.withColumn("__r", rank).withColumn("__cut", F.explode("__cuts")).where("__r = __cut")
    starts = starts.groupBy("__l").agg(F.collect_list(F.struct("__d", "__i")).alias("__starts"))  # one entry per cut
    j = df.join(F.broadcast(starts), F.col(label).eqNullSafe(F.col("__l")), "left")
    here = F.struct(draw(id_col, seed).alias("__d"), F.col(id_col).alias("__i"))
    reached = F.size(F.filter("__starts", lambda m: m <= here))
    # a cut at 0 or past the last row has no row of its own
    return j.withColumn(out, F.when(F.col("__starts").isNull(), 0).otherwise(reached)).select(*df.columns, out)


# -- T1 ----------------------------------------------------------------------
def stratified_split(df: DataFrame, id_col: str, label: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``split`` ∈ {train, test}: ``floor(n * (1 - test_size) + 0.5)``
    rows of every class are train."""
    parts = stratified_parts(df, id_col, label, [1 - test_size], seed, "__part")
    return parts.withColumn("split", F.when(F.col("__part") == 0, "train").otherwise("test")).drop("__part")


# -- T3 ----------------------------------------------------------------------
def assign_folds(df: DataFrame, id_col: str, label: str, k: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """Integer fold ``0..k-1``, equal shares of every class, from a draw that
    is independent of the split's."""
    return stratified_parts(df, id_col, label, [j / k for j in range(1, k)], seed + 1, out)


# -- P6 helpers ----------------------------------------------------------------
def feature_columns(df: DataFrame, drop: Sequence[str]) -> tuple[list[str], list[str]]:
    """Numeric and categorical feature names after dropping ``drop`` and
    every datetime column (dtype selection over the schema)."""
    from wardline.operators.clean import select_dtypes

    keep = [c for c in select_dtypes(df, "not_datetime") if c not in set(drop)]
    num = [c for c in select_dtypes(df, "numeric") if c in keep]
    cat = [c for c in select_dtypes(df, "text") if c in keep]
    return num, cat


# -- M1, M2, M6 ----------------------------------------------------------------
def medians(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(feature, median)`` — exact, linear interpolation, nulls ignored."""
    return column_quantiles(df, cols, [0.5], ["median"])


def modes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(feature, mode)`` — most frequent non-null value, ties → smallest.

    Two-stage: counts per (feature, value) with map-side combine, then the
    arg-max per feature; no group ever holds the raw rows.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value"))
                                for c in cols])).alias("__p")
    per = (df.select(pairs).select("__p.*").filter(F.col("value").isNotNull())
           .groupBy("feature", "value").agg(F.count(F.lit(1)).alias("__c")))
    return per.groupBy("feature").agg(F.min_by("value", F.struct(-F.col("__c"), F.col("value"))).alias("mode"))


def feature_defaults(df: DataFrame, num: Sequence[str], cat: Sequence[str]) -> DataFrame:
    """M6: ``(feature, num_default, cat_default)`` over all rows."""
    m = medians(df, num).select("feature", F.col("median").alias("num_default"), F.lit(None).cast("string").alias("cat_default"))
    if not cat:
        return m
    c = modes(df, cat).select("feature", F.lit(None).cast("double").alias("num_default"), F.col("mode").alias("cat_default"))
    return m.unionByName(c)


# -- M1-M3 -------------------------------------------------------------------
def fit_impute_scale(train: DataFrame, num: Sequence[str], cat: Sequence[str] = ()) -> DataFrame:
    """Fitted parameters as one row: ``{c}__med``, ``{c}__mean``, ``{c}__std``
    for numeric and ``{c}__mode`` for categorical columns.

    Median impute, then standardise with the population std of the imputed
    training column (a zero std scales by 1), as the reference's pipeline.
    """
    fitted: dict[str, float | str | None] = {}
    med = {r["feature"]: r["median"] for r in medians(train, num).collect()}
    for k in range(0, len(num), MOMENT_COLUMNS):
        some = num[k:k + MOMENT_COLUMNS]
        filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(med.get(c)).cast("double")) for c in some}
        row = train.agg(*[F.avg(v).alias(f"{c}__mean") for c, v in filled.items()],
                        *[F.stddev_pop(v).alias(f"{c}__std") for c, v in filled.items()]).first()
        fitted |= {f"{c}__med": med.get(c) for c in some} | row.asDict()
    if cat:
        mode = {r["feature"]: r["mode"] for r in modes(train, cat).collect()}
        fitted |= {f"{c}__mode": mode.get(c) for c in cat}
    names = [f"{c}__{s}" for s in ("med", "mean", "std") for c in num] + [f"{c}__mode" for c in cat]
    schema = ", ".join(f"`{n}` {'string' if n.endswith('__mode') else 'double'}" for n in names)
    return train.sparkSession.createDataFrame([tuple(fitted[n] for n in names)], schema)


def apply_impute_scale(df: DataFrame, params: DataFrame, num: Sequence[str], cat: Sequence[str] = ()) -> DataFrame:
    """Applies :func:`fit_impute_scale` output: one row, whose values stand in
    the expressions, so that no row of ``df`` is widened by them."""
    p = params.first()
    number = lambda name: F.lit(p[name]).cast("double")
    out = {}
    for c in num:
        scale = F.lit(1.0) if p[f"{c}__std"] in (None, 0.0) else number(f"{c}__std")
        out[c] = (F.coalesce(F.col(c).cast("double"), number(f"{c}__med")) - number(f"{c}__mean")) / scale
    for c in cat:
        out[c] = F.coalesce(F.col(c), F.lit(p[f"{c}__mode"]).cast("string"))
    return df.withColumns(out)


# -- M7, M8 ------------------------------------------------------------------
def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights ``n / (2 n_c)`` and the positive weight ``n0 / n1``."""
    y = F.col(label)
    n0 = F.sum((y == 0).cast("long"))
    n1 = F.sum((y == 1).cast("long"))
    n = F.count(y)
    return df.agg(
        n.alias("n"), n0.alias("n_0"), n1.alias("n_1"),
        F.try_divide(n, 2 * n0).alias("weight_0"),
        F.try_divide(n, 2 * n1).alias("weight_1"),
        F.try_divide(n0, n1).alias("pos_weight"),
    )


def with_weights(df: DataFrame, label: str, weights: DataFrame, out: str = "weight") -> DataFrame:
    w = weights.select("weight_0", "weight_1")
    return df.crossJoin(F.broadcast(w)).withColumn(
        out, F.when(F.col(label) == 1, F.col("weight_1")).otherwise(F.col("weight_0"))
    ).drop("weight_0", "weight_1")


def majority_class(df: DataFrame, label: str) -> DataFrame:
    """Most frequent label of ``df`` (ties → smallest): one row ``majority``."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("__c"))
    return counts.agg(F.min_by(label, F.struct(-F.col("__c"), F.col(label))).alias("majority"))
