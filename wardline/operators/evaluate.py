"""Classifier and regressor evaluation (E1-E5, M15), as aggregates.

Scores are first reduced to distinct values with class counts; the ROC-AUC
prefix sums then run per score-range bucket (bounded by the number of
distinct scores per bucket) plus one tiny pass over bucket totals, so no
single task sorts all scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions import exprs as X


# -- M15 ---------------------------------------------------------------------
def apply_threshold(df: DataFrame, prob: str, threshold: float = 0.5, out: str = "prediction") -> DataFrame:
    return df.withColumn(out, (F.col(prob) >= threshold).cast("int"))


# -- E1 ----------------------------------------------------------------------
def roc_auc(df: DataFrame, label: str, score: str, buckets: int | None = None, places: int | None = 4) -> DataFrame:
    """Exact ROC-AUC (ties count half): one row ``roc_auc``.

    AUC = Σ_s n1(s)·(N0(< s) + ½·n0(s)) / (N0·N1) over distinct scores s.
    ``buckets``: score ranges, by default one per shuffle partition.
    """
    buckets = buckets or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    base = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
    per = base.groupBy(F.col(score).cast("double").alias("s")).agg(
        F.sum((F.col(label) == 0).cast("long")).alias("n0"),
        F.sum((F.col(label) == 1).cast("long")).alias("n1"),
    )
    probes = [i / buckets for i in range(1, buckets)]
    bounds = per.agg(F.percentile_approx("s", probes, 1000).alias("__b"))
    per = per.crossJoin(F.broadcast(bounds)).withColumn(
        "bucket", F.size(F.filter(F.col("__b"), lambda b: b < F.col("s")))
    ).drop("__b")
    tot = per.groupBy("bucket").agg(F.sum("n0").alias("__b0"))
    tot = tot.withColumn(  # `buckets` rows: the only unpartitioned window
        "__off", F.coalesce(F.sum("__b0").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    local = Window.partitionBy("bucket").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = per.join(F.broadcast(tot.select("bucket", "__off")), "bucket").withColumn(
        "below", F.col("__off") + F.coalesce(F.sum("n0").over(local), F.lit(0))
    )
    agg = ranked.agg(
        F.sum(F.col("n1") * (F.col("below") + 0.5 * F.col("n0"))).alias("__num"),
        F.sum("n0").alias("__n0"),
        F.sum("n1").alias("__n1"),
    )
    auc = F.try_divide(F.col("__num"), F.col("__n0").cast("double") * F.col("__n1"))
    return agg.select((X.np_round(auc, places) if places is not None else auc).alias("roc_auc"))


# -- E3 ----------------------------------------------------------------------
def confusion_counts(df: DataFrame, label: str, pred: str) -> DataFrame:
    """One row: tn, fp, fn, tp."""
    y, p = F.col(label), F.col(pred)
    return df.agg(
        F.sum(((y == 0) & (p == 0)).cast("long")).alias("tn"),
        F.sum(((y == 0) & (p == 1)).cast("long")).alias("fp"),
        F.sum(((y == 1) & (p == 0)).cast("long")).alias("fn"),
        F.sum(((y == 1) & (p == 1)).cast("long")).alias("tp"),
    ).fillna(0)


def confusion_matrix(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Full 2×2 ``(actual, predicted, count)``, zero cells included."""
    c = confusion_counts(df, label, pred)
    cells = [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]
    return c.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(n).alias("count")) for a, p, n in cells
    ])).alias("__c")).select("__c.*")


def _prf(tp, fp, fn):
    prec = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    rec = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))
    return prec, rec, f1


# -- E2 ----------------------------------------------------------------------
def binary_metrics(df: DataFrame, label: str, pred: str, places: int = 4) -> DataFrame:
    """precision, recall, f1 of class 1 (zero denominator → 0) and accuracy."""
    c = confusion_counts(df, label, pred)
    prec, rec, f1 = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    acc = F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))
    return c.select(
        X.np_round(prec, places).alias("precision"),
        X.np_round(rec, places).alias("recall"),
        X.np_round(f1, places).alias("f1"),
        X.np_round(acc, places).alias("accuracy"),
    )


# -- E4 ----------------------------------------------------------------------
def classification_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Rows ``0``, ``1``, ``accuracy``, ``macro avg``, ``weighted avg`` with
    precision, recall, f1 and support (accuracy sits in the f1 column)."""
    c = confusion_counts(df, label, pred)
    tn, fp, fn, tp = (F.col(n) for n in ("tn", "fp", "fn", "tp"))
    p1, r1, f1 = _prf(tp, fp, fn)
    p0, r0, f0 = _prf(tn, fn, fp)
    s0, s1 = tn + fp, tp + fn
    n = s0 + s1
    acc = F.try_divide(tp + tn, n)

    def row(name, p, r, f, s):
        return F.struct(F.lit(name).alias("class"), p.cast("double").alias("precision"),
                        r.cast("double").alias("recall"), f.cast("double").alias("f1"), s.cast("long").alias("support"))

    rows = [
        row("0", p0, r0, f0, s0),
        row("1", p1, r1, f1, s1),
        row("accuracy", F.lit(None), F.lit(None), acc, n),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n),
        row("weighted avg", F.try_divide(p0 * s0 + p1 * s1, n), F.try_divide(r0 * s0 + r1 * s1, n),
            F.try_divide(f0 * s0 + f1 * s1, n), n),
    ]
    return c.select(F.explode(F.array(*rows)).alias("__r")).select("__r.*")


# -- E5 ----------------------------------------------------------------------
def regression_metrics(df: DataFrame, actual: str, pred: str, by: str | None = None) -> DataFrame:
    """MAE, RMSE and R² (1 − SS_res/SS_tot about the mean of the actuals)."""
    keys = [by] if by else []
    e = F.col(actual) - F.col(pred)
    agg = df.filter(F.col(actual).isNotNull() & F.col(pred).isNotNull()).groupBy(*keys).agg(
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.sum(e * e).alias("__ssr"),
        (F.var_pop(actual) * F.count(F.lit(1))).alias("__sst"),
    )
    return agg.select(*keys, "mae", "rmse", (F.lit(1.0) - F.try_divide(F.col("__ssr"), F.col("__sst"))).alias("r2"))
