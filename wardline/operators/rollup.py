"""Hash aggregations by one key: multi-stat rollups and first-per-group.

All of them are single ``groupBy(key).agg`` calls, so Spark plans a partial
(map-side) aggregate, one shuffle on the key and a final aggregate; a hot key
leaves every map task as one partial row.  Null keys are dropped first, as
``DataFrame.groupby`` does.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATS = {
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "std": F.stddev_samp,  # n-1; one row → null, like pandas
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),  # all-missing sum is 0
    "count": F.count,
}


def stat_exprs(cols: Iterable[str], stats: Iterable[str] = ("mean", "min", "max", "std")) -> list[Column]:
    """``{col}_{stat}`` aggregate expressions, pandas' naming."""
    return [STATS[s](F.col(c)).alias(f"{c}_{s}") for c in cols for s in stats]


def first_complete(cols: Iterable[str], order: Iterable[str]) -> Column:
    """Struct of ``cols`` from the first row (in ``order``) where all are non-null.

    ``min_by`` ignores rows whose ordering value is null, so incomplete rows
    are masked out of the ordering instead of filtered and joined back.
    """
    cols, order = list(cols), list(order)
    complete = None
    for c in cols:
        cond = F.col(c).isNotNull()
        complete = cond if complete is None else (complete & cond)
    ordering = F.when(complete, F.struct(*[F.col(o) for o in order]))
    return F.min_by(F.struct(*[F.col(c) for c in cols]), ordering)


def rollup(df: DataFrame, key: str | list[str], aggs: Mapping[str, Column] | Iterable[Column]) -> DataFrame:
    """``groupBy(key).agg(...)`` with null keys removed (pandas drops them)."""
    keys = [key] if isinstance(key, str) else list(key)
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else (cond & c)
    exprs = [v.alias(k) for k, v in aggs.items()] if isinstance(aggs, Mapping) else list(aggs)
    return df.filter(cond).groupBy(*keys).agg(*exprs)
