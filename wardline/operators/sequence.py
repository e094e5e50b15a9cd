"""Per-entity ordering operators that stay safe under key skew."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def next_in_sequence(df: DataFrame, key: str, time: str, tiebreak: str, out: str = "next_time") -> DataFrame:
    """Time of the next row of the same ``key`` in ``(time, tiebreak)`` order.

    A plain ``lead`` over ``partitionBy(key)`` sends every row of a key to one
    task, so a customer holding a third of the rows would be sorted by one
    core.  Instead the rows are first reduced to one per ``(key, time)`` (a
    hash aggregate with map-side combine), the ``lead`` runs over those — at
    most one row per distinct instant of the key — and the answer is joined
    back on ``(key, time)``:

    * another row at the same instant with a larger tiebreak → the next row
      is at the same ``time``;
    * otherwise the next row is at the next distinct instant of the key.
    """
    instants = df.groupBy(key, time).agg(F.max(tiebreak).alias("__tb_max"))
    w = Window.partitionBy(key).orderBy(time)
    instants = instants.withColumn("__t_next", F.lead(time).over(w))
    return (
        df.join(instants, [key, time], "left")
        .withColumn(
            out,
            F.when(F.col(tiebreak) < F.col("__tb_max"), F.col(time)).otherwise(F.col("__t_next")),
        )
        .drop("__tb_max", "__t_next")
    )
