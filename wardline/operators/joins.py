"""Equi-joins with pandas ``merge`` semantics.

Strategy is left to Catalyst/AQE: a side whose runtime size is under
``spark.sql.adaptive.autoBroadcastJoinThreshold`` is broadcast, anything else
is a sort-merge join.  No side is force-broadcast here, because the right
sides (per-admission or per-patient rollups) grow with the data.  Rollups
come out of their aggregate already hash-partitioned on the join key, so a
chain of left joins on the same key shuffles only the left side, once.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge(
    left: DataFrame,
    right: DataFrame,
    on: str | list[str],
    how: str = "left",
    null_safe: bool = False,
    suffixes: tuple[str, str] = ("_x", "_y"),
    right_unique: bool = False,
) -> DataFrame:
    """``left.merge(right, on=..., how=...)``.

    * equal non-key names get ``_x`` / ``_y`` suffixes (N15);
    * ``null_safe`` matches a null key to a null key, as pandas does (N4);
    * key columns appear once, from the left side (coalesced for outer joins).

    A null-safe equi-join hashes on ``(coalesce(key), isnull(key))`` and so
    re-shuffles both sides.  When the caller knows ``right`` is unique on a
    single key (e.g. it was de-duplicated on it), its null-key part is at
    most one row: the non-null keys then join by a plain equi-join (reusing
    the right side's partitioning) and that one row is attached by a
    broadcast whose size bound is the uniqueness itself.
    """
    keys = [on] if isinstance(on, str) else list(on)
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    l = left.select(*[F.col(c).alias(c + suffixes[0]) if c in clash else F.col(c) for c in left.columns])
    r = right.select(
        *[F.col(c).alias(f"__rk_{c}") if c in keys else (F.col(c).alias(c + suffixes[1]) if c in clash else F.col(c))
          for c in right.columns]
    )
    if null_safe and right_unique and len(keys) == 1 and how in ("left", "left_outer"):
        k, rk = keys[0], f"__rk_{keys[0]}"
        payload = [c for c in r.columns if c != rk]
        j = l.join(r.filter(F.col(rk).isNotNull()), l[k] == F.col(rk), "left").drop(rk)
        null_row = r.filter(F.col(rk).isNull()).select(*[F.col(c).alias(f"__nk_{c}") for c in payload])
        j = j.join(F.broadcast(null_row), F.col(k).isNull(), "left")  # ≤ 1 row: right is unique on k
        return j.select(*l.columns, *[
            F.when(F.col(k).isNull(), F.col(f"__nk_{c}")).otherwise(F.col(c)).alias(c) for c in payload])
    cond = None
    for k in keys:
        term = l[k].eqNullSafe(r[f"__rk_{k}"]) if null_safe else (l[k] == r[f"__rk_{k}"])
        cond = term if cond is None else (cond & term)
    joined = l.join(r, cond, how)
    if how in ("right", "right_outer"):
        joined = joined.withColumns({k: F.col(f"__rk_{k}") for k in keys})
    elif how in ("outer", "full", "full_outer"):
        joined = joined.withColumns({k: F.coalesce(l[k], F.col(f"__rk_{k}")) for k in keys})
    return joined.drop(*[f"__rk_{k}" for k in keys])


def left_chain(base: DataFrame, sides: Iterable[tuple[DataFrame, str]], null_safe: bool = False) -> DataFrame:
    out = base
    for side, key in sides:
        out = merge(out, side, key, "left", null_safe=null_safe)
    return out
