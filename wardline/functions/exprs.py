"""Column expressions that reproduce pandas/NumPy semantics exactly.

Every helper returns a ``Column`` built from built-in functions, so it stays
inside whole-stage codegen; none of them is a Python UDF.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: ColumnOrName, lower=None, upper=None) -> Column:
    """``Series.clip``: bounds apply, a missing value stays missing.

    ``greatest(null, 0)`` is 0 in Spark, so the bounds are written as CASE.
    """
    c = col(c)
    out = c
    if lower is not None and upper is not None:
        return F.when(c < lower, F.lit(lower)).when(c > upper, F.lit(upper)).otherwise(c)
    if lower is not None:
        out = F.when(c < lower, F.lit(lower)).otherwise(c)
    if upper is not None:
        out = F.when(c > upper, F.lit(upper)).otherwise(c)
    return out


def flag(cond: Column) -> Column:
    """A comparison where a missing operand counts as False, as 0/1 int."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def np_round(c: ColumnOrName, places: int = 0) -> Column:
    """``Series.round(d)``: scale, round half to even, unscale.

    Spark's ``round`` is half-up and ``bround`` rounds the decimal value, so
    both differ from NumPy on values like 0.575.
    """
    scale = float(10 ** places)
    return F.rint(col(c).cast("double") * F.lit(scale)) / F.lit(scale)


def safe_div(num: ColumnOrName, den: ColumnOrName) -> Column:
    """``a / b.replace(0, NaN)``: a zero denominator gives null, never raises."""
    d = col(den)
    return col(num).cast("double") / F.when(d == 0, F.lit(None)).otherwise(d).cast("double")


def strip(c: ColumnOrName) -> Column:
    """``str.strip()``: removes all leading/trailing whitespace, not just spaces."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def title_case(c: ColumnOrName) -> Column:
    """``str.title()``: a letter is upper-cased when it follows a non-letter.

    ``initcap`` only breaks words at spaces (``Non-binary``); splitting the text
    into letter runs and non-letter runs and capitalising each letter run gives
    ``Non-Binary`` like Python does.
    """
    runs = F.regexp_extract_all(col(c), F.lit(r"\p{L}+|[^\p{L}]+"), 0)
    return F.array_join(F.transform(runs, lambda x: F.initcap(x)), "")


def strip_title(c: ColumnOrName) -> Column:
    return title_case(strip(c))


def strip_upper(c: ColumnOrName) -> Column:
    return F.upper(strip(c))


def null_tokens(c: ColumnOrName, tokens: Iterable[str]) -> Column:
    """Turn CSV missing markers into null, untrimmed as pandas compares them."""
    c = col(c)
    return F.when(c.isin(list(tokens)), F.lit(None)).otherwise(c)


def weekday(c: ColumnOrName) -> Column:
    """``dt.dayofweek``: 0 = Monday … 6 = Sunday."""
    return F.weekday(col(c))


def row_sum(cols: Iterable[ColumnOrName]) -> Column:
    """``df[cols].sum(axis=1)``: missing values are skipped, all missing → 0."""
    total = None
    for c in cols:
        term = F.coalesce(col(c).cast("double"), F.lit(0.0))
        total = term if total is None else total + term
    return total if total is not None else F.lit(0.0)


def any_true(*conds: Column) -> Column:
    """OR of comparisons, each missing operand treated as False."""
    out = None
    for cond in conds:
        term = F.coalesce(cond, F.lit(False))
        out = term if out is None else (out | term)
    return out.cast("int")


def cut_right(c: ColumnOrName, edges: list[float], labels: list[str]) -> Column:
    """``pd.cut(right=True)``: (e0, e1], (e1, e2] …; outside every bin → null.

    ``Bucketizer`` is left-closed and must not be used here.
    """
    c = col(c)
    expr = None
    for lo, hi, label in zip(edges[:-1], edges[1:], labels):
        cond = (c > lo) & (c <= hi)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(None).cast("string"))


def cut_ordinal(c: ColumnOrName, edges: list[float]) -> Column:
    """Integer bin index of :func:`cut_right`, so labels sort in bin order."""
    c = col(c)
    expr = None
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        cond = (c > lo) & (c <= hi)
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr.otherwise(F.lit(None).cast("int"))


def settle(c: ColumnOrName, places: int = 6) -> Column:
    """Round a double for cross-engine comparison (half-even, like NumPy)."""
    return np_round(c, places)
