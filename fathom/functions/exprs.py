"""Scalar and row-wise expressions.

Missing values are SQL NULL throughout; NaN and +-inf are turned into NULL at
the edges (``null_if_nonfinite``). Every function returns a ``Column`` built
from built-in functions so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(c: str | Column) -> Column:
    """Column for a name that may contain '-' or '.' (no nested-field parsing)."""
    if isinstance(c, Column):
        return c
    return F.col(f"`{c}`") if not c.startswith("`") else F.col(c)


def safe_div(a: str | Column, b: str | Column) -> Column:
    """a / b, NULL when b is 0 or NULL (ANSI '/' would raise)."""
    return F.try_divide(col_of(a).cast("double"), col_of(b).cast("double"))


def null_if_nonfinite(c: str | Column) -> Column:
    """NaN, +inf, -inf -> NULL."""
    x = col_of(c)
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None)).otherwise(x)


def clip_keep_null(c: str | Column, lower: float, upper: float) -> Column:
    """Clip to [lower, upper]; NULL stays NULL (greatest/least would skip it)."""
    x = col_of(c)
    return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(
        F.least(F.greatest(x, F.lit(lower)), F.lit(upper)))


def age_group(age: str | Column, thresholds: Sequence[float]) -> Column:
    """Index of the first threshold with ``age <= t``; NULL past the last or for NULL age."""
    x = col_of(age)
    expr = None
    for i, t in enumerate(thresholds):
        cond = x <= F.lit(t)
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr.otherwise(F.lit(None).cast("int"))


def rowwise_mean(cols: Iterable[str | Column]) -> Column:
    """Mean over the non-NULL values of a row; NULL if all are NULL."""
    cs = [col_of(c).cast("double") for c in cols]
    total = None
    n = None
    for c in cs:
        s = F.coalesce(c, F.lit(0.0))
        k = F.when(c.isNull(), F.lit(0)).otherwise(F.lit(1))
        total = s if total is None else total + s
        n = k if n is None else n + k
    return F.try_divide(total, n.cast("double"))


def rowwise_min(cols: Iterable[str | Column]) -> Column:
    """Smallest non-NULL value of a row (``least`` skips NULL)."""
    return F.least(*[col_of(c).cast("double") for c in cols])


def rowwise_max(cols: Iterable[str | Column]) -> Column:
    """Largest non-NULL value of a row (``greatest`` skips NULL)."""
    return F.greatest(*[col_of(c).cast("double") for c in cols])


def hours_from_time_of_day(time_of_day_ns: str | Column, ns_per_hour: int) -> Column:
    """Integer hour from nanoseconds since midnight (integer division)."""
    return F.floor(col_of(time_of_day_ns) / F.lit(ns_per_hour)).cast("long")


def hour_of_day(ts: str | Column) -> Column:
    """Hour of a timestamp; timezone-free for TIMESTAMP_NTZ input."""
    return F.hour(col_of(ts))


def ordinal_round(pred: str | Column, cuts: str | Column | Sequence[float]) -> Column:
    """Ordinal class = number of (sorted) cut points with ``pred >= cut``.

    ``cuts`` may be a literal list or an array column; NULL pred -> NULL.
    """
    p = col_of(pred)
    if isinstance(cuts, (list, tuple)):                 # a sum of comparisons: a lambda over an array is interpreted row by row
        return reduce(lambda a, b: a + b, [F.when(p >= F.lit(float(t)), 1).otherwise(0) for t in cuts],
                      F.when(p.isNull(), F.lit(None).cast("int")).otherwise(0))
    arr = F.array_sort(col_of(cuts))
    return F.when(p.isNull(), F.lit(None).cast("int")).otherwise(
        F.size(F.filter(arr, lambda t: p >= t)))


def argmax_index(arr: str | Column) -> Column:
    """0-based position of the (first) largest element of an array column."""
    a = col_of(arr)
    return (F.array_position(a, F.array_max(a)) - F.lit(1)).cast("int")


def round_half_even(c: str | Column, scale: int = 0) -> Column:
    """Banker's rounding (what numpy/pandas do)."""
    return F.bround(col_of(c), scale)


def split_key_value(c: str | Column, sep: str = "=") -> Column:
    """Value part of a ``name=value`` path component."""
    return F.split(col_of(c), sep, 2).getItem(1)
