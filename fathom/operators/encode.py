"""Categorical codes and binning, fitted on train and test together.

Fit results are small: a code table per categorical column (its distinct
values) or an edge list per binned column (at most ``n_bins + 1`` numbers).
Code tables are joined back (broadcast when they are counted to be small,
otherwise Spark chooses); edge lists are inlined
as literal arrays, so applying bins is a narrow projection.
"""

from __future__ import annotations

from functools import reduce
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.exprs import col_of
from fathom.operators.ordered import by_range, chunked_row_number, exact_quantiles
from fathom.session import cut_lineage


# ------------------------------------------------------------------ codes
#: Values and bytes up to which a code table, counted, is sent to every task: the coded rows are then not shuffled by their few values.
SMALL_CODES = (50_000, 4_000_000)


def code_tables(values: DataFrame, columns: Sequence[str], order: str = "alphabetical", first_seen: Column | None = None,
                rows_per_chunk: int = 1_000_000) -> dict[str, DataFrame]:
    """For every column: its distinct values -> 0-based integer codes (``value``, ``code``).

    ``alphabetical``: ascending, NULL last (deterministic stand-in for the reference's set order). ``first_seen``: by
    the smallest ``first_seen`` order key of each value. The distinct values of all columns are numbered together: laid out
    by ranges, numbered within a range, plus the totals of the ranges before, so a column may have any number of values.
    """
    seen = first_seen if order == "first_seen" else F.lit(0)
    cells = F.array(*[F.struct(F.lit(i).alias("c"), col_of(c).alias("value")) for i, c in enumerate(columns)])
    d = (values.select(F.explode(cells).alias("s"), seen.alias("first")).groupBy("s.c", "s.value").agg(F.min("first").alias("first")))
    along = [F.col("c"), F.col("first").asc_nulls_last(), F.col("value").asc_nulls_last()]
    d = by_range(cut_lineage(d), along, rows_per_chunk)
    d = cut_lineage(chunked_row_number(d, ["c"], along[1:], F.col("__range"), "code"))
    sizes = {r["c"]: r for r in d.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col("value").cast("string"))).alias("b")).collect()}
    out = {}
    for i, c in enumerate(columns):
        t = d.where(F.col("c") == i).select("value", (F.col("code") - 1).cast("int").alias("code"))
        small = i in sizes and sizes[i]["n"] <= SMALL_CODES[0] and (sizes[i]["b"] or 0) <= SMALL_CODES[1]
        out[c] = F.broadcast(t) if small else t
    return out


def apply_codes(df: DataFrame, column: str, codes: DataFrame, out: str | None = None) -> DataFrame:
    """Replace ``column`` by its code (NULL matches the NULL value's code)."""
    out = out or column
    c = codes.select(F.col("value").alias("__v"), F.col("code").alias("__code"))
    j = df.join(c, col_of(column).eqNullSafe(F.col("__v")), "left")
    keep = [col_of(x) if x != column else F.col("__code").alias(out) for x in df.columns]
    if out != column:
        keep = [col_of(x) for x in df.columns] + [F.col("__code").alias(out)]
    return j.select(*keep)


def shared_codes(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Integer codes shared by train and test over the union of their values.

    All code tables are built from the untouched inputs before any is applied
    (a code table built from an already-coded frame would repeat that frame's
    plan once per column)."""
    only = [col_of(c) for c in columns]
    tables = code_tables(train.select(*only).union(test.select(*only)), columns)
    for c in columns:
        train = apply_codes(train, c, tables[c])
        test = apply_codes(test, c, tables[c])
    return train, test


def first_seen_codes(df: DataFrame, columns: Sequence[str], order_key: Column,
                     missing: str = "Missing") -> DataFrame:
    """Fill NULL with ``missing`` and code values by first appearance along ``order_key``."""
    filled = df.select(*[F.coalesce(col_of(x), F.lit(missing)).alias(x) if x in columns else col_of(x)
                         for x in df.columns])
    tables = code_tables(filled, columns, "first_seen", order_key)
    out = filled
    for c in columns:
        out = apply_codes(out, c, tables[c])
    return out


def distinct_union(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Set union of the distinct values of one column."""
    return a.select(col_of(column).alias(column)).union(b.select(col_of(column).alias(column))).distinct()


# ------------------------------------------------------------------ quantile bins
def fit_quantile_edges(df: DataFrame, columns: Sequence[str], n_bins: int = 10,
                       exact: bool = True, accuracy: int = 100000) -> dict[str, list[float]]:
    """Quantile edges (``n_bins + 1`` probabilities, duplicates dropped) per
    column -- at most ``n_bins + 1`` numbers each, inlined later as literals.

    ``exact`` ranks each column with chunked windows (no task holds a whole
    column); otherwise the mergeable ``percentile_approx`` sketch is used.
    """
    probs = [i / n_bins for i in range(n_bins + 1)]
    if exact:
        qs = exact_quantiles(df, columns, probs)
    else:
        r = df.agg(*[F.percentile_approx(col_of(c).cast("double"), probs, accuracy).alias(f"q{i}")
                     for i, c in enumerate(columns)]).first()
        qs = {c: list(r[f"q{i}"] or []) for i, c in enumerate(columns)}
    out = {}
    for c in columns:
        edges: list[float] = []
        for v in qs[c]:
            if v is not None and (not edges or v != edges[-1]):
                edges.append(float(v))
        out[c] = edges
    return out


def quantile_edges_frame(df: DataFrame, columns: Sequence[str], n_bins: int = 10,
                         exact: bool = True) -> DataFrame:
    """The fitted edges as a table ``(feature, edges)`` (one row per column)."""
    edges = fit_quantile_edges(df, columns, n_bins, exact)
    return df.sparkSession.createDataFrame([(c, edges[c]) for c in columns], "feature string, edges array<double>")


def bin_index(x: Column, edges: Column) -> Column:
    """Right-closed bins ``(e_i, e_{i+1}]`` with the lowest edge included;
    outside the edges or NULL -> NULL; result is the bin index as double."""
    n = F.size(edges)
    lo = F.try_element_at(edges, F.lit(1))
    hi = F.try_element_at(edges, n)
    idx = F.greatest(F.size(F.filter(edges, lambda e: e < x)) - F.lit(1), F.lit(0))
    ok = x.isNotNull() & (n >= 2) & (x >= lo) & (x <= hi)
    return F.when(ok, idx.cast("double"))


def _bin_of(x: Column, edges: Sequence[float]) -> Column:
    """:func:`bin_index` of a few known edges as a sum of comparisons: a lambda over an array is interpreted edge by edge."""
    if not 2 <= len(edges) <= 64:
        return bin_index(x, F.array(*[F.lit(float(e)) for e in edges]) if edges else F.array().cast("array<double>"))
    below = reduce(lambda a, b: a + b, [F.when(F.lit(float(e)) < x, 1).otherwise(0) for e in edges])
    inside = x.isNotNull() & (x >= F.lit(float(edges[0]))) & (x <= F.lit(float(edges[-1])))
    return F.when(inside, F.greatest(below - F.lit(1), F.lit(0)).cast("double"))


def apply_edges(df: DataFrame, edges: Mapping[str, Sequence[float]]) -> DataFrame:
    out = []
    for c in df.columns:
        if c in edges:
            out.append(_bin_of(col_of(c).cast("double"), edges[c]).alias(c))
        else:
            out.append(col_of(c))
    return df.select(*out)


def bin_data(train: DataFrame, test: DataFrame, columns: Sequence[str], n_bins: int = 10,
             exact: bool = True) -> tuple[DataFrame, DataFrame]:
    """Quantile edges over train and test together, applied to both."""
    both = train.select(*[col_of(c) for c in columns]).unionByName(test.select(*[col_of(c) for c in columns])).persist()
    try:
        edges = fit_quantile_edges(both, columns, n_bins, exact)
    finally:
        both.unpersist()
    return apply_edges(train, edges), apply_edges(test, edges)


# ------------------------------------------------------------------ equal-width bins and weights
def equal_width_bin(x: Column, lo: Column, hi: Column, n_bins: int = 10) -> Column:
    """Equal-width bins over [lo, hi], right-closed, lowest included; a constant
    column (hi == lo) falls in a single bin 0."""
    width = (hi - lo) / F.lit(float(n_bins))
    raw = F.ceil(F.try_divide(x - lo, width)) - F.lit(1)
    b = F.least(F.greatest(raw, F.lit(0)), F.lit(n_bins - 1))
    return F.when(x.isNull(), F.lit(None)).when(hi == lo, F.lit(0)).otherwise(b).cast("int")


def fit_range(df: DataFrame, column: str) -> tuple[float | None, float | None]:
    """(min, max) of a column -- a 2-number fit result."""
    r = df.agg(F.min(col_of(column).cast("double")).alias("lo"), F.max(col_of(column).cast("double")).alias("hi")).first()
    return r["lo"], r["hi"]


def inverse_frequency_weights(df: DataFrame, column: str, n_bins: int = 10, out: str = "weight",
                              bin_col: str = "target_bin") -> DataFrame:
    """Row weight ``1 / count(bin)`` divided by its mean over the rows, i.e.
    ``N / (k * n_bin)`` (N non-NULL rows, k non-empty bins); NULL value -> NULL.

    The fit is two tiny aggregates (min/max, then per-bin counts: at most
    ``n_bins`` numbers); both are inlined as literals, so applying the weights
    is a narrow projection with no join.
    """
    x = col_of(column).cast("double")
    lo, hi = fit_range(df, column)
    if lo is None:
        return df.withColumn(bin_col, F.lit(None).cast("int")).withColumn(out, F.lit(None).cast("double"))
    b = equal_width_bin(x, F.lit(lo), F.lit(hi), n_bins)
    counts = {r[0]: r[1] for r in df.select(b.alias("b")).filter(F.col("b").isNotNull())
              .groupBy("b").count().collect()}
    total, k = sum(counts.values()), len(counts)
    weights = F.create_map(*[e for bi, n in sorted(counts.items())
                             for e in (F.lit(bi), F.lit(total / (k * n)))])
    return df.withColumn(bin_col, b).withColumn(out, F.try_element_at(weights, F.col(bin_col)))
