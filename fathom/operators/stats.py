"""Table-level statistics and feature selection.

Everything that scans the data is one distributed aggregate (or a
partial-aggregated ``groupBy``); windows only ever run over per-feature
tables whose size is the number of features, or over chunked prefix sums.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.exprs import col_of
from fathom.operators.encode import bin_index, fit_quantile_edges
from fathom.operators.ordered import by_range

# ------------------------------------------------------------------ basics


def column_means(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Column means ignoring NULL (a 1-row fit result)."""
    r = df.agg(*[F.avg(col_of(c).cast("double")).alias(c) for c in columns]).first()
    return {c: r[c] for c in columns}


def fill_with(df: DataFrame, values: dict[str, float | None]) -> DataFrame:
    """``coalesce(c, value)`` for every column in ``values``."""
    return df.select(*[F.coalesce(col_of(c), F.lit(values[c])).alias(c)
                       if c in values and values[c] is not None else col_of(c) for c in df.columns])


def fill_means(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Fill NULL with the column mean (of ``fit_on``, default ``df`` itself)."""
    return fill_with(df, column_means(fit_on if fit_on is not None else df, columns))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(col_of(column).alias(column)).agg(F.count(F.lit(1)).alias("count"))


def _long(one_row: DataFrame, pairs: list[tuple[str, Column]], name: str = "feature",
          value: str = "importance") -> DataFrame:
    """Unpivot a 1-row frame of per-feature values into ``(feature, value)``."""
    arr = F.array(*[F.struct(F.lit(f).alias(name), e.cast("double").alias(value)) for f, e in pairs])
    return one_row.select(F.explode(arr).alias("s")).select(f"s.{name}", f"s.{value}")


# ------------------------------------------------------------------ correlation
def corr_importance(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """|Pearson r| of each feature with the target on pairwise-complete rows;
    NULL for a constant column (no ANSI divide-by-zero)."""
    y = col_of(target).cast("double")
    aggs = []
    for i, f in enumerate(features):
        x = col_of(f).cast("double")
        both = x.isNotNull() & y.isNotNull()
        xm, ym = F.when(both, x), F.when(both, y)
        aggs += [F.covar_samp(xm, ym).alias(f"c{i}"), F.stddev_samp(xm).alias(f"sx{i}"),
                 F.stddev_samp(ym).alias(f"sy{i}")]
    one = df.agg(*aggs)
    pairs = [(f, F.abs(F.try_divide(F.col(f"c{i}"), F.col(f"sx{i}") * F.col(f"sy{i}"))))
             for i, f in enumerate(features)]
    return _long(one, pairs)


def importance_rank(importance: DataFrame, value: str = "importance", feature: str = "feature") -> DataFrame:
    """Ascending order of importance (NULL last, ties by name) as a ``rank``
    column. The window runs over one row per feature."""
    w = Window.orderBy(F.col(value).asc_nulls_last(), F.col(feature))
    return importance.withColumn("rank", F.row_number().over(w).cast("int"))


# ------------------------------------------------------------------ mutual information
def mutual_information(df: DataFrame, target: str, features: Sequence[str], n_bins: int = 10,
                       normalise: bool = True) -> DataFrame:
    """Mutual information (nats) between each quantile-binned feature and a
    discrete target, min-max normalised over the features.

    Rows are unpivoted to ``(feature, bin, class)`` and counted with partial
    aggregation, so the shuffle carries at most features x bins x classes
    groups per task. Rows with a NULL feature or target are skipped.
    """
    edges = fit_quantile_edges(df.filter(col_of(target).isNotNull()), features, n_bins)
    y = col_of(target)
    cells = F.array(*[F.struct(F.lit(f).alias("feature"),
                               bin_index(col_of(f).cast("double"),
                                         F.array(*[F.lit(e) for e in edges[f]]) if edges[f]
                                         else F.array().cast("array<double>")).alias("bx"))
                      for f in features])
    long = (df.filter(y.isNotNull()).select(y.alias("__y"), F.explode(cells).alias("s"))
              .select("s.feature", "s.bx", "__y").filter(F.col("bx").isNotNull()))
    joint = long.groupBy("feature", "bx", "__y").agg(F.count(F.lit(1)).cast("double").alias("nxy"))
    wf = Window.partitionBy("feature")
    t = (joint.withColumn("n", F.sum("nxy").over(wf))
              .withColumn("nx", F.sum("nxy").over(Window.partitionBy("feature", "bx")))
              .withColumn("ny", F.sum("nxy").over(Window.partitionBy("feature", "__y"))))
    term = (F.col("nxy") / F.col("n")) * F.log((F.col("nxy") * F.col("n")) / (F.col("nx") * F.col("ny")))
    mi = t.groupBy("feature").agg(F.sum(term).alias("mi"))
    if not normalise:
        return mi.withColumnRenamed("mi", "importance")
    w = Window.partitionBy(F.lit(0))  # one row per feature
    lo, hi = F.min("mi").over(w), F.max("mi").over(w)
    return mi.select("feature", F.when(hi > lo, (F.col("mi") - lo) / (hi - lo)).otherwise(F.lit(0.0)).alias("importance"))


# ------------------------------------------------------------------ Kendall tau and FDR
# FIXED VALUES: coefficients of the complementary error function approximation
# erfc(z) ~ t * exp(-z^2 + P(t)), t = 1 / (1 + z / 2), fractional error < 1.2e-7
ERFC_COEFFS = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
               0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def erfc_expr(z: Column) -> Column:
    """Complementary error function for z >= 0 (Horner form, JVM-side)."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * z)
    poly = F.lit(ERFC_COEFFS[-1])
    for c in reversed(ERFC_COEFFS[:-1]):
        poly = F.lit(c) + t * poly
    return t * F.exp(-z * z + poly)


#: Classes that a target may have where its values are handled one by one.
MAX_CLASSES = 1000


def _classes(df: DataFrame, y: Column) -> list:
    """Distinct values of an ordinal target; raises where it is no such target."""
    seen = [r[0] for r in df.filter(y.isNotNull()).select(y).distinct().limit(MAX_CLASSES + 1).collect()]
    if len(seen) > MAX_CLASSES:
        raise ValueError(f"the target has more than {MAX_CLASSES} values; it is not ordinal")
    return sorted(seen)


def kendall_tau(df: DataFrame, target: str, features: Sequence[str], rows_per_chunk: int = 1_000_000) -> DataFrame:
    """Kendall's tau-b of every feature with a discrete (ordinal) target, with
    the tie-corrected asymptotic two-sided p-value.

    ``S = C - D`` is computed from counts by (feature, x, class): for each
    distinct x, ``sum_b n_b(x) * sum_{a<b} (2 L_a(x) + n_a(x) - N_a)`` where
    ``L_a(x)`` is the number of class-a rows with a smaller x. ``L_a`` is a
    prefix sum over x, done inside ranges of x plus the offsets of the ranges
    before, so no task holds a whole feature.
    Rows with a NULL feature or target are skipped (pairwise complete).
    """
    y = col_of(target)
    classes = _classes(df, y)
    K = len(classes)
    cls_idx = F.lit(None).cast("int")
    for i, c in enumerate(classes):
        cls_idx = F.when(y == F.lit(c), F.lit(i)).otherwise(cls_idx)
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), col_of(f).cast("double").alias("x")) for f in features])
    long = (df.select(cls_idx.alias("cls"), F.explode(cells).alias("s"))
              .select("s.feature", "s.x", "cls").filter(F.col("x").isNotNull() & F.col("cls").isNotNull()))
    # counts per distinct x, one column per class (partial aggregation map-side)
    cnt = long.groupBy("feature", "x").agg(*[F.sum(F.when(F.col("cls") == i, 1).otherwise(0)).cast("double").alias(f"n{i}")
                                             for i in range(K)])
    rows = df.count()
    cnt = by_range(cnt, ["feature", "x"], rows_per_chunk, "ch", rows * len(features) if rows > rows_per_chunk else 0)
    # chunked prefix sums: L_a(x) = rows of class a with smaller x in the same feature
    w_in = Window.partitionBy("feature", "ch").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    for i in range(K):
        cnt = cnt.withColumn(f"l{i}", F.coalesce(F.sum(f"n{i}").over(w_in), F.lit(0.0)))
    chunk_tot = cnt.groupBy("feature", "ch").agg(*[F.sum(f"n{i}").alias(f"t{i}") for i in range(K)])
    w_ch = Window.partitionBy("feature").orderBy("ch").rowsBetween(Window.unboundedPreceding, -1)
    chunk_off = chunk_tot.select("feature", "ch", *[F.coalesce(F.sum(f"t{i}").over(w_ch), F.lit(0.0)).alias(f"o{i}")
                                                    for i in range(K)])
    cnt = cnt.join(chunk_off, ["feature", "ch"])          # a row per range: cnt is already dealt out by these two
    totals = chunk_tot.groupBy("feature").agg(*[F.sum(f"t{i}").alias(f"tot{i}") for i in range(K)])
    cnt = cnt.join(F.broadcast(totals), "feature")
    s_terms = None
    for b in range(1, K):
        inner = None
        for a in range(b):
            term = F.lit(2.0) * (F.col(f"l{a}") + F.col(f"o{a}")) + F.col(f"n{a}") - F.col(f"tot{a}")
            inner = term if inner is None else inner + term
        part = F.col(f"n{b}") * inner
        s_terms = part if s_terms is None else s_terms + part
    tx = sum((F.col(f"n{i}") for i in range(1, K)), F.col("n0")) if K else F.lit(0.0)
    per_x = cnt.select("feature", (s_terms if s_terms is not None else F.lit(0.0)).alias("s"), tx.alias("t"),
                       *[F.col(f"tot{i}") for i in range(K)])
    agg = per_x.groupBy("feature").agg(
        F.sum("s").alias("S"), F.sum("t").alias("n"),
        F.sum(F.col("t") * (F.col("t") - 1) / 2).alias("xtie"),
        F.sum(F.col("t") * (F.col("t") - 1) * (F.col("t") - 2)).alias("x0"),
        F.sum(F.col("t") * (F.col("t") - 1) * (F.lit(2.0) * F.col("t") + 5)).alias("x1"),
        *[F.first(f"tot{i}").alias(f"tot{i}") for i in range(K)])
    Ns = [F.col(f"tot{i}") for i in range(K)]
    ytie = sum((u * (u - 1) / 2 for u in Ns[1:]), Ns[0] * (Ns[0] - 1) / 2)
    y0 = sum((u * (u - 1) * (u - 2) for u in Ns[1:]), Ns[0] * (Ns[0] - 1) * (Ns[0] - 2))
    y1 = sum((u * (u - 1) * (F.lit(2.0) * u + 5) for u in Ns[1:]), Ns[0] * (Ns[0] - 1) * (F.lit(2.0) * Ns[0] + 5))
    n = F.col("n")
    tot = n * (n - 1) / 2
    tau = F.try_divide(F.col("S"), F.sqrt(tot - F.col("xtie")) * F.sqrt(tot - ytie))
    m = n * (n - 1)
    var = ((m * (F.lit(2.0) * n + 5) - F.col("x1") - y1) / 18
           + F.try_divide(F.lit(2.0) * F.col("xtie") * ytie, m)
           + F.try_divide(F.col("x0") * y0, F.lit(9.0) * m * (n - 2)))
    z = F.try_divide(F.col("S"), F.sqrt(var))
    p = F.when(z.isNotNull() & tau.isNotNull(), F.least(F.lit(1.0), erfc_expr(F.abs(z) / F.lit(math.sqrt(2.0)))))
    return agg.select("feature", tau.alias("tau"), p.alias("p_value"))


def ks_binary(df: DataFrame, target: str, features: Sequence[str], terms: int = 100) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov test of the ordinal target between the two groups of every binary
    feature: statistic ``D`` and the asymptotic two-sided p-value. A feature without two groups
    has NULLs. Counts per (feature, class) combine map-side; the cumulative step is over classes."""
    y = col_of(target)
    classes = _classes(df, y)
    xs = [col_of(f).cast("double") for f in features]
    ends = df.filter(y.isNotNull()).agg(*[F.min(x).alias(f"a{i}") for i, x in enumerate(xs)],
                                        *[F.max(x).alias(f"b{i}") for i, x in enumerate(xs)]).first()
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.when(x == F.lit(ends[f"b{i}"]), 1).when(x == F.lit(ends[f"a{i}"]), 0)
                               .alias("g")) for i, (f, x) in enumerate(zip(features, xs))])
    counts = (df.filter(y.isNotNull()).select(y.alias("y"), F.explode(cells).alias("s")).select("y", "s.feature", "s.g")
              .groupBy("feature").agg(*[F.sum(F.when((F.col("g") == g) & (F.col("y") == F.lit(c)), 1).otherwise(0)).cast("double")
                                        .alias(f"n{g}_{k}") for g in (0, 1) for k, c in enumerate(classes)]))
    n0, n1 = (reduce(lambda a, b: a + b, [F.col(f"n{g}_{k}") for k in range(len(classes))], F.lit(0.0)) for g in (0, 1))
    gaps, c0, c1 = [], F.lit(0.0), F.lit(0.0)
    for k in range(len(classes)):
        c0, c1 = c0 + F.col(f"n0_{k}"), c1 + F.col(f"n1_{k}")
        gaps.append(F.abs(F.try_divide(c0, n0) - F.try_divide(c1, n1)))
    d = reduce(lambda a, b: F.when(b > a, b).otherwise(a), gaps, F.lit(0.0))
    out = counts.select("feature", F.when((n0 > 0) & (n1 > 0), d).alias("D"), F.try_divide(n0 * n1, n0 + n1).alias("m"))
    square = F.col("m") * F.col("D") * F.col("D")
    tail = reduce(lambda a, b: a + b, [F.lit(2.0 * (-1) ** (k - 1)) * F.exp(F.lit(-2.0 * k * k) * square)
                                       for k in range(1, terms + 1)])
    p = F.when(F.col("D").isNotNull(), F.when(square < 0.04, F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), tail))))
    return out.select("feature", "D", p.alias("p_value"))


def binary_features(df: DataFrame, features: Sequence[str]) -> list[str]:
    """Features with exactly two values (NULLs aside): ends in one pass, whether anything lies between them in another."""
    xs = [col_of(f).cast("double") for f in features]
    ends = df.agg(*[F.min(x).alias(f"a{i}") for i, x in enumerate(xs)], *[F.max(x).alias(f"b{i}") for i, x in enumerate(xs)]).first()
    two = [i for i in range(len(xs)) if ends[f"a{i}"] is not None and ends[f"a{i}"] < ends[f"b{i}"]]
    if not two:
        return []
    inside = df.agg(*[F.max((xs[i] != F.lit(ends[f"a{i}"])) & (xs[i] != F.lit(ends[f"b{i}"]))).alias(f"m{i}") for i in two]).first()
    return [list(features)[i] for i in two if not inside[f"m{i}"]]


def relevance(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """``feature`` and ``p_value`` of its test against an ordinal target: Kolmogorov-Smirnov for a feature of two values,
    Kendall's tau for any other."""
    two = binary_features(df, features)
    rest = [f for f in features if f not in two]
    parts = [t.select("feature", "p_value") for t in ([kendall_tau(df, target, rest)] if rest else []) + ([ks_binary(df, target, two)] if two else [])]
    return reduce(DataFrame.unionByName, parts)


def fdr_select(pvalues: DataFrame, fdr_level: float = 0.05, independent: bool = False,
               feature: str = "feature", p: str = "p_value") -> DataFrame:
    """Benjamini-Hochberg / -Yekutieli step-up: with the ``m`` p-values in order, the features up to the
    last rank ``k`` with ``p <= k q / (m C)`` are relevant; ``C = 1``, or ``sum_{i<=m} 1/i`` under any
    dependence. Features with a NULL p-value are not tested and not relevant.
    Windows run over one row per feature."""
    tested = pvalues.filter(col_of(p).isNotNull())
    d = tested.withColumn("k", F.row_number().over(Window.orderBy(col_of(p), col_of(feature))))
    every = Window.partitionBy(F.lit(0))
    d = d.withColumn("m", F.count(F.lit(1)).over(every))
    c = F.lit(1.0) if independent else F.sum(F.lit(1.0) / F.col("k")).over(every)
    d = d.withColumn("last", F.max(F.when(col_of(p) <= F.lit(fdr_level) * F.col("k") / (F.col("m") * c), F.col("k"))).over(every))
    d = d.withColumn("relevant", F.coalesce(F.col("k") <= F.col("last"), F.lit(False)))
    untested = pvalues.filter(col_of(p).isNull()).select(col_of(feature), col_of(p), F.lit(False).alias("relevant"))
    return d.select(col_of(feature), col_of(p), "relevant").unionByName(untested)


# ------------------------------------------------------------------ conditional missing share
def missing_share(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """For every ordered pair (f, g), f != g: among rows where f is NULL, the
    share where g is NULL too. Rows emit only pairs of their own NULL columns
    (bounded by the row width), then a partial-aggregated ``groupBy``."""
    names = F.array(*[F.when(col_of(f).isNull(), F.lit(f)) for f in features])
    nulls = df.select(F.filter(names, lambda v: v.isNotNull()).alias("nl")).filter(F.size("nl") > 0)
    pairs = (nulls.select(F.explode("nl").alias("feature"), "nl")
                  .select("feature", F.explode("nl").alias("other")))
    both = pairs.groupBy("feature", "other").agg(F.count(F.lit(1)).alias("n_both"))
    base = both.filter(F.col("feature") == F.col("other")).select("feature", F.col("n_both").alias("n_f"))
    res = both.filter(F.col("feature") != F.col("other")).join(base, "feature")
    return res.select("feature", "other", (F.col("n_both") / F.col("n_f")).alias("share"))


def conditional_features(share: DataFrame, features: Sequence[str], na_frac: float = 0.5) -> DataFrame:
    """For each feature with NULLs: the other features usable as inputs, i.e.
    missing in at most ``na_frac`` of its missing rows (pairs never missing
    together have share 0 and are kept)."""
    fs = share.select("feature").distinct()
    others = F.explode(F.array(*[F.lit(f) for f in features]))
    grid = fs.select("feature", others.alias("other")).filter(F.col("feature") != F.col("other"))
    return (grid.join(share, ["feature", "other"], "left")
                .select("feature", "other", F.coalesce("share", F.lit(0.0)).alias("share"))
                .filter(F.col("share") <= F.lit(na_frac)))
