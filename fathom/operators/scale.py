"""Scalers and simple imputers as fit / apply pairs.

``fit_*`` runs one distributed aggregate (or the chunked exact-quantile pass)
and returns a few numbers per column; ``apply_*`` is a narrow projection with
those numbers inlined. Zero scales are replaced by 1 (a constant column maps
to 0 after centring), as the reference's library does.
"""

from __future__ import annotations

import math
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.exprs import col_of
from fathom.operators.ordered import exact_quantiles


def _nz(v: float | None) -> float:
    return 1.0 if v is None or v == 0 or (isinstance(v, float) and math.isnan(v)) else float(v)


def _apply(df: DataFrame, params: Mapping[str, tuple[float | None, float]]) -> DataFrame:
    """x -> (x - shift) / scale for the fitted columns."""
    out = []
    for c in df.columns:
        if c in params:
            shift, scale = params[c]
            x = col_of(c).cast("double")
            e = (x - F.lit(shift if shift is not None else 0.0)) / F.lit(scale)
            out.append(e.alias(c))
        else:
            out.append(col_of(c))
    return df.select(*out)


# ------------------------------------------------------------------ fits
def fit_standard(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float | None, float]]:
    """mean and population std (NULLs ignored)."""
    r = df.agg(*[F.avg(col_of(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)],
               *[F.stddev_pop(col_of(c).cast("double")).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    return {c: (r[f"m{i}"], _nz(r[f"s{i}"])) for i, c in enumerate(columns)}


def fit_minmax(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float | None, float]]:
    r = df.agg(*[F.min(col_of(c).cast("double")).alias(f"a{i}") for i, c in enumerate(columns)],
               *[F.max(col_of(c).cast("double")).alias(f"b{i}") for i, c in enumerate(columns)]).first()
    return {c: (r[f"a{i}"], _nz(None if r[f"a{i}"] is None else r[f"b{i}"] - r[f"a{i}"]))
            for i, c in enumerate(columns)}


def fit_maxabs(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float | None, float]]:
    r = df.agg(*[F.max(F.abs(col_of(c).cast("double"))).alias(f"a{i}") for i, c in enumerate(columns)]).first()
    return {c: (0.0, _nz(r[f"a{i}"])) for i, c in enumerate(columns)}


def fit_robust(df: DataFrame, columns: Sequence[str], q_range: tuple[float, float] = (0.25, 0.75)
               ) -> dict[str, tuple[float | None, float]]:
    """median and inter-quantile range (exact quantiles)."""
    qs = exact_quantiles(df, columns, [q_range[0], 0.5, q_range[1]])
    out = {}
    for c in columns:
        lo, med, hi = qs[c]
        out[c] = (med, _nz(None if lo is None else hi - lo))
    return out


def standard_scale(train: DataFrame, test: DataFrame, columns: Sequence[str]):
    p = fit_standard(train, columns)
    return _apply(train, p), _apply(test, p)


def scale(df: DataFrame, columns: Sequence[str], how: str, fit_on: DataFrame | None = None) -> DataFrame:
    """Fit on ``fit_on`` (default ``df``), apply to ``df``. ``how`` in
    standard | minmax | maxabs | robust."""
    src = fit_on if fit_on is not None else df
    fit = {"standard": fit_standard, "minmax": fit_minmax, "maxabs": fit_maxabs, "robust": fit_robust}[how]
    return _apply(df, fit(src, columns))


# ------------------------------------------------------------------ quantile transform
def fit_quantile_transform(df: DataFrame, columns: Sequence[str], n_quantiles: int = 1000) -> dict[str, list[float]]:
    """Reference quantiles at ``linspace(0, 1, nq)``, ``nq = min(n_quantiles, n_rows)``."""
    n = df.count()
    nq = max(1, min(n_quantiles, n))
    refs = [i / (nq - 1) for i in range(nq)] if nq > 1 else [0.0]
    qs = exact_quantiles(df, columns, refs)
    return {c: [float(v) for v in qs[c]] for c in columns} | {"__refs__": refs}


def _quantile_lookup(quantiles: Sequence[float], refs: Sequence[float]):
    """Distinct quantile values with the reference level of the first and last
    position each value occupies (runs of tied quantiles)."""
    vals, first, last = [], [], []
    for q, r in zip(quantiles, refs):
        if vals and q == vals[-1]:
            last[-1] = r
        else:
            vals.append(q)
            first.append(r)
            last.append(r)
    return vals, first, last


def quantile_uniform(x: Column, bucket: Column, quantiles: Sequence[float], refs: Sequence[float]) -> Column:
    """Map x to [0, 1] by interpolating its position among the reference
    quantiles. ``bucket`` = number of distinct quantile values <= x (from a
    binary-search ``Bucketizer``). A value equal to a run of tied interior
    quantiles maps to the middle of the run (mean of forward and backward
    interpolation); values at or beyond the outer quantiles map to 0 / 1."""
    vals, first, last = _quantile_lookup(quantiles, refs)
    arr = lambda xs: F.array(*[F.lit(float(v)) for v in xs])
    V, RF, RL = arr(vals), arr(first), arr(last)
    b = bucket.cast("int")
    at = lambda a, i: F.element_at(a, i)  # noqa: E731  (1-based)
    v_lo, v_hi = at(V, b), at(V, b + 1)
    tied = (at(RF, b) + at(RL, b)) / F.lit(2.0)
    interp = at(RL, b) + (x - v_lo) * (at(RF, b + 1) - at(RL, b)) / (v_hi - v_lo)
    res = (F.when(x.isNull(), F.lit(None))
            .when(x >= F.lit(vals[-1]), F.lit(float(refs[-1])))   # at / above the top quantile -> 1
            .when(x <= F.lit(vals[0]), F.lit(float(refs[0])))     # at / below the bottom quantile -> 0
            .when(x == v_lo, tied)
            .otherwise(interp))
    return F.least(F.greatest(res, F.lit(0.0)), F.lit(1.0))


def quantile_transform(df: DataFrame, columns: Sequence[str], n_quantiles: int = 1000,
                       fit_on: DataFrame | None = None) -> DataFrame:
    """Uniform quantile transform fitted on ``fit_on`` (default ``df``)."""
    fit = fit_quantile_transform(fit_on if fit_on is not None else df, columns, n_quantiles)
    return apply_quantile_transform(df, columns, fit)


def apply_quantile_transform(df: DataFrame, columns: Sequence[str], fit: dict) -> DataFrame:
    """Apply fitted reference quantiles; the interval lookup is a JVM binary
    search (``Bucketizer``) instead of a scan of the quantiles per row."""
    from pyspark.ml.feature import Bucketizer
    refs = fit["__refs__"]
    cols = [c for c in columns if fit[c] and len(_quantile_lookup(fit[c], refs)[0]) >= 1]
    tmp = [f"__qx{i}" for i in range(len(cols))]
    bks = [f"__qb{i}" for i in range(len(cols))]
    d = df.select("*", *[F.coalesce(col_of(c).cast("double"), F.lit(0.0)).alias(t) for c, t in zip(cols, tmp)])
    splits = [[float("-inf")] + _quantile_lookup(fit[c], refs)[0] + [float("inf")] for c in cols]
    if cols:
        d = Bucketizer(splitsArray=splits, inputCols=tmp, outputCols=bks, handleInvalid="keep").transform(d)
    out = []
    for c in df.columns:
        if c in cols:
            i = cols.index(c)
            out.append(quantile_uniform(col_of(c).cast("double"), F.col(bks[i]), fit[c], refs).alias(c))
        else:
            out.append(col_of(c))
    return d.select(*out)


# ------------------------------------------------------------------ Yeo-Johnson
def yeo_johnson(x: Column, lam: float) -> Column:
    """Yeo-Johnson transform with a fixed lambda."""
    pos = (F.pow(x + F.lit(1.0), F.lit(lam)) - F.lit(1.0)) / F.lit(lam) if abs(lam) > 1e-12 else F.log1p(x)
    l2 = 2.0 - lam
    neg = -(F.pow(-x + F.lit(1.0), F.lit(l2)) - F.lit(1.0)) / F.lit(l2) if abs(l2) > 1e-12 else -F.log1p(-x)
    return F.when(x >= 0, pos).otherwise(neg)


def fit_yeo_johnson(df: DataFrame, columns: Sequence[str], tol: float = 1e-4) -> dict[str, float]:
    """Maximum-likelihood lambda per column.

    Each pass is one aggregate: the variance of the transformed column at every candidate, and the
    sum of the log-Jacobian. The candidates start as a coarse grid; the grid moves outwards
    while the best one is at its edge, and narrows around it otherwise, until its step is below
    ``tol``. A column without two different finite likelihoods keeps lambda 1."""
    cols = list(columns)
    grid = {c: [i / 2.0 for i in range(-8, 13)] for c in cols}
    best = {c: 1.0 for c in cols}
    open_cols = list(cols)
    while open_cols:
        aggs = []
        for i, c in enumerate(open_cols):
            x = col_of(c).cast("double")
            aggs += [F.count(x).alias(f"n{i}"), F.sum(F.signum(x) * F.log1p(F.abs(x))).alias(f"g{i}")]
            aggs += [F.var_pop(yeo_johnson(x, lam)).alias(f"v{i}_{j}") for j, lam in enumerate(grid[c])]
        r = df.agg(*aggs).first()
        still = []
        for i, c in enumerate(open_cols):
            lams, n = grid[c], r[f"n{i}"] or 0
            var = [r[f"v{i}_{j}"] for j in range(len(lams))]
            score = [-n / 2.0 * math.log(v) + (lam - 1.0) * r[f"g{i}"]
                     if v is not None and 0 < v < math.inf else -math.inf for lam, v in zip(lams, var)]
            at = max(range(len(lams)), key=lambda k: score[k])
            if n == 0 or score[at] == -math.inf:
                continue
            best[c], step = lams[at], lams[1] - lams[0]
            if at in (0, len(lams) - 1) and abs(best[c]) < 100:
                grid[c] = [best[c] + step * (k - 10) for k in range(21)]
                still.append(c)
            elif step > tol:
                grid[c] = [best[c] + step * (k - 10) / 10.0 for k in range(21)]
                still.append(c)
        open_cols = still
    return best


def power_transform(df: DataFrame, columns: Sequence[str], lambdas: Mapping[str, float] | None = None,
                    fit_on: DataFrame | None = None, standardize: bool = True) -> DataFrame:
    src = fit_on if fit_on is not None else df
    lams = dict(lambdas) if lambdas is not None else fit_yeo_johnson(src, columns)
    t = df.select(*[yeo_johnson(col_of(c).cast("double"), lams[c]).alias(c) if c in columns else col_of(c)
                    for c in df.columns])
    if not standardize:
        return t
    ts = src.select(*[yeo_johnson(col_of(c).cast("double"), lams[c]).alias(c) for c in columns])
    return _apply(t, fit_standard(ts, columns))


# ------------------------------------------------------------------ simple imputation
def fit_impute(df: DataFrame, columns: Sequence[str], strategy: str = "mean") -> dict[str, float | None]:
    """Fill values: mean, median (exact), or most frequent (ties -> smallest)."""
    if strategy == "mean":
        r = df.agg(*[F.avg(col_of(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)]).first()
        return {c: r[f"m{i}"] for i, c in enumerate(columns)}
    if strategy == "median":
        q = exact_quantiles(df, columns, [0.5])
        return {c: q[c][0] for c in columns}
    if strategy in ("most_frequent", "mode"):
        cells = F.array(*[F.struct(F.lit(c).alias("feature"), col_of(c).cast("double").alias("v")) for c in columns])
        long = df.select(F.explode(cells).alias("s")).select("s.*").filter(F.col("v").isNotNull())
        counts = long.groupBy("feature", "v").agg(F.count(F.lit(1)).alias("n"))
        best = counts.groupBy("feature").agg(F.max_by("v", F.struct(F.col("n"), -F.col("v"))).alias("v")).collect()
        got = {r.feature: r.v for r in best}
        return {c: got.get(c) for c in columns}
    raise ValueError(strategy)


def impute(df: DataFrame, columns: Sequence[str], strategy: str = "mean", fit_on: DataFrame | None = None) -> DataFrame:
    vals = fit_impute(fit_on if fit_on is not None else df, columns, strategy)
    return df.select(*[F.coalesce(col_of(c), F.lit(vals[c])).alias(c) if c in columns and vals[c] is not None
                       else col_of(c) for c in df.columns])
