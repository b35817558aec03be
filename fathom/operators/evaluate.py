"""Evaluation: quadratic weighted kappa, regression metrics, cut-point search.

All metrics are single-pass algebraic aggregates. The cut-point search works
on a (class x candidate-interval) count table whose size is fixed by the
number of classes and candidates, never by the number of rows.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom import constants as K
from fathom.functions.exprs import col_of, ordinal_round
from fathom.operators.ordered import bucket_columns, exact_quantiles


MAX_LABELS = 1000
#: Pairs of labels that are counted in one pass; a table with more of them is aggregated row by row.
MAX_PAIRS = 20_000


def _paired(df: DataFrame, y: str, p: str) -> tuple[DataFrame, Column]:
    """The table's pairs of ``y`` and ``p`` with the number of their rows, counted in one pass over it; the table itself and
    ones where the pairs are many."""
    pairs = df.groupBy(col_of(y).alias(y), col_of(p).alias(p)).agg(F.count(F.lit(1)).alias("__k")) if y != p else None
    rows = pairs.limit(MAX_PAIRS + 1).collect() if pairs is not None else []
    if pairs is None or len(rows) > MAX_PAIRS:
        return df, F.lit(1.0)
    return df.sparkSession.createDataFrame(rows, pairs.schema).coalesce(1), F.col("__k").cast("double")


def label_index(df: DataFrame, y: str, p: str) -> Column | None:
    """Map labels to their position in the sorted union of seen labels (as the
    confusion-matrix definition does). Returns None when the labels are
    already contiguous (kappa is shift-invariant), else a mapping function. Raises
    where there are more than ``MAX_LABELS``: such columns are no labels."""
    seen = (df.select(col_of(y).alias("v")).union(df.select(col_of(p).alias("v")))
            .filter(F.col("v").isNotNull()).distinct().limit(MAX_LABELS + 1).collect())
    if len(seen) > MAX_LABELS:
        raise ValueError(f"{y} and {p} hold more than {MAX_LABELS} values; kappa is defined on labels")
    vals = sorted({r[0] for r in seen})
    if not vals or all(b - a == 1 for a, b in zip(vals, vals[1:])):
        return None
    return F.create_map(*[e for i, v in enumerate(vals) for e in (F.lit(v), F.lit(float(i)))])


def kappa_column_sums(y: Column, p: Column, k: Column | None = None) -> list[Column]:
    """The sums of kappa; a row stands for ``k`` rows."""
    k = F.lit(1.0) if k is None else k
    both = y.isNotNull() & p.isNotNull()
    yy, pp = F.when(both, y.cast("double")), F.when(both, p.cast("double"))
    return [F.coalesce(F.sum(F.when(both, k)), F.lit(0.0)).alias("__n"), F.sum(k * yy).alias("__sy"), F.sum(k * pp).alias("__sp"),
            F.sum(k * yy * yy).alias("__syy"), F.sum(k * pp * pp).alias("__spp"),
            F.sum(k * (yy - pp) * (yy - pp)).alias("__sd")]


def kappa_from_sums(n="__n", sy="__sy", sp="__sp", syy="__syy", spp="__spp", sd="__sd") -> Column:
    """1 - sum (y-p)^2 / (sum y^2 + sum p^2 - 2 sum y sum p / n); NULL when undefined."""
    c = F.col
    den = c(syy) + c(spp) - F.lit(2.0) * c(sy) * c(sp) / c(n)
    return F.lit(1.0) - F.try_divide(c(sd), den)


def quadratic_weighted_kappa(df: DataFrame, y: str, p: str, remap: bool = True) -> DataFrame:
    """One row ``Kappa`` (closed form of the quadratic-weighted confusion-matrix kappa)."""
    df, k = _paired(df, y, p)
    m = label_index(df, y, p) if remap else None
    yc, pc = col_of(y), col_of(p)
    if m is not None:
        yc, pc = F.try_element_at(m, yc), F.try_element_at(m, pc)
    return df.agg(*kappa_column_sums(yc, pc, k)).select(kappa_from_sums().alias(K.KAPPA))


def regression_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row ``RMSE, MAE, R2`` over rows where both are present. R2 of a
    constant target is 1.0 for a perfect fit, else 0.0."""
    both = col_of(y).isNotNull() & col_of(p).isNotNull()
    yy, pp = F.when(both, col_of(y).cast("double")), F.when(both, col_of(p).cast("double"))
    a = df.agg(F.count(yy).alias("n"), F.avg((yy - pp) * (yy - pp)).alias("mse"), F.avg(F.abs(yy - pp)).alias("mae"),
               F.var_pop(yy).alias("var"), F.sum((yy - pp) * (yy - pp)).alias("sse"))
    sst = F.col("var") * F.col("n")                   # centred sums: no cancellation for large means
    r2 = (F.when(sst > 0, F.lit(1.0) - F.col("sse") / sst)
           .when(F.col("sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return a.select(F.sqrt("mse").alias(K.RMSE), F.col("mae").alias(K.MAE), r2.alias(K.R2))


def evaluate(df: DataFrame, y: str, p: str, decimals: int = K.METRIC_DECIMALS) -> DataFrame:
    """All metrics in one row, rounded half-even to ``decimals``."""
    df, k = _paired(df, y, p)
    m = label_index(df, y, p)
    yc, pc = col_of(y), col_of(p)
    ky, kp = (F.try_element_at(m, yc), F.try_element_at(m, pc)) if m is not None else (yc, pc)
    both = col_of(y).isNotNull() & col_of(p).isNotNull()
    yy, pp = F.when(both, yc.cast("double")), F.when(both, pc.cast("double"))
    n = F.sum(F.when(both, k))
    mean = df.agg(F.try_divide(F.sum(k * yy), n)).first()[0]                    # centred sums: no cancellation for large means
    dev = yy - F.lit(mean).cast("double")
    a = df.agg(*kappa_column_sums(ky, kp, k), F.try_divide(F.sum(k * (yy - pp) * (yy - pp)), n).alias("mse"),
               F.try_divide(F.sum(k * F.abs(yy - pp)), n).alias("mae"), F.when(F.min(yy) < F.max(yy), F.sum(k * dev * dev)).otherwise(F.lit(0.0)).alias("sst"),
               F.sum(k * (yy - pp) * (yy - pp)).alias("sse"))
    sst = F.col("sst")
    r2 = (F.when(sst > 0, F.lit(1.0) - F.col("sse") / sst)
           .when(F.col("sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return a.select(F.bround(kappa_from_sums(), decimals).alias(K.KAPPA), F.bround(F.sqrt("mse"), decimals).alias(K.RMSE),
                    F.bround(F.col("mae"), decimals).alias(K.MAE), F.bround(r2, decimals).alias(K.R2))


def merge_first_non_null(scores: DataFrame, columns: Sequence[str] = (K.KAPPA, K.RMSE, K.MAE, K.R2)) -> DataFrame:
    """Collapse several partial score rows into one: first non-NULL per column."""
    return scores.agg(*[F.first(col_of(c), ignorenulls=True).alias(c) for c in columns])


# ------------------------------------------------------------------ cut-point search
def cut_candidates(df: DataFrame, pred: str, n_candidates: int = 64) -> list[float]:
    """Candidate cut points: distinct interior quantiles of the predictions
    (exact, via chunked ranking)."""
    probs = [i / (n_candidates + 1) for i in range(1, n_candidates + 1)]
    q = exact_quantiles(df, [pred], probs)[pred]
    return sorted(set(float(v) for v in q if v is not None))


def tune_cuts(df: DataFrame, y: str, pred: str, n_cuts: int = 3, n_candidates: int = 64,
              candidates: Sequence[float] | None = None) -> DataFrame:
    """Cut points (ascending) maximising quadratic weighted kappa of
    ``ordinal_round(pred, cuts)`` against ``y``, searched over all ordered
    ``n_cuts``-subsets of the candidate grid. Ties -> smallest candidate indices.

    1. each row -> (class, interval index among the candidates): one partial
       ``groupBy`` (classes x (C+1) cells);
    2. the cell counts (bounded by parameters) are inlined as a literal array;
    3. the ordered subsets are generated with ``sequence``/``explode`` and each
       is scored from tail totals per candidate -- no join, two lookups per cut.
    Returns one row ``cut_1..cut_k, Kappa``.
    """
    spark = df.sparkSession
    d = df.filter(col_of(y).isNotNull() & col_of(pred).isNotNull())
    cands = list(candidates) if candidates is not None else cut_candidates(d, pred, n_candidates)
    if not cands:
        cands = [0.0]
    if len(cands) < n_cuts:
        # degenerate (near-constant) predictions: pad with cuts that never fire
        cands = cands + [float("inf")] * (n_cuts - len(cands))
    # padding never fires below a prediction of +inf, which reaches every candidate
    finite = [float(c) + 0.0 for c in cands if math.isfinite(c)]
    padded = [*finite, *[math.inf] * (len(cands) - len(finite))]
    if padded == [float(c) for c in cands] and all(a < b for a, b in zip(finite, finite[1:])):
        d = d.select(col_of(y).cast("double").alias("y"), (col_of(pred).cast("double") + F.lit(0.0)).alias("p"))
        d = bucket_columns(d, ["p"], [finite], ["i"])
        idx = F.when(F.col("p") >= F.lit(math.inf), F.lit(len(cands))).otherwise(F.col("i"))
        pairs = d.select("y", idx.alias("i"))
    else:
        cand_arr, p = F.array(*[F.lit(c) for c in cands]), col_of(pred).cast("double")
        pairs = d.select(col_of(y).cast("double").alias("y"), F.size(F.filter(cand_arr, lambda t: t <= p)).alias("i"))
    cells = [(float(r["y"]), int(r["i"]), int(r["n"]))
             for r in pairs.groupBy("y", "i").count()
                       .withColumnRenamed("count", "n").collect()]
    return _search(spark, cells, cands, n_cuts)


def _search(spark: SparkSession, cells: list[tuple[float, int, int]], cands: list[float], n_cuts: int) -> DataFrame:
    """Best ordered subset of the candidates.

    A row's class is the number of chosen cuts at or below it, so every sum kappa
    needs is a sum over the chosen cuts of two tail totals: the rows at or above a
    candidate, and the sum of their labels. A subset is scored with two lookups per cut.
    """
    C = len(cands)
    above = [0.0] * (C + 1)
    label = [0.0] * (C + 1)
    for y, i, n in cells:
        above[i] += n
        label[i] += n * y
    for i in range(C - 1, -1, -1):
        above[i] += above[i + 1]
        label[i] += label[i + 1]
    n, sy = above[0], label[0]
    syy = sum(k * y * y for y, _, k in cells)
    tail_n = F.array(*[F.lit(v) for v in above[1:]])
    tail_y = F.array(*[F.lit(v) for v in label[1:]])

    def cut(k: int, index: Column) -> list[Column]:
        return [index.alias(f"c{k}"), F.element_at(tail_n, index + 1).alias(f"n{k}"), F.element_at(tail_y, index + 1).alias(f"y{k}")]

    t = spark.range(C).select(*cut(1, F.col("id").cast("int")))
    for k in range(2, n_cuts + 1):
        t = (t.where(F.col(f"c{k - 1}") < C - 1)
             .select("*", F.explode(F.sequence(F.col(f"c{k - 1}") + 1, F.lit(C - 1))).alias("next"))
             .select(*t.columns, *cut(k, F.col("next"))))
    ks = range(1, n_cuts + 1)
    total = lambda cols: sum(cols[1:], cols[0])
    sp = total([F.col(f"n{k}") for k in ks])
    spp = total([F.lit(2.0 * k - 1.0) * F.col(f"n{k}") for k in ks])
    syp = total([F.col(f"y{k}") for k in ks])
    sd = F.lit(syy) - F.lit(2.0) * syp + spp
    # kappa = 1 - sd / (syy + spp - 2 sy sp / n) = 1 - n sd / (n (syy + spp) - 2 sy sp): exact integer
    # numerator and denominator, one IEEE division -> identical ordering in every engine
    ratio = F.try_divide(F.lit(n) * sd, F.lit(n) * (F.lit(syy) + spp) - F.lit(2.0 * sy) * sp)
    s = t.withColumn("ratio", ratio)
    best = s.orderBy(F.col("ratio").asc_nulls_last(), *[F.col(f"c{k}") for k in ks]).limit(1)
    cand_arr = F.array(*[F.lit(c) for c in cands])
    return best.select(*[F.element_at(cand_arr, F.col(f"c{k}") + 1).alias(f"cut_{k}") for k in ks],
                       (F.lit(1.0) - F.col("ratio")).alias(K.KAPPA))


def apply_cuts(df: DataFrame, pred: str, cuts: Sequence[float], out: str = K.SII) -> DataFrame:
    return df.withColumn(out, ordinal_round(pred, list(cuts)))
