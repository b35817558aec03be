"""Per-series summaries (grouped aggregation over key-partitioned series).

``describe_series``  -- count/mean/std/min/25/50/75%/max per numeric column,
                        flattened statistic-major into ``Stat_i``.
``series_features``  -- the flag share, a thresholded sum and, for every
                        column x mask, mean/std/max/min of the values and of
                        their first differences taken *after* masking.
``masked_diff``      -- the first differences themselves.

Every summary is one ``groupBy(key).agg`` of algebraic aggregates, so Spark
combines partial aggregates map-side and a hot key costs no more than a cold
one. The ordered steps, exact quantiles and the masked difference, go through the chunked
helpers of ``ordered``, which keep each window task bounded by the chunk size.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.exprs import col_of
from fathom.operators.ordered import chunked_neighbors, key_quantiles, nth

DESCRIBE_STATS = ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]


def describe_series(df: DataFrame, key: str, columns: Sequence[str], exact: bool = True,
                    accuracy: int = 10000, stat_prefix: str = "Stat_", rows_per_chunk: int = 1_000_000) -> DataFrame:
    """One row per key: the 8 describe statistics of every column, statistic-major.

    Exact quantiles come from ranks over counted values (:func:`key_quantiles`), so a hot series is spread over
    tasks; ``exact=False`` switches to the mergeable ``percentile_approx`` sketch, one pass less.
    """
    probs = [0.25, 0.5, 0.75]
    aggs = []
    for c in columns:
        x = col_of(c).cast("double")
        aggs += [F.count(x).cast("double").alias(f"__{c}__count"), F.avg(x).alias(f"__{c}__mean"), F.stddev_samp(x).alias(f"__{c}__std"),
                 F.min(x).alias(f"__{c}__min"), F.max(x).alias(f"__{c}__max")]
        if not exact:
            aggs.append(F.percentile_approx(x, F.array(*map(F.lit, probs)), accuracy).cast("array<double>").alias(f"__{c}__q"))
    g = df.groupBy(col_of(key).alias(key)).agg(*aggs)
    if exact:
        quantiles = key_quantiles(df.select(col_of(key).alias("__key"), *[col_of(c) for c in columns]), ["__key"], columns, probs, rows_per_chunk)
        per_key = quantiles.groupBy("__key").agg(*[F.max(F.when(F.col("f") == i, F.col("q"))).alias(f"__{c}__q") for i, c in enumerate(columns)])
        g = g.join(per_key, col_of(key).eqNullSafe(F.col("__key")), "left")
    out = []
    for s in DESCRIBE_STATS:
        for c in columns:
            e = F.col(f"`__{c}__q`")[["25%", "50%", "75%"].index(s)] if s.endswith("%") else F.col(f"`__{c}__{s}`")
            out.append(e.alias(f"{stat_prefix}{len(out)}"))
    return g.select(*out, F.col(key))


def masked_diff(df: DataFrame, key: str, order_by: Sequence[str | Column], chunk: Column,
                columns: Sequence[str], masks: Mapping[str, Column]) -> DataFrame:
    """Adds ``{col}__{mask}__diff``: for rows inside the mask, the value minus
    the value of the previous row *inside the same mask* (NULL when either is
    NULL or there is no previous row); NULL outside the mask."""
    payload = {c: col_of(c) for c in columns}
    d = chunked_neighbors(df, [key], order_by, chunk, preds=dict(masks), payload=payload, k_prev=1)
    for m, pred in masks.items():
        for c in columns:
            d = d.withColumn(f"{c}__{m}__diff",
                             F.when(F.coalesce(pred, F.lit(False)), col_of(c) - nth(f"{m}__prev", 0, c)))
        d = d.drop(f"{m}__prev")
    return d


def series_features(df: DataFrame, key: str, order_by: Sequence[str | Column], chunk: Column,
                    columns: Sequence[str], masks: Mapping[str, Column], flag: str | Column,
                    active_col: str, active_threshold: float, stat_prefix: str | None = None) -> DataFrame:
    """The per-series feature vector (2 + len(columns) * len(masks) * 6 values).

    Order of values: flag share, thresholded sum, then for each column, for each
    mask: mean, std, max, min, mean of diffs, std of diffs. Columns are named
    ``{col}_{mask}_{stat}``; with ``stat_prefix`` they are renamed ``Stat_i``.
    """
    d = masked_diff(df, key, order_by, chunk, columns, masks)
    a = col_of(active_col)
    aggs = [F.avg(col_of(flag).cast("double")).alias("flag_mean"),
            F.coalesce(F.sum(F.when(a >= F.lit(active_threshold), a)), F.lit(0.0)).alias("active_sum")]
    for c in columns:
        for m, pred in masks.items():
            inside = F.coalesce(pred, F.lit(False))
            v = F.when(inside, col_of(c).cast("double"))
            dv = F.col(f"`{c}__{m}__diff`")
            aggs += [F.avg(v).alias(f"{c}_{m}_mean"), F.stddev_samp(v).alias(f"{c}_{m}_std"),
                     F.max(v).alias(f"{c}_{m}_max"), F.min(v).alias(f"{c}_{m}_min"),
                     F.avg(dv).alias(f"{c}_{m}_diff_mean"), F.stddev_samp(dv).alias(f"{c}_{m}_diff_std")]
    g = d.groupBy(col_of(key).alias(key)).agg(*aggs)
    if stat_prefix:
        names = [c for c in g.columns if c != key]
        g = g.select(*[F.col(f"`{n}`").alias(f"{stat_prefix}{i}") for i, n in enumerate(names)], F.col(key))
    return g


def night_day_masks(hour: Column, night_from: int, night_to: int, day_from: int, day_to: int) -> dict[str, Column]:
    """The three masks of the summary: all rows, night hours, day hours."""
    return {"all": F.lit(True),
            "night": (hour >= F.lit(night_from)) | (hour <= F.lit(night_to)),
            "day": (hour <= F.lit(day_to)) & (hour >= F.lit(day_from))}
