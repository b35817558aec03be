"""Combining prediction tables, pseudo-label selection and key joins.

Prediction tables are bound by key (an equi-join on ``id``), never by row
position. Votes are combined row-wise after the join -- no further shuffle.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom import constants as K
from fathom.functions.exprs import argmax_index, col_of


def left_join(df: DataFrame, other: DataFrame, key: str = K.ID) -> DataFrame:
    """Tabular rows left-joined to per-key features (embedding, PCA, encoder)."""
    return df.join(other, on=key, how="left")


def bind_predictions(tables: Sequence[DataFrame], key: str = K.ID, value: str = K.SII,
                     names: Sequence[str] | None = None) -> DataFrame:
    """Inner-join several prediction tables on the key; value columns renamed."""
    names = list(names or [f"p{i}" for i in range(len(tables))])
    parts = [t.select(col_of(key).alias(key), col_of(value).alias(n)) for t, n in zip(tables, names)]
    return reduce(lambda a, b: a.join(b, on=key, how="inner"), parts)


def average_vote(df: DataFrame, columns: Sequence[str], out: str = K.SII) -> DataFrame:
    """Mean of the votes rounded half-even to an integer class."""
    s = reduce(lambda a, b: a + b, [col_of(c).cast("double") for c in columns])
    return df.withColumn(out, F.bround(s / F.lit(float(len(columns))), 0).cast("int"))


def majority_vote(df: DataFrame, columns: Sequence[str], out: str = K.SII) -> DataFrame:
    """Most frequent vote per row; ties -> the smallest value (row-local)."""
    arr = F.array(*[col_of(c).cast("int") for c in columns])
    scored = F.transform(arr, lambda v: F.struct((-F.size(F.filter(arr, lambda x: x == v))).alias("neg"),
                                                 v.alias("v")))
    return df.withColumn(out, F.array_min(scored)["v"])


def weighted_vote(df: DataFrame, columns: Sequence[str], weights: Sequence[float], out: str = "pred") -> DataFrame:
    """``sum w_i p_i / sum w_i`` (NULL when all weights are 0)."""
    num = reduce(lambda a, b: a + b, [F.lit(float(w)) * col_of(c).cast("double") for c, w in zip(columns, weights)])
    den = float(sum(weights))
    return df.withColumn(out, F.try_divide(num, F.lit(den)))


def confident_by_probability(df: DataFrame, probs: str, threshold: float = K.PSEUDO_CONFIDENCE,
                             label: str = K.SII) -> DataFrame:
    """Rows whose largest class probability is ``>= threshold``; label = argmax."""
    p = col_of(probs)
    return (df.withColumn("max_prob", F.array_max(p)).withColumn(label, argmax_index(p))
              .filter(F.col("max_prob") >= F.lit(threshold)))


def prediction_spread(columns: Sequence[str]) -> Column:
    """Population std of several predictions of the same row."""
    xs = [col_of(c).cast("double") for c in columns]
    n = float(len(xs))
    mean = reduce(lambda a, b: a + b, xs) / F.lit(n)
    var = reduce(lambda a, b: a + b, [(x - mean) * (x - mean) for x in xs]) / F.lit(n)
    return F.sqrt(var)


def confident_by_spread(df: DataFrame, runs: Sequence[str], first: str, cutoff: float,
                        label: str = K.PCIAT_TOTAL) -> DataFrame:
    """Rows whose prediction spread is ``<= cutoff``; label = |first prediction|."""
    return (df.withColumn("spread", prediction_spread(runs)).filter(F.col("spread") <= F.lit(cutoff))
              .withColumn(label, F.abs(col_of(first))))
