"""Stratified k-fold assignment.

Within each class, rows are ordered by a seeded hash of the key (tie-broken
by the key) and dealt round-robin into folds, so fold sizes per class differ
by at most one. The per-class row number is computed with chunked windows
(chunks = leading hash bits), so a class holding most rows still spreads
over many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom import constants as K
from fathom.functions.exprs import col_of
from fathom.operators.ordered import chunked_row_number


def fold_hash(key: str, seed: int = 0) -> Column:
    """Hex md5 of ``seed:key`` (the same hash is available in SQL engines)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), col_of(key).cast("string")))


def stratified_folds(df: DataFrame, label: str, key: str, k: int = K.N_FOLDS, seed: int = 0,
                     out: str = K.FOLD, rows_per_chunk: int = 1_000_000) -> DataFrame:
    """Adds ``fold`` in [0, k). Rows with a NULL label are left out of the folds (NULL). Rows are
    numbered in chunks of the hash, as many as keep a chunk at about ``rows_per_chunk`` rows."""
    h = fold_hash(key, seed)
    d = df.withColumn("__h", h)
    lab = d.filter(col_of(label).isNotNull())
    digits = max(1, math.ceil(math.log(max(1, df.count()) / rows_per_chunk, 16)))
    chunk = F.conv(F.substring(F.col("__h"), 1, digits), 16, 10).cast("long")
    ranked = chunked_row_number(lab, [label], [F.col("__h"), col_of(key)], chunk, out="__rn")
    ranked = ranked.withColumn(out, ((F.col("__rn") - 1) % k).cast("int")).drop("__rn", "__h")
    unl = d.filter(col_of(label).isNull()).drop("__h").withColumn(out, F.lit(None).cast("int"))
    return ranked.unionByName(unl)
