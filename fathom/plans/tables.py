"""Access to the driver tables and small helpers shared by the query bindings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

DECIMALS = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def round_doubles(df: DataFrame, decimals: int = DECIMALS) -> DataFrame:
    """Round every floating column (results are compared across engines)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            out.append(stable_round(F.col(f"`{f.name}`").cast("double")).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def stable_round(x):
    """Round to 6 decimals with the same IEEE operations in every engine.

    Built-in ROUND differs between engines on values whose decimal form ends in
    5 at the 7th place (decimal-string vs. binary rounding). Here: snap to 9
    decimals first (absorbs summation-order noise), then to 6, using only
    multiply / divide / floor, which are exact-rounded identically everywhere.
    Large magnitudes (|x| >= 1e6) fall back to ROUND.
    """
    y9 = F.floor(x * F.lit(1e9) + F.lit(0.5)).cast("double")
    z = F.floor(y9 / F.lit(1e3) + F.lit(0.5)).cast("double") / F.lit(1e6)
    return F.when(F.abs(x) < F.lit(1e6), z).otherwise(F.round(x, DECIMALS))


def rnd(expr: str, decimals: int = DECIMALS) -> str:
    """SQL twin of ``stable_round`` for one expression."""
    x = f"CAST({expr} AS DOUBLE)"
    return (f"(CASE WHEN abs({x}) < 1e6 THEN floor(floor({x} * 1e9 + CAST(0.5 AS DOUBLE)) / 1e3 "
            f"+ CAST(0.5 AS DOUBLE)) / 1e6 ELSE ROUND({x}, {decimals}) END)")
