"""Keyed materialisation: reuse a stored result when its key matches.

The key is the md5 of (parameters, input schema, input content fingerprint).
The fingerprint is order-free and computed in one distributed aggregate:
``count(*)`` and ``sum(xxhash64(row))`` as decimal(38,0) (a long sum could
overflow under ANSI; xor would cancel duplicate rows). Unlike a shape-only key,
changed data invalidates the stored result.
"""

from __future__ import annotations

import json
from typing import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.exprs import col_of


def fingerprint_frame(df: DataFrame) -> DataFrame:
    """One-row frame (n long, h decimal(38,0)) summarising the content."""
    h = F.xxhash64(*[col_of(c) for c in df.columns]).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(h), F.lit(0).cast("decimal(38,0)")).alias("h"))


def materialize_key(df: DataFrame, params: dict) -> str:
    """md5 of canonical JSON of params + schema + content fingerprint."""
    fp = fingerprint_frame(df).first()
    payload = json.dumps({"params": params, "schema": df.schema.jsonValue(),
                          "n": int(fp["n"]), "h": str(fp["h"])}, sort_keys=True, default=str)
    import hashlib
    return hashlib.md5(payload.encode()).hexdigest()


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table of a finished write; None where there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def materialize(spark: SparkSession, path: str, params: dict, inputs: DataFrame,
                compute: Callable[[], DataFrame]) -> DataFrame:
    """Return the result stored for this key, else compute it, write it and return the written table.

    Each key has a folder of its own, and its ``_meta`` is written after the data: a crash in between
    leaves data that no key points to, never an old key over new data."""
    key = materialize_key(inputs, params)
    base = f"{path.rstrip('/')}/{key}"
    if _stored(spark, f"{base}/_meta") is None:
        compute().write.mode("overwrite").parquet(f"{base}/data")
        spark.createDataFrame([(key, json.dumps(params, sort_keys=True, default=str))], "key string, params string") \
            .coalesce(1).write.mode("overwrite").parquet(f"{base}/_meta")
    return spark.read.parquet(f"{base}/data")


def materialize_status(spark: SparkSession, path: str, params: dict, inputs: DataFrame) -> DataFrame:
    """One row: the computed key and whether a stored result with this key exists."""
    key = materialize_key(inputs, params)
    hit = _stored(spark, f"{path.rstrip('/')}/{key}/_meta") is not None
    return spark.createDataFrame([(key, hit)], "key string, hit boolean")
