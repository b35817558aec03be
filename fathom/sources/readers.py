"""Scans: CSV, parquet, a train/test pair and key-partitioned series.

All scans are plain ``spark.read`` calls, so filters and projections applied
later reach the file scan (pushed filters, pruned read schema, pruned
partitions for the series layout).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fathom.functions.exprs import col_of, null_if_nonfinite

_KEY_INFERENCE = "spark.sql.sources.partitionColumnTypeInference.enabled"
_LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None,
             key: str | None = None) -> DataFrame:
    """CSV with a header; empty field -> NULL. ``key`` (the reference's index
    column) stays an ordinary column and is moved first."""
    r = spark.read.option("header", True).option("nullValue", "").option("nanValue", "NaN")
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    df = r.csv(path)
    if key is not None and key in df.columns:
        df = df.select(key, *[c for c in df.columns if c != key])
    return df


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_tabular_pair(spark: SparkSession, root: str, key: str = "id",
                      schema: StructType | str | None = None,
                      train_name: str = "train.csv",
                      test_name: str = "test.csv") -> tuple[DataFrame, DataFrame]:
    """``train.csv`` and ``test.csv`` under ``root`` keyed by ``key``."""
    base = root.rstrip("/")
    return (read_csv(spark, f"{base}/{train_name}", schema, key),
            read_csv(spark, f"{base}/{test_name}", schema, key))


def with_split(train: DataFrame, test: DataFrame, split_col: str = "split") -> DataFrame:
    """One frame with a ``split`` literal column (train/test), columns aligned by name."""
    return (train.withColumn(split_col, F.lit("train"))
            .unionByName(test.withColumn(split_col, F.lit("test")), allowMissingColumns=True))


def read_series(spark: SparkSession, root: str, key: str = "id",
                file_name: str | None = "part-0.parquet",
                drop: tuple[str, ...] = ()) -> DataFrame:
    """Hive-partitioned series ``root/<key>=<value>/part-0.parquet``.

    One scan with partition discovery replaces the per-directory listing loop;
    the key comes back as a string column (partition type inference is turned
    off for this read). Only directories holding ``file_name`` contribute,
    which ``pathGlobFilter`` expresses without a listing on the driver. Spark
    lists up to 10,000 directories in a task each, so that scheduling costs more
    than listing; a few tasks per core list them all.
    """
    few = min(int(spark.conf.get(_LISTING_TASKS)), 4 * spark.sparkContext.defaultParallelism)
    during = {_KEY_INFERENCE: "false", _LISTING_TASKS: str(few)}
    prev = {k: spark.conf.get(k) for k in during}
    try:
        for k, v in during.items():
            spark.conf.set(k, v)
        r = spark.read
        if file_name:
            r = r.option("pathGlobFilter", file_name)
        df = r.option("basePath", root).parquet(root)
    finally:
        for k, v in prev.items():
            spark.conf.set(k, v)
    cols = [c for c in df.columns if c not in drop]
    return df.select(*[col_of(c) for c in cols])


def nonfinite_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Turn NaN / +-inf into NULL in every floating column (or the given ones)."""
    float_cols = {f.name for f in df.schema.fields
                  if f.dataType.typeName() in ("double", "float")}
    targets = set(columns) if columns is not None else float_cols
    return df.select(*[null_if_nonfinite(c).alias(c) if c in targets and c in float_cols
                       else col_of(c) for c in df.columns])
