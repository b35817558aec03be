"""Sinks: CSV, key-partitioned series, appended score tables, submissions, models and feature lists."""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.exprs import col_of


def save_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header CSV; Spark creates parent folders. Written by all tasks in parallel."""
    df.write.mode(mode).option("header", True).csv(path)


def save_series(df: DataFrame, root: str, key: str = "id") -> None:
    """Key-partitioned series ``root/<key>=<value>/part-*.parquet``, one file per key.

    The cost is a file per key, not bytes, so the number of tasks is given: AQE merges partitions by
    their bytes, and one task would then open the files of thousands of keys.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    df.repartition(n, col_of(key)).write.partitionBy(key).parquet(root)


def save_scores(scores: dict[str, DataFrame], root: str) -> None:
    """Append each named score table under ``root/<name>`` (created on first write)."""
    for name, df in scores.items():
        df.write.mode("append").parquet(f"{root.rstrip('/')}/{name}")


def save_submission(predictions: DataFrame, path: str, key: str = "id",
                    label: str = "sii") -> None:
    """Predictions carry their key, so no positional re-keying is needed."""
    predictions.select(key, F.col(label).cast("int").alias(label)) \
        .write.mode("overwrite").option("header", True).csv(path)


def save_model(model, path: str) -> None:
    """Persist a fitted ``pyspark.ml`` model / pipeline model."""
    model.write().overwrite().save(path)


def load_model(path: str):
    """The fitted model that was saved at ``path``, of whatever class it is."""
    from pyspark.ml.util import DefaultParamsReader
    return DefaultParamsReader.loadParamsInstance(path, SparkSession.active().sparkContext)


def save_feature_list(spark: SparkSession, features: Iterable[str], path: str) -> None:
    """A one-column table ``feature`` (ordered by ``pos``); never evaluated as code."""
    rows = [(i, f) for i, f in enumerate(features)]
    spark.createDataFrame(rows, "pos int, feature string").coalesce(1) \
        .write.mode("overwrite").parquet(path)


def feature_list_frame(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).orderBy("pos")


def read_feature_list(spark: SparkSession, path: str) -> list[str]:
    """Feature names are schema-sized metadata, so they come back to the driver."""
    return [r.feature for r in feature_list_frame(spark, path).select("feature").collect()]
