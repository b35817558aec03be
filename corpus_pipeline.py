"""Corpus pipeline: raw documents to token ids.

Each stage calls one operator of ``fathom.llm``, reads what the stage before it kept, and
is written as Parquet before the next one reads it, so a lost executor never repeats more
than one stage. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import bpe, golay_simhash, line_crf, line_windows, winnow
from fathom.session import ensure_checkpoint_dir

#: No SQL expresses the classifier; the tests compare the stages with brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier scores 0.7 or more. It learns from the
    labels of three quarters of the ids (the rest stays for evaluation)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~line_crf.held_out(F.col("doc_id"), 4, 2))
    return line_crf.keep_good(docs, line_crf.fit(docs, labels, "quality"), threshold=0.7)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later occurrences of repeated three-line windows; a document
    that loses all its lines goes. ``n_chars`` follows the text."""
    gone, n = "_removed_lines", "_lines"
    while {gone, n} & set(docs.columns):
        gone, n = gone + "_", n + "_"
    out = line_windows.remove_repeated_lines(docs, width=3, wrap=16, counts=(n, gone))
    out = out.where((F.col(gone) == 0) | (F.col(gone) < F.col(n)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(gone) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType))
                             .otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the least id) of every SimHash class: four-word shingles, four bits."""
    return golay_simhash.keep_one(docs, width=4, max_bits=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten consecutive words (or the whole) of a benchmark item."""
    return winnow.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), span=10)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, their number and digest, and the digest of the text decoded from them."""
    path, pattern = bpe.public_vocabulary()
    return bpe.encode_documents(docs, path, pattern, outputs=("ids", "n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("decontamination", decontamination), ("byte_bpe", byte_bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written in the shared folder of the session."""
    folder = f"{ensure_checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
