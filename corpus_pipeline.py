"""Documents to packed training sequences, stage by stage.

Every stage takes what the one before it wrote and returns it with its decisions carried out:
rejected, duplicate and contaminated documents go, secrets are blanked, and what is left is
packed.  All columns of ``documents`` pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches, table
from tidemark.llm.decontaminate import keep_clean
from tidemark.llm.neardup import keep_first
from tidemark.llm.packing import pack
from tidemark.llm.quality import fit, keep_good
from tidemark.llm.secrets import redact
from tidemark.session import discard, fresh_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier accepts; it learns from ``labels``."""
    small_batches(spark)
    return keep_good(docs, fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    small_batches(spark)
    return keep_first(docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ``benchmark``."""
    small_batches(spark)
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets blanked; n_chars follows the text."""
    small_batches(spark)
    clean, columns = redact(docs), docs.columns
    if "n_chars" not in columns:
        return clean
    plain = clean.toDF(*[f"c{i}" for i in range(len(columns))])
    length = F.length(f"c{columns.index('text')}").cast("bigint")
    return plain.withColumn(f"c{columns.index('n_chars')}", length).toDF(*columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a training sequence of 2048 ids.

    Workers of the stages before may still hold what they learned, so fewer words are remembered here.
    """
    small_batches(spark)
    return pack(docs, capacity=2048, known=200_000)


STAGES = [("quality classifier", quality), ("MinHash near-dedup", near_duplicates),
          ("benchmark decontamination", decontamination), ("secret scans", secrets), ("packing", packing)]

ORACLE_SQL = None  # a fitted model, signatures and a tokenizer: see tests/llm/test_pipeline.py


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``; each stage's rows are written to the shared folder and read again.

    What a stage read goes when the next one is written.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = fresh_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
        before = path
    return docs
