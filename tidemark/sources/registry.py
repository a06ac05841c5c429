"""Registered datasets: an append-only Parquet table for any number of writers.

An id is taken by creating the file that bears it, which only one writer can do; who comes second
tries the next one.  Each row is written to a folder of its own: commits into one folder would
clear away each other's work in progress.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import storage_key
from tidemark.sources.readers import path_exists
from tidemark.sources.sinks import create_new

SCHEMA = "id long, path string, name string, mime string, created_at timestamp"


class DatasetRegistry:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.path = spark, f"{root}/datasets"

    def table(self) -> DataFrame:
        if not path_exists(self.spark, self.path):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(self.path)

    def create(self, path: str, name: str, mime: str = "text/csv", must_exist: bool = True) -> int:
        """New row for a stored file; returns its id."""
        if must_exist and not path_exists(self.spark, path):
            raise FileNotFoundError(path)
        new_id = (self.table().agg(F.max("id")).first()[0] or 0) + 1
        while not create_new(self.spark, f"{self.path}_ids/{new_id}"):
            new_id += 1
        row = self.spark.createDataFrame([(new_id, path, name, mime)], "id long, path string, name string, mime string")
        row.withColumn("created_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.path}/{new_id}")
        return new_id

    def get(self, dataset_id: int) -> Row:
        row = self.table().where(F.col("id") == dataset_id).first()
        if row is None:
            raise KeyError(f"dataset {dataset_id} not found")
        return row


def storage_keys(df: DataFrame, filename: str, prefix: str = "uploads/") -> DataFrame:
    """Unique storage key for each file name."""
    unique = F.replace(F.uuid(), F.lit("-"), F.lit(""))
    return df.withColumn("key", storage_key(F.col(filename), unique, prefix))
