"""Results of runs as files that Spark writes, and a document that names them.

A run's frames go to a folder of their own, ``{folder}/{id}/{run}/{name}``; the document
``{folder}/{id}.json`` lists them with their paths, columns and row counts, beside metrics and
parameters.  It is written aside and renamed over the old one when all frames are there, so a reader
sees the whole old result or the whole new one; the old frames go afterwards.  Rows never pass the
driver: a document holds at most INLINE_ROWS of a frame, in order, and says how many there are.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import first_line
from tidemark.session import discard
from tidemark.sources import sinks
from tidemark.sources.readers import path_exists, read_csv

INLINE_ROWS = 2000


def first_rows(frame: DataFrame, *order: str | Column, most: int = INLINE_ROWS) -> list[dict]:
    """The first rows in order; a bounded number whatever the frame's size."""
    return [r.asDict() for r in frame.orderBy(*order).limit(most).collect()]


class RunStore:
    """Writes the frames and the document of one run of a dataset."""

    def __init__(self, spark: SparkSession, root: str, dataset_id: int, folder: str = "results"):
        self.spark, self.root, self.dataset_id, self.folder = spark, root, dataset_id, folder
        self.run = uuid.uuid4().hex[:12]
        self.frames: dict[str, dict] = {}

    @property
    def key(self) -> str:
        return f"{self.folder}/{self.dataset_id}.json"

    def write(self, name: str, frame: DataFrame, partition_by: tuple[str, ...] = ()) -> dict:
        """A frame as Parquet, or as CSV when ``name`` ends so; each task writes its own part."""
        place = f"{self.folder}/{self.dataset_id}/{self.run}/{name}"
        if name.endswith(".csv"):
            rows = sinks.write_csv(frame, f"{self.root}/{place}")
        else:
            seen = Observation()
            counted = frame.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
            (counted.partitionBy(*partition_by) if partition_by else counted).parquet(f"{self.root}/{place}")
            rows = seen.get["rows"]
        self.frames[name] = {"key": place, "rows": rows, "columns": {f.name: f.dataType.simpleString() for f in frame.schema.fields}}
        return self.frames[name]

    def commit(self, payload: dict) -> dict:
        """The document, in place of an earlier one; what cannot be written is said in it."""
        document = {"dataset_id": self.dataset_id, "artifacts_key": self.key, **payload}
        if self.frames:
            document |= {"run": self.run, "frames": self.frames}
        path = f"{self.root}/{self.key}"
        try:
            before = read_document(self.spark, self.root, self.dataset_id, self.folder).get("run") if path_exists(self.spark, path) else None
            sinks.replace_text(self.spark, path, json.dumps(document, ensure_ascii=False, default=sinks.plain))
            if before and before != self.run:
                discard(self.spark, f"{self.root}/{self.folder}/{self.dataset_id}/{before}")
        except Exception as e:
            document["artifact_write_error"] = first_line(e)
        return document

    def abandon(self) -> None:
        """Removes what was written so far: the run ended without a result."""
        self.frames = {}
        discard(self.spark, f"{self.root}/{self.folder}/{self.dataset_id}/{self.run}")


def read_document(spark: SparkSession, root: str, dataset_id: int, folder: str = "results") -> dict:
    return json.loads(sinks.read_text(spark, f"{root}/{folder}/{dataset_id}.json"))


def read_frame(spark: SparkSession, root: str, dataset_id: int, name: str, folder: str = "results") -> DataFrame:
    """A frame of the committed run."""
    entry = read_document(spark, root, dataset_id, folder).get("frames", {}).get(name)
    if entry is None:
        raise KeyError(f"dataset {dataset_id} has no result {name!r}")
    path = f"{root}/{entry['key']}"
    if name.endswith(".csv"):
        return read_csv(spark, path)
    schema = ", ".join(f"`{c}` {t}" for c, t in entry["columns"].items())
    return spark.read.schema(schema).parquet(path)
