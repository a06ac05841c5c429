"""Result documents, scored tables and saved models."""

from __future__ import annotations

import datetime as dt
import decimal
import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import first_line
from tidemark.operators.series import ITEM, TS
from tidemark.sources.readers import CSV_QUOTES

PREVIEW_ROWS = 20  # fixed value: records shown when no file is asked for


def plain(value):
    """JSON form of values JSON has no form for."""
    if isinstance(value, (dt.datetime, dt.date, dt.time)):
        return value.isoformat()
    if isinstance(value, decimal.Decimal):
        return str(value)
    if hasattr(value, "item"):
        return value.item()
    return str(value)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small document at ``path`` on whatever file system the path names."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    stream = fs.create(hadoop, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def create_new(spark: SparkSession, path: str) -> bool:
    """An empty file that was not there before; False if it was.  Of several callers one gets True."""
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if fs.getUri().getScheme() == "file":  # Hadoop's local files look first and create afterwards
        place = fs.makeQualified(hadoop).toUri().getPath()
        os.makedirs(os.path.dirname(place), exist_ok=True)
        try:
            os.close(os.open(place, os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            return False
        return True
    try:
        fs.create(hadoop, False).close()
    except Py4JJavaError:
        if fs.exists(hadoop):
            return False
        raise
    return True


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """The document at ``path``, written aside and renamed over the old one in one step."""
    aside = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
    write_text(spark, aside, text)
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs
    source, target = hadoop.Path(aside), hadoop.Path(path)
    files = hadoop.FileContext.getFileContext(source.getFileSystem(
        spark._jsparkSession.sessionState().newHadoopConf()).getUri(), spark._jsparkSession.sessionState().newHadoopConf())
    options = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
    options[0] = getattr(jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
    files.rename(source, target, options)


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r["value"] for r in spark.read.text(path).collect())


def write_artifact(spark: SparkSession, root: str, dataset_id: int, payload: dict, folder: str = "results") -> dict:
    """``{folder}/{id}.json`` under ``root``; a failed write is reported in the document."""
    key = f"{folder}/{dataset_id}.json"
    document = {"dataset_id": dataset_id, "artifacts_key": key, **payload}
    try:
        replace_text(spark, f"{root}/{key}", json.dumps(document, ensure_ascii=False, default=plain))
    except Exception as e:
        document["artifact_write_error"] = first_line(e)
    return document


def json_rows(df: DataFrame) -> DataFrame:
    """Rows as JSON text, column ``value``; decimals keep their digits as strings."""
    columns = [F.col(f"`{f.name}`").cast("string").alias(f.name) if f.dataType.typeName() == "decimal"
               else F.col(f"`{f.name}`") for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*columns), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss",
                                                    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss"}).alias("value"))


def write_csv(df: DataFrame, path: str) -> int:
    """CSV folder with headers; each task writes its own part.  Returns the rows written.

    Quotes are written as ``read_csv`` reads them.  The rows are counted on their way out: a
    file with line feeds in its cells has more lines than rows.
    """
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.mode("overwrite").csv(path, header=True, ignoreLeadingWhiteSpace=False,
                                          ignoreTrailingWhiteSpace=False, **CSV_QUOTES)
    return seen.get["rows"]


def forecast_export(forecast: DataFrame) -> DataFrame:
    """Keys, mean and the quantile columns that exist."""
    wanted = ["mean", "p10", "p50", "p90", "0.1", "0.5", "0.9"]
    renamed = forecast.withColumnRenamed("y_hat", "mean") if "mean" not in forecast.columns else forecast
    return renamed.select(ITEM, TS, *[F.col(f"`{c}`") for c in wanted if c in renamed.columns])


def scored_output(spark: SparkSession, scored: DataFrame, root: str, dataset_id: int, return_file: bool) -> dict:
    """Whole scored table as CSV, or its size and first records."""
    if return_file:
        key = f"results/{dataset_id}_scored.csv"
        return {"scored_key": key, "rows": write_csv(scored, f"{root}/{key}")}
    return {"rows": scored.count(), "preview": [r.asDict(recursive=True) for r in scored.limit(PREVIEW_ROWS).collect()]}
