"""Tables from files, records and other data-frame libraries."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"
# One way to write a cell everywhere: quotes inside a quoted cell are doubled.
CSV_QUOTES = {"quote": '"', "escape": '"'}


def infer_csv_schema(spark: SparkSession, path: str, rows: int | None = None, multi_line: bool = False) -> T.StructType:
    """Types from all rows, or from the first ``rows`` when a prefix is enough for the caller."""
    if rows is None:
        return spark.read.csv(path, header=True, inferSchema=True, multiLine=multi_line, **CSV_QUOTES).schema
    cells = spark.read.csv(path, header=True, multiLine=multi_line, **CSV_QUOTES)
    head = [tuple(r) for r in cells.limit(rows).collect()]
    lines = [",".join("" if c is None else '"' + c.replace('"', '""').replace("\n", " ") + '"' for c in r) for r in head]
    typed = spark.read.csv(spark.sparkContext.parallelize(lines, 1), inferSchema=True, **CSV_QUOTES).schema if lines else None
    kinds = [f.dataType for f in typed.fields] if typed else [T.StringType()] * len(cells.columns)
    return T.StructType([T.StructField(n, k) for n, k in zip(cells.columns, kinds)])


def read_csv(spark: SparkSession, path: str, strict: bool = True, multi_line: bool = False,
             infer_rows: int | None = None) -> DataFrame:
    """Strict: a value that breaks the inferred type stops the read.

    Lenient: every row is kept, broken values are null and the raw line goes to
    ``_corrupt_record``.  ``multi_line`` reads quoted cells that hold line feeds; a file is then
    read by one task, since no place inside it is known to start a row.
    """
    schema = infer_csv_schema(spark, path, infer_rows, multi_line)
    options = {"header": True, "multiLine": multi_line, **CSV_QUOTES}
    if strict:
        return spark.read.csv(path, schema=schema, mode="FAILFAST", **options)
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    # a parser that skips columns takes a row with too many or too few cells for a whole one
    reader = spark.read.option("columnPruning", False)
    return reader.csv(path, schema=wide, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, **options)


def trim_header(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def require_rows(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("the table is empty")
    return df


def is_parquet(spark: SparkSession, path: str) -> bool:
    """Do the data files under ``path`` start with the Parquet mark?"""
    files = spark.read.format("binaryFile").load(path).select(F.col("path")).limit(1)
    row = files.first()
    if row is None:
        return False
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(row["path"])
    stream = hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).open(hadoop)
    try:
        return bytes(b for b in (stream.read() for _ in range(4)) if b >= 0) == b"PAR1"
    finally:
        stream.close()


def load_table(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """Table by file name: ``.parquet``, ``.json``/``.jsonl``, else CSV."""
    lower = (name or path).lower()
    if lower.endswith(".parquet"):
        return spark.read.parquet(path)
    if lower.endswith((".json", ".jsonl", ".ndjson")):
        return spark.read.json(path)
    if lower.endswith((".xlsx", ".xls")):
        raise ValueError("convert spreadsheets to CSV or Parquet first")
    return read_csv(spark, path)


def sniff_table(spark: SparkSession, path: str, seen: Observation | None = None) -> DataFrame:
    """Table by content: Parquet by its mark, else CSV of which every row is kept.

    Broken rows of a CSV table have their line in ``_corrupt_record``, a column it has in any case.
    Nothing is read ahead to look for them: ``seen`` counts ``rows`` and ``broken`` ones while
    the first action reads the table, whatever columns that action needs.
    """
    parquet = is_parquet(spark, path)
    table = spark.read.parquet(path) if parquet else read_csv(spark, path, strict=False)
    if seen is None:
        return table
    # Spark refuses to read that column alone
    broken = F.lit(None) if parquet else F.when(F.col(CORRUPT).isNotNull(), F.struct(F.col(f"`{table.columns[0]}`")))
    return table.observe(seen, F.count(F.lit(1)).alias("rows"), F.count(broken).alias("broken"))


def spread(df: DataFrame) -> DataFrame:
    """A freshly read table over all cores when it came in fewer pieces than there are.

    One small file is one task, which starves work that is heavy per row.  A table of many
    splits passes through as it is.  Meant for plain scans: the piece count is then known
    without running anything.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(hadoop)


def from_records(spark: SparkSession, records: list[dict], schema: T.StructType | None = None) -> DataFrame:
    """Rows from a request body; types are taken from the records unless given."""
    if not records:
        raise ValueError("records must not be empty")
    if schema is not None:
        return spark.createDataFrame([{f.name: r.get(f.name) for f in schema.fields} for r in records], schema)
    names = list(dict.fromkeys(k for r in records for k in r))
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in records], names, samplingRatio=1.0)


def as_spark_df(obj: Any, spark: SparkSession) -> DataFrame:
    """Spark, Arrow and pandas frames, records, or anything that converts to Arrow or pandas."""
    import pandas as pd
    import pyarrow as pa
    if isinstance(obj, DataFrame):
        return obj
    if isinstance(obj, list) and all(isinstance(r, dict) for r in obj):
        return from_records(spark, obj)
    if isinstance(obj, (pd.DataFrame, pa.Table)):
        return spark.createDataFrame(obj)
    for method in ("collect", "compute"):  # lazy frames of other libraries
        if hasattr(obj, method) and not hasattr(obj, "to_arrow") and not hasattr(obj, "to_pandas"):
            return as_spark_df(getattr(obj, method)(), spark)
    for method in ("to_arrow", "to_arrow_table", "arrow", "to_pandas", "_to_pandas", "to_pandas_df", "df"):
        if hasattr(obj, method):
            made = getattr(obj, method)()
            if hasattr(made, "read_all"):
                made = made.read_all()
            if isinstance(made, (pd.DataFrame, pa.Table)):
                return spark.createDataFrame(made)
    raise TypeError(f"cannot read a table from {type(obj).__name__}")
