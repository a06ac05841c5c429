"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.words import parts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Columns by their exact names, under new names; others may differ from them in case only."""
    columns = df.columns
    places = {}
    for new, old in wanted.items():
        same = [i for i, c in enumerate(columns) if c == old] or [i for i, c in enumerate(columns) if c.lower() == old.lower()]
        if not same:
            raise ValueError(f"no column {old!r} among {columns}")
        places[new] = same[0]
    plain = df.toDF(*[f"c{i}" for i in range(len(columns))])
    return plain.select(*[F.col(f"c{i}").alias(new) for new, i in places.items()])


def ids_and_texts(df: DataFrame, id_column: str, text_column: str, id_type: str | None = None) -> DataFrame:
    """id, text of every row; a null text is empty."""
    rows = pick(df, id=id_column, text=text_column)
    key = F.col("id").cast(id_type) if id_type else F.col("id")
    return rows.select(key.alias("id"), text_or_empty().alias("text"))


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Batches of rows for Python of at most 8 MB from here on, where the session has Spark's default.

    A batch is held twice on both sides, in every running task.
    """
    if spark.conf.get(_BATCH) in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set(_BATCH, "8m")


def texts_of(column: pa.Array) -> pa.Array:
    """A column as texts; nulls are empty."""
    return pc.fill_null(column.cast(pa.string()), "")


def map_texts(df: DataFrame, at: int, work: Callable[[pa.RecordBatch, pa.Array], pa.RecordBatch], schema=None) -> DataFrame:
    """``work`` on a few rows at a time, with the texts of their column number ``at`` (nulls empty).

    A step holds about 4 MB of text, whatever the size of Spark's batches.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(at))
            for first, last in parts(texts):
                yield work(batch.slice(first, last - first), texts.slice(first, last - first))

    return df.mapInArrow(run, schema or df.schema)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly when the input has fewer splits than the session has cores.

    Spark cuts a file into splits only at row groups, so one small file can be one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def by_size(items: Iterable, sizes: Iterable[int], most: int) -> Iterator[list]:
    """Consecutive items in lists of about ``most`` bytes: bounds what a task holds at once."""
    part, total = [], 0
    for item, size in zip(items, sizes):
        if part and total + size > most:
            yield part
            part, total = [], 0
        part.append(item)
        total += size
    if part:
        yield part


FILTER_BITS = 25


def only_keys(rows: DataFrame, bitmap: Broadcast, column: str) -> DataFrame:
    """Rows whose whole number ``column`` may be in a ``shared_bitmap``: a filter ahead of a shuffle.

    Rows that pass by chance are left to the join that follows.
    """
    @F.pandas_udf("boolean")
    def passes(values: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(bitmap.value, values.to_numpy()))

    return rows.where(passes(column))


def shared_bitmap(keys: DataFrame, column: str) -> Broadcast:
    return keys.sparkSession.sparkContext.broadcast(key_bitmap(keys, column))


def key_bitmap(keys: DataFrame, column: str) -> np.ndarray:
    """A bitmap of 2 ** FILTER_BITS bits (4 MB) whatever the number of keys, put together as at most 2 ** 19 words."""
    bit = F.pmod(F.col(column), F.lit(1 << FILTER_BITS))
    words = (keys.select(F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod({column}, 64) AS int))").alias("bit"))
                 .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow())
    bitmap = np.zeros(1 << FILTER_BITS - 6, np.uint64)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return bitmap


def in_bitmap(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    place = np.mod(values.view(np.int64), 1 << FILTER_BITS)
    return bitmap[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1) == 1
