"""How often each value of each column occurs: one scan whatever the number of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Longer values travel as a digest of 256 bits; what must be known of them is read beside it.
LONG = 64
_MICROS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def countable(dtype: T.DataType) -> bool:
    """Arrays and structs have an equality that no text of theirs keeps."""
    return not isinstance(dtype, (T.ArrayType, T.StructType))


def identity(c: Column, dtype: T.DataType) -> Column:
    """A text that is equal for equal values of the type and for no others; null for null."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return (c.cast("double") + F.lit(0.0)).cast("string")  # minus zero is zero
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c).cast("string")  # a clock set back shows an hour twice
    if isinstance(dtype, T.BinaryType):
        return F.hex(c)
    if isinstance(dtype, T.MapType):
        return F.to_json(c, _MICROS)
    return c.cast("string")


def value_counts(df: DataFrame, fields: list[T.StructField], extra=None) -> DataFrame:
    """(i, value, size, mark, n): rows per distinct value of the i-th field; null is a value.

    ``value`` is the text of ``identity``, or its digest where that has more than ``LONG`` characters;
    ``size`` is the length of such a text and ``mark`` what ``extra`` says of a text column's
    (both null for short ones, which can be looked at later, once per distinct value).  Rows are
    counted before they are shuffled, so a frequent value costs one row per task.
    """
    cells = []
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        text = identity(c, f.dataType)
        size, mark = F.lit(None).cast("int"), F.lit(None).cast("boolean")
        if isinstance(f.dataType, (T.StringType, T.BinaryType, T.MapType)):
            long = F.char_length(text) > LONG
            size = F.when(long, F.char_length(text))
            if extra is not None and isinstance(f.dataType, T.StringType):
                mark = F.when(long, extra(c))
            text = F.when(long, F.sha2(text, 256)).otherwise(text)
        cells.append(F.struct(text.alias("value"), size.alias("size"), mark.alias("mark")).alias(str(i)))
    names = [str(i) for i in range(len(fields))]
    long_form = df.select(*cells).unpivot([], names, "i", "cell")
    return (long_form.select(F.col("i").cast("int").alias("i"), "cell.*")
                     .groupBy("i", "value", "size", "mark").agg(F.count(F.lit(1)).alias("n")))
