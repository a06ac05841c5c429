"""Column roles, table profile, and picking the time and target columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import TARGET_NAMES, TIME_NAMES
from tidemark.operators.dates import fully_parsable
from tidemark.operators.values import countable, value_counts

_NESTED = (T.ArrayType, T.MapType, T.StructType)
_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType)
PREVIEW_ROWS = 50  # fixed value of the preview


def role_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, _TEMPORAL):
        return "datetime"
    return "nested" if isinstance(dtype, _NESTED) else "categorical"


def roles(df: DataFrame) -> dict[str, str]:
    return {f.name: role_of(f.dataType) for f in df.schema.fields}


def role_table(df: DataFrame) -> DataFrame:
    rows = [(i, f.name, f.dataType.simpleString(), role_of(f.dataType)) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, dtype string, role string")


def quick_profile(df: DataFrame, approximate: bool = False, batch: int = 8) -> DataFrame:
    """``name, dtype, role, missing_rate, nunique, rows`` per column; null counts as a value.

    One scan counts the distinct values of all columns.  Arrays and structs, which only Spark's own
    equality tells apart, expand the rows once per column and go in batches, and so do sketches.
    """
    fields = df.schema.fields
    plain = [] if approximate else [f for f in fields if countable(f.dataType)]
    rest = [f for f in fields if f not in plain]
    parts = [_profile_values(df, plain)] if plain else []
    parts += [_profile_batch(df, rest[i:i + batch], approximate) for i in range(0, len(rest), batch)]
    made = reduce(DataFrame.unionAll, parts)
    # one row per column, put back in the order of the table
    place = F.array_position(F.array(*[F.lit(f.name) for f in fields]), F.col("name"))
    return made.coalesce(1).sortWithinPartitions(place)


def _profile_values(df: DataFrame, fields: list[T.StructField]) -> DataFrame:
    stats = value_counts(df, fields).groupBy("i").agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("nunique"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("missing"))
    names = df.sparkSession.createDataFrame(
        [(i, f.name, f.dataType.simpleString(), role_of(f.dataType)) for i, f in enumerate(fields)],
        "i int, name string, dtype string, role string")
    rows = F.coalesce("rows", F.lit(0).cast("bigint"))
    return names.join(F.broadcast(stats), "i", "left").select(  # one row per column on both sides
        "name", "dtype", "role", (F.coalesce("missing", F.lit(0)) / F.greatest(rows, F.lit(1))).alias("missing_rate"),
        F.coalesce("nunique", F.lit(0).cast("bigint")).alias("nunique"), rows.alias("rows"))


def _profile_batch(df: DataFrame, fields: list[T.StructField], approximate: bool) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        value = F.to_json(c) if isinstance(f.dataType, T.MapType) else c
        distinct = F.approx_count_distinct(value) if approximate else F.countDistinct(value)
        aggs += [F.count_if(c.isNull()).alias(f"m{i}"),
                 (distinct + F.coalesce(F.max(c.isNull().cast("int")), F.lit(0))).alias(f"u{i}")]
    entries = [F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("dtype"),
                        F.lit(role_of(f.dataType)).alias("role"),
                        (F.col(f"m{i}") / F.greatest(F.col("rows"), F.lit(1))).alias("missing_rate"),
                        F.col(f"u{i}").cast("bigint").alias("nunique"), F.col("rows"))
               for i, f in enumerate(fields)]
    return df.agg(*aggs).select(F.inline(F.array(*entries)))


def preview(df: DataFrame, limit: int = PREVIEW_ROWS) -> DataFrame:
    """First rows of a table of any size: a limit reads no more than it needs."""
    return df.limit(limit)


def suggest(df: DataFrame) -> DataFrame:
    """What can be run on the table, with the columns its roles point at."""
    found = roles(df)
    times = [c for c, r in found.items() if r == "datetime"]
    numbers = [c for c, r in found.items() if r == "numeric"]
    rows = [
        (0, "anomaly", None, None, None),
        (1, "forecasting", by_name(df, TIME_NAMES) or (times[0] if times else "date"),
         by_name(df, TARGET_NAMES) or (numbers[0] if numbers else "value"), None),
        (2, "classification", None, "target", None),
        (3, "clustering", None, None, 5),
    ]
    return df.sparkSession.createDataFrame(
        rows, "position int, type string, time_col string, target string, k int")


def by_name(df: DataFrame, names: tuple[str, ...], exact_case: bool = False) -> str | None:
    have = {c if exact_case else c.lower(): c for c in df.columns}
    return next((have[n] for n in names if n in have), None)


def time_column(df: DataFrame) -> str:
    """First time-typed column, else the first text column that parses whole."""
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return f.name
    parsable = fully_parsable(df, [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)])
    if not parsable:
        raise ValueError("no time column found; give ts_col")
    return parsable[0]


def numeric_columns(df: DataFrame, exclude: list[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def lenient_target(df: DataFrame, exclude: list[str] = ()) -> str:
    """``y`` or ``target`` if numeric, else the first numeric column."""
    found = numeric_columns(df, exclude)
    if not found:
        raise ValueError("no numeric target found; give target")
    return next((n for n in ("y", "target") if n in found), found[0])


def strict_target(df: DataFrame, target: str | None = None, exog: list[str] = ()) -> str:
    """The named column, or the only numeric one."""
    if target is not None:
        if target not in df.columns:
            raise ValueError(f"target column {target!r} not in table")
        return target
    found = numeric_columns(df, list(exog))
    if len(found) != 1:
        raise ValueError(f"target is not clear from numeric columns {found}; give target")
    return found[0]


def rename_target(df: DataFrame, original: str | None = None) -> DataFrame:
    """Name the target column of a long table ``target``."""
    if "target" in df.columns:
        return df
    values = [c for c in df.columns if c not in ("item_id", "timestamp")]
    if original in values:
        pick = original
    elif len(values) == 1:
        pick = values[0]
    else:
        pick = by_name(df, ("y", "value", "request_cnt"), exact_case=True)
        numbers = [c for c in numeric_columns(df) if c in values]
        pick = pick or (numbers[0] if len(numbers) == 1 else None)
    if pick is None:
        raise ValueError("no target column in the data")
    return df.withColumnRenamed(pick, "target")
