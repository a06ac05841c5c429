"""Text to time: whole-column decisions, then one expression per column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.calendar import NTZ

# Uniform formats of a time column, most specific first.
UNIFORM = (
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    (r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd"),
    (r"^\d{2}\.\d{2}\.\d{4}$", "dd.MM.yyyy"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$", "yyyy-MM-dd HH:mm"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm"),
)
_SLASHED = r"^\d{2}/\d{2}/\d{4}$"


def parse_as(c: Column, fmt: str) -> Column:
    return F.try_to_timestamp(c, F.lit(fmt)).cast(NTZ)


def parse_any(c: Column, day_first: bool | Column) -> Column:
    """Value-by-value parse: the first format whose shape fits; else null."""
    s = F.trim(c)
    day_first = F.lit(day_first) if isinstance(day_first, bool) else day_first
    tries = [F.when(s.rlike(pattern), parse_as(s, fmt)) for pattern, fmt in UNIFORM]
    slashed = F.when(day_first, parse_as(s, "dd/MM/yyyy")).otherwise(
        F.coalesce(parse_as(s, "MM/dd/yyyy"), parse_as(s, "dd/MM/yyyy")))
    tries.append(F.when(s.rlike(_SLASHED), slashed))
    tries.append(F.when(~s.rlike(r"^\d*$"), s.try_cast("timestamp").cast(NTZ)))
    return F.coalesce(*tries)


def first_day_part(c: Column) -> Column:
    """First number of a date like 31/12/2024; above 12 somewhere, days come first in the whole column."""
    s = F.trim(c)
    return F.when(s.rlike(_SLASHED), F.substring(s, 1, 2).cast("int"))


def parse_times(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """One format for the column when every value has its shape, else value by value.

    All rows vote in one aggregate, so the answer does not hang on a sample.
    """
    s = F.trim(F.col(f"`{column}`"))
    filled = s.isNotNull() & (s != "")
    votes = [F.bool_and(F.when(filled, s.rlike(p))).alias(f"p{i}") for i, (p, _) in enumerate(UNIFORM)]
    votes += [F.bool_and(F.when(filled, s.rlike(_SLASHED))).alias("slashed"),
              F.max(first_day_part(s)).alias("first_part")]
    row = df.agg(*votes).first()
    day_first = (row["first_part"] or 0) > 12
    for i, (_, fmt) in enumerate(UNIFORM):
        if row[f"p{i}"]:
            parsed = parse_as(s, fmt)
            break
    else:
        if row["slashed"]:
            parsed = parse_as(s, "dd/MM/yyyy" if day_first else "MM/dd/yyyy")
        else:
            parsed = parse_any(F.col(f"`{column}`"), day_first)
    return df.withColumn(out or column, parsed)


def coerce_named_times(df: DataFrame) -> DataFrame:
    """Text columns named like a date or time become times when every value parses."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)
             and ("date" in f.name.lower() or "time" in f.name.lower())]
    if not names:
        return df
    ok = df.agg(*[F.bool_and(parse_any(F.col(f"`{c}`"), False).isNotNull() | F.col(f"`{c}`").isNull())
                  .alias(f"k{i}") for i, c in enumerate(names)]).first()
    return df.withColumns({c: parse_any(F.col(f"`{c}`"), False) for i, c in enumerate(names) if ok[f"k{i}"]})


def fully_parsable(df: DataFrame, columns: list[str]) -> list[str]:
    """Text columns in which every value is a time, in the given order; one aggregate."""
    if not columns:
        return []
    row = df.agg(*[F.bool_and(parse_any(F.col(f"`{c}`"), False).isNotNull()).alias(f"k{i}")
                   for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if row[f"k{i}"]]
