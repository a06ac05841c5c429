"""Rows after the end of a series, and covariates for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.calendar import check_freq, plus_steps
from tidemark.operators.series import ITEM, TS, fill_covariates


def future_grid(df: DataFrame, horizon: int, freq: str) -> DataFrame:
    """(item, time, h) for ``horizon`` steps after each item's last time."""
    return expand_future(df.groupBy(ITEM).agg(F.max(TS).alias("last_ts")), horizon, freq)


def expand_future(items: DataFrame, horizon: int, freq: str) -> DataFrame:
    """Same, from a table that already has one row per item with ``last_ts``."""
    freq = check_freq(freq)
    keep = [c for c in items.columns if c not in (ITEM, "last_ts")]
    steps = F.explode(F.sequence(F.lit(1), F.lit(horizon)))
    return (items.select(ITEM, "last_ts", *keep, steps.alias("h"))
                 .select(ITEM, plus_steps(F.col("last_ts"), F.col("h"), freq).alias(TS), "h", *keep))


def future_exog(df: DataFrame, columns: list[str], horizon: int, freq: str) -> DataFrame:
    """Future covariates: last known value, 0 for a column that only holds 0 and 1."""
    facts = df.groupBy(ITEM).agg(
        F.max(TS).alias("last_ts"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(TS))).alias(f"__last_{c}") for c in columns],
        *[F.bool_and(F.col(c).cast("double").isin(0.0, 1.0)).alias(f"__flag_{c}") for c in columns])
    value = {c: F.when(F.col(f"__flag_{c}"), 0.0).otherwise(
        F.coalesce(F.col(f"__last_{c}").cast("double"), F.lit(0.0))) for c in columns}
    kept = facts.select(ITEM, "last_ts", *[v.alias(c) for c, v in value.items()])
    return expand_future(kept, horizon, freq)


def repeat_last_covariates(df: DataFrame, columns: list[str], horizon: int, freq: str) -> DataFrame:
    """Last row of each item repeated over the horizon; nulls inside it stay null."""
    last = df.groupBy(ITEM).agg(F.max(TS).alias("last_ts"),
                                F.max_by(F.struct(*columns), TS).alias("__row"))
    flat = last.select(ITEM, "last_ts", *[F.col("__row")[c].alias(c) for c in columns])
    return expand_future(flat, horizon, freq)


def covariates_on_grid(df: DataFrame, columns: list[str], grid: DataFrame) -> DataFrame:
    """Last covariate row of each item on a grid the caller gives."""
    last = df.groupBy(ITEM).agg(F.max_by(F.struct(*columns), TS).alias("__row"))
    joined = grid.join(last, ITEM, "left")
    flat = joined.select(*grid.columns, *[F.col("__row")[c].alias(c) for c in columns])
    return fill_covariates(flat, columns)
