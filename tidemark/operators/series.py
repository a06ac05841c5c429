"""Series preparation: keys, duplicates, regular grids, filling, trimming.

A series table is long: ``item_id STRING, timestamp TIMESTAMP_NTZ, target DOUBLE`` plus
covariates.  After ``resample`` or ``regular_grid`` an item has one row per step, so its
length is bounded by the calendar (a century of hours is 876,600 rows) and never by the
volume of raw rows; windows partitioned by item are used only from there on.  Operators
that accept raw rows aggregate first or join per-item facts with ``attach``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.calendar import (NTZ, bucket, check_freq, first_on_grid, on_grid_flags, plus_steps,
                                         steps_between)
from tidemark.operators.dates import first_day_part, parse_any
from tidemark.operators.keyed import attach

ITEM, TS, Y = "item_id", "timestamp", "target"
LONE = "series_0"


def by_item(*order: str | Column) -> W:
    return W.partitionBy(ITEM).orderBy(*(order or (TS,)))


# --- keys ----------------------------------------------------------------------------


def as_naive(c: Column, dtype: T.DataType, zone: str = "UTC") -> Column:
    """Any time-like column as zone-free UTC time."""
    if isinstance(dtype, T.TimestampNTZType):
        return c
    if isinstance(dtype, T.TimestampType):
        return F.to_utc_timestamp(c, F.current_timezone()).cast(NTZ) if zone != "UTC" else c.cast(NTZ)
    return c.cast(NTZ)


def to_long_series(df: DataFrame, ts_col: str, value_cols: list[str], item_col: str | None = None,
                   fallback_id: str = LONE, target: str | None = None) -> DataFrame:
    """Keep key and value columns, rename the keys, drop rows without a time."""
    missing = [c for c in [ts_col, *value_cols] if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if item_col is not None and item_col not in df.columns:
        item_col = None
    item = F.lit(fallback_id) if item_col is None else F.col(f"`{item_col}`").cast("string")
    values = [F.col(f"`{c}`").cast("double").alias(Y if c == target else c) for c in value_cols]
    return (df.select(item.alias(ITEM), as_naive(F.col(f"`{ts_col}`"), df.schema[ts_col].dataType).alias(TS),
                      *values)
              .dropna(subset=[TS]))


def series_keys(df: DataFrame, keys: list[str]) -> tuple[DataFrame, dict]:
    """The table with its keys as text ``item_id`` and zone-free ``timestamp``, and what was decided.

    Of two or more keys the last one that looks like a time is the time: a time type, or text of which
    at most 5 % of all rows (nulls included) cannot be read.  If none does, the last key is tried.  The
    item is the first other key; a lone key is the time of item "0".  One aggregate over the keys
    decides, and tells how slashed dates are ordered.  A time that is null or cannot be read is an
    error.  Other columns pass; one that is already named like a new key is an error.
    """
    missing = [k for k in keys if k not in df.columns]
    if missing or not keys:
        raise ValueError(f"missing keys: {missing}" if missing else "no keys given")
    taken = [c for c in df.columns if c.lower() in (ITEM, TS) and c not in keys]
    if taken:
        raise ValueError(f"columns {taken} have the names of the new keys")
    kinds = [df.schema[k].dataType for k in keys]
    typed = [isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)) for t in kinds]
    text = [isinstance(t, T.StringType) for t in kinds]
    votes = [F.count(F.lit(1)).alias("n")]
    for i, k in enumerate(keys):
        c = F.col(f"`{k}`")
        votes += [F.count(parse_any(c, False) if text[i] else c if typed[i] else F.lit(None)).alias(f"good{i}"),
                  F.max(first_day_part(c) if text[i] else F.lit(None)).alias(f"first{i}")]
    row = df.agg(*votes).first()
    timely = [i for i in range(len(keys)) if typed[i] or text[i] and row["n"] and 20 * (row["n"] - row[f"good{i}"]) <= row["n"]]
    at = timely[-1] if timely else len(keys) - 1
    bad = row["n"] - row[f"good{at}"]
    if bad:
        raise ValueError(f"{bad} of {row['n']} times in {keys[at]!r} are null or cannot be read")
    ts = F.col(f"`{keys[at]}`")
    time = parse_any(ts, (row[f"first{at}"] or 0) > 12) if text[at] else as_naive(ts, kinds[at]) if typed[at] else ts.try_cast(NTZ)
    own = next((k for i, k in enumerate(keys) if i != at), None)
    item = F.lit("0") if own is None else F.col(f"`{own}`").cast("string")
    rest = [F.col(f"`{c}`") for c in df.columns if c not in (keys[at], own)]
    return df.select(item.alias(ITEM), time.alias(TS), *rest), {"time": keys[at], "item": own}


def require_times(df: DataFrame, ts_col: str) -> DataFrame:
    """The same table; null times are an error that tells their number."""
    bad = df.agg(F.count_if(F.col(f"`{ts_col}`").isNull())).first()[0]
    if bad:
        raise ValueError(f"{bad} times in {ts_col!r} are null or cannot be read")
    return df


def single_series_name(df: DataFrame, name: str) -> DataFrame:
    """Rename the id when the table holds one series only."""
    ids = df.agg((F.min(ITEM) == F.max(ITEM)).alias("lone"))
    return df.withColumn(ITEM, F.when(ids.scalar(), F.lit(name)).otherwise(F.col(ITEM)))


def drop_incomplete(df: DataFrame, target: str = Y) -> DataFrame:
    return df.dropna(subset=[TS, target])


# --- duplicates ----------------------------------------------------------------------


def merge_duplicates(df: DataFrame, sum_cols: list[str], last_cols: dict[str, str] | None = None) -> DataFrame:
    """One row per (item, time): sums, and for ``last_cols`` (column -> order column) the last value."""
    aggs = [F.sum(c).alias(c) for c in sum_cols]
    aggs += [F.max_by(c, order).alias(c) for c, order in (last_cols or {}).items()]
    return df.groupBy(ITEM, TS).agg(*aggs)


def require_unique_times(df: DataFrame) -> DataFrame:
    """One row per (item, time); a repeated time stops the query."""
    others = [c for c in df.columns if c not in (ITEM, TS)]
    merged = df.groupBy(ITEM, TS).agg(F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(c) for c in others])
    message = F.concat(F.lit("duplicate timestamp in series "), F.col(ITEM))
    return (merged.withColumn(ITEM, F.when(F.col("__n") > 1, F.raise_error(message)).otherwise(F.col(ITEM)))
                  .drop("__n"))


# --- grids ---------------------------------------------------------------------------


def step_grid(df: DataFrame, freq: str) -> DataFrame:
    """(item, time, step) inside each item's first and last time.

    The first point is the first time, for months the first month end or start not before
    it; the time of day is kept.  A range without such a point gives no rows.
    """
    bounds = (df.groupBy(ITEM).agg(F.min(TS).alias("first"), F.max(TS).alias("hi"))
                .select(ITEM, first_on_grid(F.col("first"), freq).alias("lo"), "hi"))
    steps = F.when(F.col("lo") <= F.col("hi"), F.sequence(F.lit(0), steps_between(F.col("lo"), F.col("hi"), freq)))
    return (bounds.select(ITEM, "lo", F.explode(steps).alias("step"))
                  .select(ITEM, plus_steps(F.col("lo"), F.col("step"), freq).alias(TS), "step"))


def resample(df: DataFrame, freq: str, how: str = "mean", columns: list[str] | None = None) -> DataFrame:
    """Bins per item on a regular grid; empty bins are null for ``mean`` and 0 for ``sum``."""
    freq = check_freq(freq)
    columns = columns or [Y]
    agg = {"mean": F.avg, "sum": F.sum}[how]
    binned = (df.groupBy(ITEM, bucket(F.col(TS), freq).alias(TS))
                .agg(*[agg(c).alias(c) for c in columns]))
    out = _open_gaps(binned, freq, columns)
    return out.fillna(0.0, subset=columns) if how == "sum" else out


def _open_gaps(binned: DataFrame, freq: str, columns: list[str]) -> DataFrame:
    """Empty rows between neighbouring bins.

    Each bin knows the next one and fills the way to it, so the raw rows are read once; a
    separate grid would read them again for its bounds.
    """
    ahead = binned.withColumn("__next", F.lead(TS).over(by_item()))
    gap = F.coalesce(steps_between(F.col(TS), F.col("__next"), freq), F.lit(1))
    rows = ahead.withColumn("__k", F.explode(F.sequence(F.lit(0), gap - 1)))
    return rows.select(ITEM, plus_steps(F.col(TS), F.col("__k"), freq).alias(TS),
                       *[F.when(F.col("__k") == 0, F.col(c)).alias(c) for c in columns])


def regular_grid(df: DataFrame, freq: str, y_fill: float = 0.0, max_ffill_steps: int | None = None,
                 exog: list[str] | None = None) -> DataFrame:
    """Grid from first to last time: target carried forward, rest ``y_fill``; covariates as they are."""
    freq = check_freq(freq)
    data = require_unique_times(df.select(ITEM, TS, Y, *(exog or [])))
    joined = step_grid(data, freq).join(data, [ITEM, TS], "left")
    return (joined.withColumn(Y, _carried(F.col(Y), max_ffill_steps))
                  .fillna(y_fill, subset=[Y]))


def _carried(value: Column, max_steps: int | None) -> Column:
    past = by_item().rowsBetween(W.unboundedPreceding, 0)
    known = F.when(value.isNotNull() & ~F.isnan(value), F.struct(F.col("step"), value.alias("v")))
    last = F.last(known, ignorenulls=True).over(past)
    if max_steps is None:
        return last["v"]
    return F.when(F.col("step") - last["step"] <= max_steps, last["v"])


def as_freq(df: DataFrame, freq: str) -> DataFrame:
    """Reselect on a stated grid without filling."""
    freq = check_freq(freq)
    data = require_unique_times(df)
    return step_grid(data, freq).drop("step").join(data, [ITEM, TS], "left")


def fill_covariates(df: DataFrame, columns: list[str], zero: bool = False) -> DataFrame:
    """Forward then backward fill per item; ``zero`` replaces what is still missing."""
    past = by_item().rowsBetween(W.unboundedPreceding, 0)
    ahead = by_item().rowsBetween(0, W.unboundedFollowing)
    filled = df.withColumns({
        c: F.coalesce(F.last(c, ignorenulls=True).over(past), F.first(c, ignorenulls=True).over(ahead))
        for c in columns})
    return filled.fillna(0.0, subset=columns) if zero else filled


def align_covariates(keys: DataFrame, covariates: DataFrame, columns: list[str]) -> DataFrame:
    """Covariates on the (item, time) rows of ``keys``: left join, fill, then zero."""
    joined = keys.select(ITEM, TS).join(covariates.select(ITEM, TS, *columns), [ITEM, TS], "left")
    return fill_covariates(joined, columns, zero=True)


# --- frequency -----------------------------------------------------------------------


def infer_frequency(df: DataFrame) -> DataFrame:
    """Frequency per item, ``D`` when the times share no grid or leave gaps.

    A set of distinct times is regular when all sit on one grid and their number equals the
    steps from first to last plus one, so one aggregate decides and nothing is sorted.
    """
    times = df.select(ITEM, TS).distinct()
    flags = on_grid_flags(F.col(TS))
    stats = times.groupBy(ITEM).agg(
        F.count(F.lit(1)).alias("n"), F.min(TS).alias("lo"), F.max(TS).alias("hi"),
        *[flag.alias(f"on_{f}") for f, flag in flags.items()])
    pick = None
    for f in flags:
        full = F.col(f"on_{f}") & (F.col("n") == steps_between(F.col("lo"), F.col("hi"), f) + 1)
        full = full & (F.col("n") >= 3)
        pick = F.when(full, f) if pick is None else pick.when(full, f)
    return stats.select(ITEM, pick.otherwise("D").alias("freq"))


def lone_frequency(df: DataFrame) -> str:
    """One frequency for the whole table: what all items agree on, else ``D``."""
    found = infer_frequency(df).agg(F.min("freq").alias("a"), F.max("freq").alias("b")).first()
    return found["a"] if found["a"] and found["a"] == found["b"] else "D"


# --- trimming ------------------------------------------------------------------------


def cap_outliers(df: DataFrame, quantile: float = 0.99) -> DataFrame:
    """Target capped at an item's interpolated quantile."""
    caps = df.groupBy(ITEM).agg(F.percentile(Y, quantile).alias("__cap"))
    return attach(df, caps, [ITEM]).withColumn(Y, F.least(Y, "__cap")).drop("__cap")


def recent_history(df: DataFrame, days: int = 60) -> DataFrame:
    """Rows within ``days`` of each item's last time; raw rows are welcome."""
    last = df.groupBy(ITEM).agg(F.max(TS).alias("__last"))
    kept = attach(df, last, [ITEM], "inner")
    return kept.where(F.col(TS) >= F.col("__last") - F.make_dt_interval(days=F.lit(days))).drop("__last")


def longest_item(df: DataFrame) -> DataFrame:
    return df.groupBy(ITEM).count().orderBy(F.desc("count"), ITEM).limit(1)


def thin(df: DataFrame, k: int | None, *order: str) -> DataFrame:
    """Every ``max(1, n // k)``-th row per item when an item has more than ``k`` rows."""
    if not k:
        return df
    sizes = W.partitionBy(ITEM)
    n = F.count(F.lit(1)).over(sizes)
    position = F.row_number().over(by_item(*order)) - 1
    stride = F.when(n > k, F.greatest(F.lit(1), F.floor(n / k))).otherwise(1)
    return df.withColumn("__keep", position % stride == 0).where("__keep").drop("__keep")


def length_report(df: DataFrame, initial_train: int, horizon: int, reach: int = 0) -> DataFrame:
    """Per item: length and why it cannot be backtested, if it cannot."""
    need = initial_train + horizon
    return (df.groupBy(ITEM).agg(F.count(F.lit(1)).alias("n"))
              .withColumn("problem",
                          F.when(F.col("n") < need, F.lit(f"fewer than {need} rows"))
                           .when(F.lit(reach >= initial_train),
                                 F.lit(f"initial_train must exceed the longest lag or window ({reach})"))))


def series_arrays(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per item with its gridded values in time order.

    Rows per item are bounded by the calendar (see the module note); callers pass gridded
    series only.
    """
    columns = columns or [Y]
    packed = F.array_sort(F.collect_list(F.struct(TS, *columns)))
    grouped = df.groupBy(ITEM).agg(packed.alias("__p"), F.max(TS).alias("last_ts"))
    return grouped.select(ITEM, "last_ts", *[F.col("__p")[c].alias(c) for c in columns])
