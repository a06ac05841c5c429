"""Calendar arithmetic on TIMESTAMP_NTZ, free of any session zone.

Frequencies: ``H`` hour, ``D`` day, ``W`` seven days (buckets close on Sunday),
``M`` month end, ``MS`` month start.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.config import FIXED_HOLIDAYS

FREQUENCIES = ("H", "D", "W", "M", "MS")
NTZ = "timestamp_ntz"


def check_freq(freq: str) -> str:
    name = freq.upper().split("-")[0]
    name = {"ME": "M"}.get(name, name)
    if name not in FREQUENCIES:
        raise ValueError(f"unsupported frequency {freq!r}; use one of {FREQUENCIES}")
    return name


def bucket(ts: Column, freq: str) -> Column:
    """Label of the bin holding ``ts``: bin start for H, D, MS; closing day for W and M."""
    day = F.to_date(ts)
    if freq == "H":
        return day.cast(NTZ) + F.make_dt_interval(hours=F.hour(ts))
    if freq == "W":
        day = F.date_add(F.trunc(day, "week"), 6)
    elif freq == "M":
        day = F.last_day(day)
    elif freq == "MS":
        day = F.trunc(day, "month")
    return day.cast(NTZ)


def plus_steps(ts: Column, k: Column | int, freq: str) -> Column:
    k = F.lit(k) if isinstance(k, int) else k
    if freq == "H":
        return ts + F.make_dt_interval(hours=k)
    if freq == "D":
        return ts + F.make_dt_interval(days=k)
    if freq == "W":
        return ts + F.make_dt_interval(days=k * 7)
    moved = F.add_months(F.to_date(ts), k)
    return _at_clock_of(F.last_day(moved) if freq == "M" else F.trunc(moved, "month"), ts)


def _at_clock_of(day: Column, ts: Column) -> Column:
    """That day at the time of day of ``ts``."""
    return day.cast(NTZ) + (ts - F.to_date(ts).cast(NTZ))


def first_on_grid(ts: Column, freq: str) -> Column:
    """The first point of a grid that is not before ``ts``; only months have fixed points."""
    day = F.to_date(ts)
    if freq == "M":
        return _at_clock_of(F.last_day(day), ts)
    if freq == "MS":
        month = F.trunc(day, "month")
        return _at_clock_of(F.when(day == month, month).otherwise(F.add_months(month, 1)), ts)
    return ts


def _clock(ts: Column) -> Column:
    """Seconds since midnight, with fractions."""
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.extract(F.lit("SECOND"), ts)


def steps_between(lo: Column, hi: Column, freq: str) -> Column:
    """Whole steps from ``lo`` to ``hi``, never more than fit."""
    if freq in ("M", "MS"):
        months = (F.year(hi) - F.year(lo)) * 12 + F.month(hi) - F.month(lo)
        return months - (plus_steps(lo, months, freq) > hi).cast("int")
    seconds = F.datediff(hi, lo).cast("long") * 86400 + (_clock(hi) - _clock(lo))
    width = {"H": 3600, "D": 86400, "W": 7 * 86400}[freq]
    return F.floor(seconds / width).cast("int")


def on_grid_flags(ts: Column) -> dict[str, Column]:
    """Aggregates that are true when all times of a group share one grid."""
    clock = _clock(ts)
    same_clock = F.min(clock) == F.max(clock)
    minute = F.minute(ts) * 60 + F.extract(F.lit("SECOND"), ts)
    return {
        "H": F.min(minute) == F.max(minute),
        "D": same_clock,
        "W": same_clock & (F.min(F.weekday(ts)) == F.max(F.weekday(ts))),
        "M": same_clock & F.bool_and(F.to_date(ts) == F.last_day(ts)),
        "MS": same_clock & F.bool_and(F.dayofmonth(ts) == 1),
    }


def is_holiday(ts: Column, holidays=FIXED_HOLIDAYS) -> Column:
    """Fixed-date holidays; a time of day other than midnight never matches."""
    code = F.month(ts) * 100 + F.dayofmonth(ts)
    midnight = ts == F.to_date(ts).cast(NTZ)
    return (code.isin([m * 100 + d for m, d in holidays]) & midnight).cast("int")


def calendar_columns(ts: Column) -> dict[str, Column]:
    day = F.to_date(ts)
    return {
        "dow": F.weekday(ts),
        "weekofyear": F.weekofyear(ts),
        "month": F.month(ts),
        "quarter": F.quarter(ts),
        "day": F.dayofmonth(ts),
        "is_month_start": (F.dayofmonth(ts) == 1).cast("int"),
        "is_month_end": (day == F.last_day(day)).cast("int"),
        "is_weekend": (F.weekday(ts) >= 5).cast("int"),
        "year": F.year(ts),
        "is_holiday": is_holiday(ts),
    }


CALENDAR_NAMES = ("dow", "weekofyear", "month", "quarter", "day", "is_month_start",
                  "is_month_end", "is_weekend", "year", "is_holiday")


def expand_datetime(name: str, ts: Column) -> dict[str, Column]:
    """Datetime column of a feature table as six numbers; a null hour counts as zero."""
    day = F.to_date(ts)
    return {
        f"{name}__year": F.year(ts),
        f"{name}__month": F.month(ts),
        f"{name}__dow": F.weekday(ts),
        f"{name}__hour": F.coalesce(F.hour(ts), F.lit(0)),
        f"{name}__month_start": F.coalesce(F.dayofmonth(ts) == 1, F.lit(False)).cast("int"),
        f"{name}__month_end": F.coalesce(day == F.last_day(day), F.lit(False)).cast("int"),
    }
