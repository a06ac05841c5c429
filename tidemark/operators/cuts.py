"""Sums over the rows before each cut-off, for all cut-offs of an item in one pass.

Every row is counted once, in the segment that ends at the first cut-off behind it; sums up to a
cut-off are running sums over segments.  Rows read grow with rows plus cut-offs, not with their
product.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.series import ITEM

CUT, FOLD = "cut", "fold"
_FAINT = 1e-18  # weights below this share of the newest one are left out


def segments(indexed: DataFrame, plan) -> DataFrame:
    """Rows before an item's last cut-off with ``fold`` and ``cut``: the first cut-off behind the row.

    ``indexed`` has ``rn`` and ``n`` (see ``plans.backtest.index_rows``); ``plan`` is a FoldPlan.
    """
    first, last = plan.first(F.col("n")).cast("int"), plan.count(F.col("n")) - 1
    own = F.ceil((F.col("rn") + 1 - plan.initial) / plan.step).cast("int")
    return (indexed.withColumn(FOLD, F.greatest(first, own)).where(F.col(FOLD) <= last)
                   .withColumn(CUT, (F.lit(plan.initial) + F.col(FOLD) * plan.step).cast("int")))


def cut_table(indexed: DataFrame, plan) -> DataFrame:
    """(item, fold, cut) of every cut-off; ``cut`` is the number of rows before it."""
    lengths = indexed.groupBy(ITEM).agg(F.max("n").alias("n"))
    folds = F.when(plan.count(F.col("n")) > 0, F.sequence(plan.first(F.col("n")).cast("int"), plan.count(F.col("n")) - 1))
    return (lengths.select(ITEM, F.explode(folds).alias(FOLD))
                   .withColumn(CUT, (F.lit(plan.initial) + F.col(FOLD) * plan.step).cast("int")))


def phases(cuts: DataFrame, m: int) -> DataFrame:
    """Each cut-off once per season phase."""
    return cuts.withColumn("phase", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))


def running(column: str, *keys: str) -> Column:
    """Sum over this and earlier segments; 0 for segments without rows."""
    return F.sum(F.coalesce(F.col(column), F.lit(0.0))).over(
        W.partitionBy(*keys).orderBy(FOLD).rowsBetween(W.unboundedPreceding, 0))


def decayed(column: str, place: str, rate: float, gap: int, *keys: str) -> Column:
    """Running sum in which a segment's part fades by ``rate`` for every unit its ``place`` lies back.

    ``gap`` is the least distance in ``place`` of neighbouring segments but for ones without rows;
    it bounds how many segments still count.
    """
    if rate <= 0:
        return F.coalesce(F.col(column), F.lit(0.0))
    back = 1_000_000 if rate >= 1 or gap <= 0 else math.ceil(math.log(_FAINT) / (gap * math.log(rate))) + 1
    frame = W.partitionBy(*keys).orderBy(FOLD).rowsBetween(-back, 0)
    near = F.collect_list(F.struct(F.col(place).alias("p"), F.coalesce(F.col(column), F.lit(0.0)).alias("v"))).over(frame)
    return F.aggregate(near, F.lit(0.0), lambda total, e: total + e["v"] * F.pow(F.lit(rate), F.col(place) - e["p"]))
