"""Forecast evaluation: joining truth to prediction, error tables, residual checks."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import metrics as M
from tidemark.operators.series import ITEM, TS, Y, by_item

HAT = "y_hat"


def align(truth: DataFrame, prediction: DataFrame) -> DataFrame:
    """Inner join on (item, time), finite pairs only: ``item_id, timestamp, target, y_hat``."""
    pairs = truth.select(ITEM, TS, Y).join(prediction.select(ITEM, TS, HAT), [ITEM, TS])
    return pairs.where(M.is_finite(F.col(Y)) & M.is_finite(F.col(HAT)))


def require_overlap(pairs: DataFrame) -> DataFrame:
    if pairs.isEmpty():
        raise ValueError("no (item, time) pairs in common between truth and prediction")
    return pairs


def error_columns(y: str = Y, y_hat: str = HAT) -> list[Column]:
    a, b = F.col(y), F.col(y_hat)
    return [M.rmse(a, b).alias("rmse"), M.mae(a, b).alias("mae"), M.mape(a, b).alias("mape"),
            M.smape(a, b).alias("smape")]


def error_table(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    return pairs.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), *error_columns())


def worst_items(pairs: DataFrame, k: int = 5) -> DataFrame:
    scored = pairs.groupBy(ITEM).agg(M.smape(F.col(Y), F.col(HAT)).alias("smape"))
    return scored.orderBy(F.desc("smape"), ITEM).limit(k)


def naive_scale(insample: DataFrame, m: int, denominator: str = "seasonal") -> DataFrame:
    """Mean absolute naive step per item: lag-``m`` difference, or the ``m``-th order one."""
    w = by_item()
    if denominator == "seasonal":
        step = F.col(Y) - F.lag(Y, m).over(w)
    elif denominator == "order":
        step = sum((F.lit(float((-1) ** j * comb(m, j))) * F.lag(Y, j).over(w) for j in range(m + 1)),
                   F.lit(0.0))
    else:
        raise ValueError("denominator must be 'seasonal' or 'order'")
    return (insample.withColumn("__d", F.abs(step))
                    .groupBy(ITEM).agg((F.avg("__d") + M.EPS).alias("scale")))


def mase(pairs: DataFrame, insample: DataFrame, m: int, denominator: str = "seasonal") -> DataFrame:
    """MASE per item; the scale never reaches across items."""
    errors = pairs.groupBy(ITEM).agg(M.mae(F.col(Y), F.col(HAT)).alias("mae"))
    return (errors.join(naive_scale(insample, m, denominator), ITEM, "left")
                  .select(ITEM, (F.col("mae") / F.col("scale")).alias("mase")))


def residuals(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("residual", F.col(Y) - F.col(HAT)).dropna(subset=["residual"])


def residual_summary(pairs: DataFrame) -> DataFrame:
    """Count, mean, sample deviation, range and quartiles of the residuals, per item.

    Residuals of a backtest are one per grid step and fold, so an item's quartiles are taken
    over a calendar-bounded group.
    """
    e = "residual"
    return (residuals(pairs).groupBy(ITEM).agg(
        F.count(e).alias("count"), F.avg(e).alias("mean"), F.stddev_samp(e).alias("std"),
        F.min(e).alias("min"), F.percentile(e, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"),
        F.max(e).alias("max"))
        .select(ITEM, "count", "mean", "std", "min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"),
                F.col("q")[2].alias("p75"), "max"))


def ljung_box(pairs: DataFrame, lags: int = 10) -> DataFrame:
    """Ljung-Box statistic and p-value per item.

    Residuals stand in time order, or by fold and step where ``pairs`` has these: folds that
    overlap hold the same time more than once.  ``lags`` is even, so the chi-square tail is a
    finite sum.
    """
    if lags % 2:
        raise ValueError("lags must be even")
    res = residuals(pairs)
    centred = res.withColumn("__c", F.col("residual") - F.avg("residual").over(W.partitionBy(ITEM)))
    w = by_item("fold", "h") if {"fold", "h"} <= set(pairs.columns) else by_item()
    products = centred.withColumns({f"__p{k}": F.col("__c") * F.lag("__c", k).over(w)
                                    for k in range(1, lags + 1)})
    sums = products.groupBy(ITEM).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("__c") * F.col("__c")).alias("__v"),
        *[F.sum(f"__p{k}").alias(f"__s{k}") for k in range(1, lags + 1)])
    terms = [F.try_divide(F.pow(F.coalesce(F.col(f"__s{k}"), F.lit(0.0)) / F.col("__v"), 2), F.col("n") - k)
             for k in range(1, lags + 1)]
    q = F.col("n") * (F.col("n") + 2) * sum(terms[1:], terms[0])
    tail, fact = [], 1.0
    for i in range(lags // 2):
        fact *= max(i, 1)
        tail.append(F.pow(F.col("lb_stat") / 2, i) / fact)
    return (sums.where(F.col("__v") > 0).select(ITEM, "n", q.alias("lb_stat"))
                .withColumn("lb_pvalue", F.exp(-F.col("lb_stat") / 2) * sum(tail[1:], tail[0])))
