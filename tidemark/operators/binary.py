"""Measures of a binary score: class counts, ranking and threshold metrics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.keyed import grouped_totals, running_totals

# The decision thresholds that are tried.
THRESHOLDS = tuple(float(t) for t in np.linspace(0.05, 0.95, 19))


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.where(F.col(label).isNotNull()).groupBy(label).count()


def positive_weight(df: DataFrame, label: str, ratio: float = 3.0) -> DataFrame:
    """One row: n0, n1 and the weight of the positive class."""
    y = F.col(label)
    counts = df.agg(F.count_if(y == 0).alias("n0"), F.count_if(y == 1).alias("n1"))
    r = F.col("n0") / F.greatest(F.col("n1"), F.lit(1))
    return counts.withColumn("weight", F.when((F.col("n0") > 0) & (F.col("n1") > 0) & (r >= ratio), r)
                             .otherwise(1.0))


def _prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide(tp, tp + fp), zero)
    recall = F.coalesce(F.try_divide(tp, tp + fn), zero)
    f1 = F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), zero)
    return precision, recall, f1


def score_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score."""
    y = F.col(label)
    return (df.where(y.isNotNull() & F.col(score).isNotNull()).groupBy(score)
              .agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")))


def binary_metrics(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """One row: AUROC (ties averaged), average precision, accuracy, precision, recall, F1.

    Works on counts per distinct score; their running totals come from even score ranges,
    so neither equal scores nor a crowded range end up in one task.
    """
    counts = score_counts(df, label, score)
    ranked = running_totals(counts, score, ["pos", "neg"], descending=True)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    cum_pos, cum_neg = F.col("cum_pos").cast("double"), F.col("cum_neg").cast("double")
    hit = F.col(score) >= threshold
    sums = ranked.agg(
        F.sum(pos).alias("p"), F.sum(neg).alias("n"),
        F.sum(pos * (neg / 2 - cum_neg)).alias("below"),
        F.sum(pos * cum_pos / (cum_pos + cum_neg)).alias("ap"),
        F.sum(F.when(hit, pos).otherwise(0.0)).alias("tp"),
        F.sum(F.when(hit, neg).otherwise(0.0)).alias("fp"))
    p, n, tp, fp = (F.col(c) for c in ("p", "n", "tp", "fp"))
    precision, recall, f1 = _prf(tp, fp, p - tp)
    return sums.select(
        F.try_divide(F.col("below") + p * n, p * n).alias("auroc"),
        F.try_divide(F.col("ap"), p).alias("pr_auc"),
        F.try_divide(tp + n - fp, p + n).alias("accuracy"),
        precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def grouped_auroc(df: DataFrame, within: str, label: str, score: str, rows: str | None = None) -> DataFrame:
    """(within, pos, neg, auroc): ties averaged, null where a group lacks one of the classes.

    One pass counts both classes per group and distinct score; equal scores meet before they travel.
    ``rows`` says for how many rows a row stands.
    """
    y, n = F.col(label), F.lit(1) if rows is None else F.col(rows)
    counts = (df.where(y.isNotNull() & F.col(score).isNotNull() & F.col(within).isNotNull()).groupBy(within, score)
                .agg(F.sum(F.when(y == 1, n).otherwise(0)).alias("pos"), F.sum(F.when(y == 0, n).otherwise(0)).alias("neg")))
    ranked = grouped_totals(counts, within, score, ["neg"])
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    sums = ranked.groupBy(within).agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"),
        F.sum(pos * (F.col("cum_neg") - neg / 2)).alias("below"))
    return sums.select(within, "pos", "neg", F.try_divide(
        "below", F.col("pos").cast("double") * F.col("neg")).alias("auroc"))


def threshold_table(df: DataFrame, label: str, score: str, thresholds=THRESHOLDS) -> DataFrame:
    """Confusion counts and F1 at every threshold.

    Rows are counted by how many thresholds their score passes, at most one bin more than
    there are thresholds, and only those bins are spread over the thresholds.
    """
    y, s = F.col(label), F.col(score)
    passed = sum(((s >= F.lit(t)).cast("int") for t in thresholds), F.lit(0))
    bins = (df.where(y.isNotNull() & s.isNotNull()).groupBy(passed.alias("passed"))
              .agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")))
    entries = F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(i).alias("i"))
                        for i, t in enumerate(thresholds)])
    hit = F.col("passed") > F.col("i")
    table = (bins.select("passed", "pos", "neg", F.inline(entries))
                 .groupBy("threshold")
                 .agg(F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
                      F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
                      F.sum(F.when(hit, 0).otherwise(F.col("pos"))).alias("fn")))
    return table.withColumn("f1", _prf(F.col("tp"), F.col("fp"), F.col("fn"))[2])


def best_threshold(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: the threshold with the highest F1, the lowest such threshold on ties."""
    table = threshold_table(df, label, score)
    order = F.struct(F.col("f1"), (-F.col("threshold")).alias("t"))
    return table.agg(F.max_by("threshold", order).alias("threshold"), F.max("f1").alias("f1"))
