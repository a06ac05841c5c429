"""How many boosted trees to keep: ranking quality after every tree, and patience."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark import SparkContext
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.binary import grouped_auroc
from tidemark.operators.histograms import Boosting


def leaf_values(model: GBTClassificationModel) -> list[np.ndarray]:
    """What each leaf adds to the margin, per tree, by the leaf numbers that ``leafCol`` gives.

    Spark numbers leaves from left to right, which is the order its own description lists them in.
    Trees times leaves is bounded by the parameters of the fit.
    """
    return [w * np.array([float(v) for v in re.findall(r"Predict: (\S+)", tree.toDebugString)])
            for tree, w in zip(model.trees, model.treeWeights)]


def leaf_numbers(model: GBTClassificationModel, df: DataFrame) -> DataFrame:
    """Rows with ``__leaf``, the leaf of each tree."""
    return model.copy().setLeafCol("__leaf").transform(df).withColumn("__leaf", vector_to_array("__leaf"))


def _running(model: GBTClassificationModel):
    values = leaf_values(model)
    table = np.zeros((len(values), max(len(v) for v in values)))
    for i, v in enumerate(values):
        table[i, :len(v)] = v
    trees = np.arange(len(values))

    @F.pandas_udf("array<double>")
    def running(leaves: pd.Series) -> pd.Series:
        if not len(leaves):
            return pd.Series([], dtype=object)
        picked = table[trees, np.vstack(leaves.to_numpy()).astype(np.int64)]
        return pd.Series(list(np.cumsum(picked, axis=1)))

    return running


def prefix_margins(model: GBTClassificationModel, df: DataFrame, label: str) -> DataFrame:
    """(label, margins): the margin of each row after the first, second, ... tree; one pass over the rows."""
    return leaf_numbers(model, df).select(label, _running(model)("__leaf").alias("margins"))


def prefix_quality(model: GBTClassificationModel, valid: DataFrame, label: str) -> list[float | None]:
    """AUROC on ``valid`` after each tree: one value per tree reaches the driver.

    Rows in the same leaves have the same margins and are counted first.
    """
    alike = leaf_numbers(model, valid).groupBy(label, "__leaf").agg(F.count(F.lit(1)).alias("rows"))
    rows = alike.select(label, "rows", F.posexplode(_running(model)("__leaf")).alias("trees", "margin"))
    found = {r["trees"]: r["auroc"] for r in grouped_auroc(rows, "trees", label, "margin", "rows").collect()}
    return [found.get(i) for i in range(len(model.treeWeights))]


def best_prefix(quality: list[float | None], patience: int) -> tuple[int, bool]:
    """Trees up to the best value before ``patience`` rounds without a better one, the fewest on ties;
    and whether that many rounds have passed.  Without any value (one class only) all trees stay."""
    best, at = None, 0
    for i, q in enumerate(quality):
        if q is not None and (best is None or q > best):
            best, at = q, i + 1
        elif best is not None and i + 1 - at >= patience:
            return at, True
    return (at, False) if at else (len(quality), True)


def truncated(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The model of the first ``n`` trees."""
    if n >= len(model.treeWeights):
        return model
    gateway, jvm = SparkContext._gateway, SparkContext._jvm
    kind = jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
    trees, weights = gateway.new_array(kind, n), gateway.new_array(gateway.jvm.double, n)
    for i, (tree, w) in enumerate(zip(model.trees[:n], model.treeWeights[:n])):
        trees[i], weights[i] = tree._java_obj, float(w)
    made = GBTClassificationModel(jvm.org.apache.spark.ml.classification.GBTClassificationModel(
        f"{model.uid}_{n}", trees, weights))
    made._transfer_params_from_java()
    return made.setFeaturesCol(model.getFeaturesCol()).setPredictionCol(model.getPredictionCol())


def fit_boosted(gbt: GBTClassifier, train: DataFrame, valid: DataFrame, label: str, rounds: int,
                patience: int) -> tuple[GBTClassificationModel, int]:
    """Model of the best number of trees by AUROC on ``valid``, and that number.

    Fits of two, four, ... times ``patience`` rounds, until patience has run out or all
    ``rounds`` are done; the seed fixes each round, so a longer fit begins with the shorter one's trees.
    """
    n, fit = min(rounds, 2 * patience), Boosting(gbt, train)
    while True:
        model = fit.grow(n)
        best, over = best_prefix(prefix_quality(model, valid, label), patience)
        if over or n >= rounds:
            fit.close()
            return truncated(model, best), best
        n = min(rounds, 2 * n)
