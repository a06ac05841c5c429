"""Number of boosted trees and grouped ranking quality against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tidemark.operators import binary, boosting, histograms
from tidemark.plans.classification import row_digest


def brute_auc(pairs):
    pos, neg = [s for y, s in pairs if y == 1], [s for y, s in pairs if y == 0]
    if not pos or not neg:
        return None
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)


def test_grouped_auroc_against_all_pairs(spark):
    rng = random.Random(2)
    rows = [(g, rng.choice([0, 1, 1, None]), rng.choice([None, round(rng.gauss(0, 1), 1)]))
            for g, n in (("a", 900), ("b", 40), ("c", 1)) for _ in range(n)] + [("tied", i % 2, 1.0) for i in range(9)]
    found = {r["g"]: r for r in binary.grouped_auroc(
        spark.createDataFrame(rows, "g string, y int, s double"), "g", "y", "s").collect()}
    for g in ("a", "b", "tied"):
        want = brute_auc([(y, s) for k, y, s in rows if k == g and s is not None])
        assert found[g]["auroc"] == pytest.approx(want)
    assert "c" not in found or found["c"]["auroc"] is None


def _model(spark, rounds):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 3))
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(scale=1.5, size=600) > 0).astype(float)
    df = spark.createDataFrame([(i, float(b), [float(v) for v in a]) for i, (a, b) in enumerate(zip(x, y))],
                               "id int, y double, a array<double>")
    df = df.select("id", "y", array_to_vector("a").alias("features")).persist()
    gbt = GBTClassifier(labelCol="y", maxDepth=3, subsamplingRate=0.8, seed=7, maxIter=rounds)
    return gbt, df.where("id < 400"), df.where("id >= 400")


def test_best_number_of_trees_against_brute_force(spark, tmp_path):
    gbt, train, valid = _model(spark, 12)
    model = gbt.fit(train)
    margins = boosting.prefix_margins(model, valid, "y").collect()
    raw = [r[0] for r in model.transform(valid).select(vector_to_array("rawPrediction")[1]).collect()]
    assert [r["margins"][-1] for r in margins] == pytest.approx(raw)
    want = [brute_auc([(r["y"], r["margins"][i]) for r in margins]) for i in range(12)]
    quality = boosting.prefix_quality(model, valid, "y")
    assert quality == pytest.approx(want)
    best = want.index(max(want)) + 1
    kept, n = boosting.fit_boosted(gbt, train, valid, "y", 12, 6)
    assert n == best if best <= 6 else n <= best
    assert len(kept.treeWeights) == n
    full, _ = boosting.fit_boosted(gbt, train, valid, "y", 12, 50)
    assert len(full.treeWeights) == best
    path = str(tmp_path / "trees")
    full.write().overwrite().save(path)
    again = GBTClassificationModel.load(path)
    ours = [r[0] for r in again.transform(valid).select(vector_to_array("rawPrediction")[1]).collect()]
    assert ours == pytest.approx([r["margins"][best - 1] for r in margins])


def test_patience():
    assert boosting.best_prefix([0.5, 0.7, 0.6, 0.7, 0.9], 2) == (2, True)
    assert boosting.best_prefix([0.5, 0.7, 0.6, 0.7, 0.9], 3) == (5, False)
    assert boosting.best_prefix([None, None], 3) == (2, True)


def test_longer_fit_begins_with_the_shorter(spark):
    gbt, train, _ = _model(spark, 3)
    a, b = gbt.fit(train), gbt.copy({gbt.maxIter: 6}).fit(train)
    assert [t.toDebugString.split("\n", 1)[1] for t in a.trees] == [t.toDebugString.split("\n", 1)[1] for t in b.trees][:3]


def test_row_digest_keeps_places_and_nulls_apart(spark):
    df = spark.createDataFrame([("a|b", "c", 1), ("a", "b|c", 1), ("a", None, 1), (None, "a", 1), ("a", "", 1)],
                               "x string, y string, z int")
    assert df.select(row_digest(df, ["x", "y"])).distinct().count() == 5
    same = df.union(df).select(row_digest(df, ["x", "y", "z"]).alias("k"))
    assert same.distinct().count() == 5 and same.groupBy("k").count().where(F.col("count") != 2).isEmpty()


def _sparse_table(spark, n=1500, terms=40):
    """Three numbers, a flag and ``terms`` rare weights, as sparse and dense vectors; two classes of unequal weight."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(n):
        v = {0: rng.normal(), 1: rng.normal(), 2: float(rng.integers(-2, 3)), 3: float(i % 2)}
        v |= {4 + int(j): float(rng.choice([1.0, 0.7])) for j in rng.choice(terms, size=rng.integers(0, 6), replace=False)}
        y = float(v[0] + v[1] * v[2] + 2 * v.get(5, 0) - v.get(9, 0) + rng.normal() > 0.3)
        width = 4 + terms
        rows.append((y, 2.5 if y else 1.0, Vectors.sparse(width, v) if i % 3 else
                     Vectors.dense([v.get(k, 0.0) for k in range(width)])))
    return spark.createDataFrame(rows, ["y", "w", "features"]).repartition(3).persist()


def test_sparse_trees_are_those_of_spark(spark):
    df = _sparse_table(spark)
    gbt = GBTClassifier(labelCol="y", weightCol="w", maxDepth=4, maxIter=12, subsamplingRate=0.8, seed=42,
                        featureSubsetStrategy="0.7", minInstancesPerNode=30)
    want = gbt.fit(df)
    fit = histograms.Boosting(gbt, df, dense_cells=0)
    assert fit.grow(5).getNumTrees == 5
    made = fit.grow(12)
    fit.close()
    number = r"-?\d+\.\d+(?:E-?\d+)?"
    for a, b in zip(want.trees, made.trees):
        a, b = (t.toDebugString.split("\n", 1)[1] for t in (a, b))
        assert re.sub(number, "", a) == re.sub(number, "", b)
        assert [float(x) for x in re.findall(number, a)] == pytest.approx([float(x) for x in re.findall(number, b)])
    assert made.treeWeights == want.treeWeights and made.numFeatures == want.numFeatures
    assert made.getFeaturesCol() == "features" and made.getMaxDepth() == 4
    df.unpersist()


def test_a_wide_row_costs_what_it_holds(spark):
    df = _sparse_table(spark, 300)
    fit = histograms.Boosting(GBTClassifier(labelCol="y", maxDepth=2, maxIter=1), df, dense_cells=0)
    kept = sum(len(b.rows) for b in fit.blocks.collect())
    full = df.select(F.sum(F.aggregate(vector_to_array("features"), F.lit(0), lambda n, x: n + (x != 0).cast("int")))).first()[0]
    assert 0 < kept <= full < 300 * 44 / 4
    fit.close()


def test_draws_are_those_of_spark(spark):
    for seed in (42, -7, 2 ** 62 + 5):
        theirs = spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed)
        want = [theirs.nextDouble() for _ in range(40)]
        assert histograms.uniform(seed, 0, 40).tolist() == want and histograms.uniform(seed, 33, 7).tolist() == want[33:]
