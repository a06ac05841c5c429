"""Scaling, clustering and anomaly queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.common import rounded, spread_table, table
from tidemark.operators import cluster, isolation, keyed
from tidemark.plans import unsupervised as runs

QUERIES, ORACLES = {}, {}
WIDTH = 64  # length of the test embeddings
_DIMS = [f"x{i}" for i in range(WIDTH)]


def register(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return keep


def points(spark, d):
    e = spread_table(spark, d, "embeddings")
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(_DIMS)])


@register("standardize", """SELECT s_suppkey, round((s_acctbal - avg(s_acctbal) OVER ()) / stddev_pop(s_acctbal) OVER (), 6) AS s_acctbal,
  round((s_nationkey - avg(s_nationkey) OVER ()) / stddev_pop(s_nationkey) OVER (), 6) AS s_nationkey FROM supplier""")
def standardize(spark, d):
    rows, names = cluster.numeric_complete(table(spark, d, "supplier"), ["s_suppkey"])
    return rounded(cluster.standardize(rows, names))


@register("numeric_complete", """SELECT doc_id::DOUBLE AS doc_id, n_chars::DOUBLE AS n_chars, quality::DOUBLE AS quality,
  toxic::DOUBLE AS toxic FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL""")
def numeric_complete(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return cluster.numeric_complete(j)[0]


@register("silhouette_euclid", """WITH p AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
  s AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.x, b.x)) AS total, count(*) AS n
        FROM p a, p b WHERE a.vec_id <> b.vec_id GROUP BY ALL),
  ab AS (SELECT vec_id, min(total / n) FILTER (label = other) AS a, min(total / n) FILTER (label <> other) AS b
         FROM s GROUP BY 1)
  SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 5) AS silhouette FROM ab""")
def silhouette_euclid(spark, d):
    return rounded(cluster.silhouette(points(spark, d), "vec_id", "label", _DIMS, block=512), 5)


@register("silhouette_squared", """WITH p AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
  s AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.x, b.x) ** 2) AS total, count(*) AS n
        FROM p a, p b WHERE a.vec_id <> b.vec_id GROUP BY ALL),
  ab AS (SELECT vec_id, min(total / n) FILTER (label = other) AS a, min(total / n) FILTER (label <> other) AS b
         FROM s GROUP BY 1)
  SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 5) AS silhouette_squared FROM ab""")
def silhouette_squared(spark, d):
    return rounded(cluster.squared_silhouette(points(spark, d), "label", _DIMS), 5)


@register("p01_threshold", """SELECT l_extendedprice AS p01 FROM lineitem ORDER BY 1
  LIMIT 1 OFFSET (SELECT CAST(floor(0.01 * count(*)) AS BIGINT) FROM lineitem)""")
def p01_threshold(spark, d):
    """The value at position int(0.01 n) of a given score."""
    li = table(spark, d, "lineitem")
    value = isolation.low_order_value(li, "l_extendedprice")
    return li.where(F.col("l_extendedprice") == value).agg(F.max("l_extendedprice").alias("p01"))


@register("exact_quantiles", """SELECT round(quantile_cont(l_extendedprice, 0.01), 6) AS q01,
  round(quantile_cont(l_extendedprice, 0.5), 6) AS q50, round(quantile_cont(l_extendedprice, 0.99), 6) AS q99,
  count(*) AS rows FROM lineitem""")
def exact_quantiles(spark, d):
    """Quantiles found by narrowing, without holding the column in one place."""
    li = table(spark, d, "lineitem")
    found = {n: keyed.quantiles(li, ["l_extendedprice"], p)["l_extendedprice"]
             for n, p in (("q01", 0.01), ("q50", 0.5), ("q99", 0.99))}
    return li.agg(*[F.round(F.max(F.lit(v)), 6).alias(n) for n, v in found.items()], F.count(F.lit(1)).alias("rows"))


@register("kmeans")
def kmeans(spark, d):
    run = runs.run_clustering(points(spark, d), 10, keep=["vec_id", "label"])
    return run.rows.select("vec_id", "label", "cluster")


@register("isolation_forest")
def isolation_forest(spark, d):
    li = spread_table(spark, d, "lineitem")
    return runs.run_anomaly(li, keep=["l_orderkey"]).rows.select("l_orderkey", "raw_score", "decision", "anomaly")
