"""Exact top-k against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.queries import op1_topk
from tidemark.llm.topk import best, products, statistics, top_k


def brute(rows, k):
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
             if i is not None and v is not None and not any(x is None or not math.isfinite(x) for x in v)]
    out = []
    for at, (q, own) in enumerate(whole):
        if q % 20 == 0:
            scored = sorted((-max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(own, v)))), i) for other, (i, v) in enumerate(whole)
                            if other != at and len(v) == len(own))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_bounds_hold():
    r = np.random.default_rng(1)
    for n in (1, 3, 7, 64):
        q, c = r.integers(-90, 90, (40, n)), r.integers(-90, 90, (50, n))
        for s in (1, 4, 8, 16):
            bound = statistics(q.astype(float), s) @ statistics(c.astype(float), s).T
            assert (bound + 1e-3 >= products(q, c)).all()


def test_many_rows_prune_nothing_needed():
    r = np.random.default_rng(3)
    c = r.integers(-40, 40, (5000, 16)) * r.integers(1, 4, (5000, 1))
    ids = r.permutation(5000)
    q = c[:50]
    exact = q @ c.T
    floor = np.array([-np.inf, *np.sort(exact, axis=1)[1:40, -10], *np.full(10, 1e12)])
    for given in (None, floor):
        place, vec, score = best(q, ids, c, 20, given)
        for i in range(50):
            want = sorted((-s, v) for s, v in zip(exact[i].tolist(), ids.tolist()) if given is None or s >= given[i])[:20]
            assert [(-s, v) for v, s in zip(vec[place == i].tolist(), score[place == i].tolist())] == want


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in op1_topk(spark, sf).collect()) == brute(rows, 20)


def test_edges(spark):
    r = random.Random(4)
    rows = [(i, [r.choice([-1.5, 0.2, 0.99, 3.0]) for _ in range(5)]) for i in range(60)]
    rows += [(100, None), (120, [1.0, None, 2.0, 1.0, 1.0]), (140, [float("nan")] * 5), (160, [float("inf")] * 5),
             (180, []), (181, []), (200, [1.0, 2.0]), (None, [1.0] * 5), (20, [9.0] * 5), (20, [-9.0] * 5),
             (220, [1e9] * 3), (221, [1e9] * 3), (240, [1e17] * 4), (241, [1e17] * 4)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    got = sorted(tuple(x) for x in top_k(df, F.col("vec_id") % 20 == 0).collect())
    assert got == brute(rows, 20)
    assert top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_every_row_of_an_id_counts(spark):
    r = random.Random(8)
    rows = [(r.choice([20, 20, 21, 40, 7, i]), [r.choice([-1.0, 0.5, 2.0]) for _ in range(3)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    wide = df.toDF("vec_id", "embedding").selectExpr("vec_id", "embedding", "'x' AS own", "1 AS mark")
    assert sorted(tuple(x) for x in top_k(wide, F.col("vec_id") % 20 == 0, k=5).collect()) == brute(rows, 5)
    clash = df.select("vec_id", "embedding", F.lit(1)).toDF("vec_id", "embedding", "Vec_Id")
    assert sorted(tuple(x) for x in top_k(clash, F.col("vec_id") % 20 == 0, k=400).collect()) == brute(rows, 400)


def test_rounds_of_cells(spark, monkeypatch):
    from tidemark.llm import topk
    monkeypatch.setattr(topk, "QUERY_BLOCK", 100)
    r = np.random.default_rng(5)
    v = (r.integers(-128, 128, (22_000, 8)) / 64).tolist()
    df = spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>")
    got = {}
    for x in top_k(df, F.col("vec_id") % 100 == 0, k=9).collect():  # 11 columns: rounds of 1, 7 and 3
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    whole = np.floor(64 * np.array(v)).astype(np.int64)
    for q in range(0, 22_000, 100):
        score = whole @ whole[q]
        score[q] = -10**9
        order = np.lexsort((np.arange(len(score)), -score))[:9]
        assert sorted(got[q]) == [(n + 1, int(i), int(score[i])) for n, i in enumerate(order)]
