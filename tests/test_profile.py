"""Profiles and terms against plain Python on small tables."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.config import ClassifyConfig
from tidemark.operators import columns, encode, profile
from tidemark.operators.values import LONG

SCHEMA = "d double, f float, s string, t timestamp, m map<string,int>, a array<double>, b binary, z struct<p:int,q:string>"


def rows():
    long = "x" * (LONG + 1)
    return [(0.0, 1.5, long, None, {"k": 1}, [1.0, None], b"ab", (1, None)),
            (-0.0, 1.5, long + "y", None, {"k": 1}, [None, 1.0], b"ab", (None, "1")),
            (float("nan"), None, "", None, {}, [], b"", (1, None)),
            (float("nan"), 2.5, None, None, None, None, None, None),
            (None, 0.1, "12", None, {"k": None}, [1.0, None], b"a" * 200, (1, "")),
            (0.1, 0.1, "12 ", None, {"k": 2}, [1.0], b"a" * 201, (1, ""))]


def test_quick_profile_counts_values_as_spark_does(spark):
    df = spark.createDataFrame(rows(), SCHEMA).withColumn("t", F.expr(
        "timestampadd(MICROSECOND, coalesce(try_cast(d * 10 as int), 0), timestamp '2024-10-27 00:30:00')"))
    found = profile.quick_profile(df).collect()
    assert [r["name"] for r in found] == df.columns
    for r in found:
        c = F.col(r["name"])
        value = F.to_json(c) if r["name"] == "m" else c
        want = df.agg(F.countDistinct(value) + F.max(c.isNull().cast("int"))).first()[0]
        assert (r["name"], r["nunique"], r["rows"]) == (r["name"], want, 6)
        assert r["missing_rate"] == df.where(c.isNull()).count() / 6


def test_quick_profile_of_an_empty_table_and_odd_names(spark):
    df = spark.createDataFrame([], "`a.b` int, value string, i long, n array<int>")
    found = profile.quick_profile(df).collect()
    assert [(r["name"], r["missing_rate"], r["nunique"], r["rows"]) for r in found] == [
        (c, 0.0, 0, 0) for c in df.columns]
    one = spark.createDataFrame([(1, None, 2, [1]), (1, "x", 3, None)], df.schema)
    assert [(r["name"], r["missing_rate"], r["nunique"]) for r in profile.quick_profile(one).collect()] == [
        ("a.b", 0.0, 1), ("value", 0.5, 2), ("i", 0.0, 2), ("n", 0.5, 2)]


def test_column_profile_against_plain_python(spark):
    rng = random.Random(5)
    texts = [rng.choice(["12", " 3.5", "abc", "2024-01-02", "2024/01/02", None, "", "1" * (LONG + 3), "w " * LONG])
             for _ in range(400)]
    df = spark.createDataFrame([(t, i % 3 or None, float(i)) for i, t in enumerate(texts)], "s string, k int, `x.y` double")
    found = columns.profile_columns(df)
    known = [t for t in texts if t is not None]
    s = found["s"]
    assert (s.n, s.nulls, s.distinct) == (400, 400 - len(known), len(set(known)))
    assert s.mean_length == pytest.approx(sum(map(len, known)) / len(known))
    digits = sum(re.fullmatch(r"\s*[\d.]+\s*", t) is not None for t in known)
    assert s.numeric_ratio == pytest.approx(digits / len(known))
    assert s.shape_ratio == pytest.approx(max(known.count("2024-01-02"), known.count("2024/01/02")) / len(known))
    assert (found["k"].nulls, found["k"].distinct, found["x.y"].distinct) == (134, 2, 400)
    none = columns.profile_columns(df.where(F.lit(False)))
    assert [(p.n, p.nulls, p.distinct, p.mean_length) for p in none.values()] == [(0, 0, 0, 0.0)] * 3


def brute_tfidf(texts, cfg):
    docs = []
    for t in texts:
        w = re.findall(r"\w{2,}", (t or "").lower())
        docs.append(Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]))
    df, total = Counter(t for d in docs for t in d), Counter()
    for d in docs:
        total.update(d)
    ok = [t for t in df if cfg.tfidf_min_df <= df[t] <= cfg.tfidf_max_df * len(docs)]
    top = sorted(ok, key=lambda t: (-total[t], t))[:cfg.tfidf_max_features]
    idf = {t: math.log((1 + len(docs)) / (1 + df[t])) + 1 for t in top}
    out = {}
    for i, d in enumerate(docs):
        w = {t: n * idf[t] for t, n in d.items() if t in idf}
        norm = math.sqrt(sum(v * v for v in w.values()))
        out.update({(i, t): v / norm for t, v in w.items()})
    return out


def test_tfidf_against_plain_python(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("red Blue green ab a b_c zz été".split()) for _ in range(rng.randint(0, 12)))
             for _ in range(60)] + [None, "", "a", "red " * 500]
    cfg = ClassifyConfig(tfidf_max_features=20)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    got = {(r["id"], r["term"]): r["weight"] for r in encode.tfidf(df, "id", "body", cfg).collect()}
    want = brute_tfidf(texts, cfg)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    assert encode.tfidf(df.where(F.col("id") < 0), "id", "body").collect() == []
