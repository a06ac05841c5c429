import random

from pyspark.sql import functions as F

from tidemark.operators import keyed


def test_order_statistics_match_sorting(spark, monkeypatch):
    monkeypatch.setattr(keyed, "_KEEP", 50)
    rng = random.Random(7)
    cases = {
        "spread": [rng.gauss(0, 1) for _ in range(3000)],
        "ties": [1.0] * 2000 + [rng.random() for _ in range(1000)],
        "two": [0.0] * 1500 + [5.0] * 1500,
        "ends": [0.0] * 1400 + [rng.random() + 1 for _ in range(200)] + [9.0] * 1400,
    }
    df = spark.createDataFrame([tuple(cases[c][i] for c in cases) for i in range(3000)], list(cases))
    for p in (0.0, 0.01, 0.5, 0.66, 0.99, 1.0):
        found = keyed.quantiles(df, list(cases), p)
        for name, values in cases.items():
            s, at = sorted(values), p * 2999
            low, high = s[int(at)], s[min(int(at) + 1, 2999)]
            assert abs(found[name] - (low + (high - low) * (at - int(at)))) < 1e-12, (name, p)
    wrong_hint = {"x": keyed.Rank(F.col("spread"), lambda n: [10, 2500], 0.5)}
    s = sorted(cases["spread"])
    assert keyed.order_statistics(df, wrong_hint)["x"] == [s[10], s[2500]]


def test_order_statistics_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert keyed.quantiles(df, ["x"], 0.5) == {"x": None}


def test_running_totals_match_sorting(spark):
    rows = [(float(i * i % 997), 1) for i in range(2000)]
    counts = spark.createDataFrame(rows, "s double, n int").groupBy("s").agg(F.sum("n").alias("n"))
    got = {r["s"]: r["cum_n"] for r in keyed.running_totals(counts, "s", ["n"], descending=True, buckets=7).collect()}
    total = 0
    by_score = {}
    for s, n in rows:
        by_score[s] = by_score.get(s, 0) + n
    for s in sorted(by_score, reverse=True):
        total += by_score[s]
        assert got[s] == total


def test_hash_rank_numbers_each_group_without_gaps(spark):
    df = spark.range(1000).withColumn("g", (F.col("id") % 10 == 0).cast("int"))
    ranked = keyed.hash_rank(df, ["g"], ["id"], buckets=16)
    for g, n in ((0, 900), (1, 100)):
        assert sorted(r["rank"] for r in ranked.where(F.col("g") == g).collect()) == list(range(1, n + 1))


def test_attach_keeps_every_row_of_a_hot_key(spark):
    df = spark.range(500).select(F.when(F.col("id") < 300, "hot").otherwise("cold").alias("k"), "id")
    facts = spark.createDataFrame([("hot", 1), ("cold", 2)], "k string, v int")
    out = keyed.attach(df, facts, ["k"])
    assert out.count() == 500
    assert out.where("(k = 'hot') = (v = 1)").count() == 500
