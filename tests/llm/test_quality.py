"""The quality classifier: held-out labels, shrinkage, hard rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.quality import classify, fit, keep_good, site_priors


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2))
    model = fit(docs, labels.where(half == 0))
    judged = classify(docs, model).join(labels.where(half == 1), "doc_id").collect()
    good = np.array([r.quality == 1 and r.toxic == 0 for r in judged])
    keep = np.array([r.keep for r in judged])
    assert (keep == good).mean() > 0.93 and keep[good].mean() > 0.97
    assert keep[[r.quality == 0 for r in judged]].mean() < 0.05


def test_sparse_sites_shrink(spark):
    rows = [("big", "a", 3.0 if k % 5 else -3.0) for k in range(400)] + [("bad", "a", -3.0)] * 300 + [("one", "x", -3.0)]
    rows += [("big", "b", -3.0)] * 3
    shift = {(r.host, r.path): r.shift for r in site_priors(spark.createDataFrame(rows, "host string, path string, evidence double")).collect()}
    assert shift["bad", "a"] < shift["one", "x"] < 0 < shift["big", "a"]
    assert shift["bad", "a"] < shift["big", "b"] < shift["big", "a"]


def test_hard_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, 1), (2, "", "s", "en", 2), (2, "", "s", "en", 2), (None, "a b", "s", None, 3),
                                  (4, "word " * 200_000, "s", "en", 4), (5, "Plain words, as they come.", "t", "en", 5)],
                                 "doc_id long, text string, source string, lang string, score int")
    labels = spark.createDataFrame([(1, 1, None), (2, 0, 0), (None, 0, 1), (4, None, None), (5, 1, 0)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0), labels.where("quality = 1")):
        model = fit(docs, some)
        got = classify(docs, model).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
        kept = keep_good(docs, model)
        assert kept.columns == docs.columns and kept.count() == sum(r.keep for r in got)
    assert classify(docs.limit(0), model).count() == 0 and keep_good(docs.limit(0), model).count() == 0


def plain_shifts(rows):
    """(host, path) -> shift, from (host, path, evidence) by loops over documents."""
    docs = [(h, p, 1 / (1 + math.exp(-e))) for h, p, e in rows]
    logit = lambda x: math.log(x / (1 - x))
    centre = min(0.999, max(0.001, sum(x for *_, x in docs) / len(docs)))

    def grouped(key):
        out = {}
        for h, p, x in docs:
            out.setdefault(key(h, p), []).append(x)
        return out

    def worth(groups, centres):
        n, k = len(docs), len(groups)
        if k < 2 or n == k:
            return 10.0
        means = {g: sum(x) / len(x) for g, x in groups.items()}
        inner = sum((v - means[g]) ** 2 for g, x in groups.items() for v in x) / (n - k)
        between = sum(len(x) * (means[g] - centres[g]) ** 2 for g, x in groups.items())
        share = (between - (k - 1) * inner) / max(1e-9, n - sum(len(x) ** 2 for x in groups.values()) / n)
        return 1000.0 if share <= 0 else min(1000.0, max(1.0, inner / share))

    hosts, paths = grouped(lambda h, p: h), grouped(lambda h, p: (h, p))
    k = worth(hosts, dict.fromkeys(hosts, centre))
    host_share = {h: (sum(x) + k * centre) / (len(x) + k) for h, x in hosts.items()}
    k = worth(paths, {g: host_share[g[0]] for g in paths})
    share = {g: (sum(x) + k * host_share[g[0]]) / (len(x) + k) for g, x in paths.items()}
    return {g: logit(min(0.999, max(0.001, s))) - logit(centre) for g, s in share.items()}


def test_shares_equal_a_plain_hierarchy(spark):
    rng = random.Random(2)
    mixed = [(f"h{min(rng.randrange(40), 9)}", f"p{rng.randrange(4)}", rng.gauss(0, 2)) for _ in range(900)]
    tables = (mixed, [("h", "p", 1.0)], [("h", "p", 30.0)] * 50, [(f"h{i}", "p", float(i)) for i in range(20)],
              [("a", "p", 9.0)] * 300 + [("b", "p", -9.0)] * 2 + [("", "", 0.0)])
    for rows in tables:
        df = spark.createDataFrame(rows, "host string, path string, evidence double")
        got = {(r.host, r.path): r.shift for r in site_priors(df).collect()}
        assert got == pytest.approx(plain_shifts(rows), rel=1e-6, abs=1e-6)


def test_query_equals_a_plain_hierarchy(spark):
    from tidemark.llm.quality import features
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").persist()
    model = fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = docs.collect()
    odds = model.log_odds(np.array([features(r.text or "", model.lexicon) for r in rows]).reshape(-1, 11))
    sites = [(r.source or "", r.lang or "") for r in rows]
    shifts = plain_shifts([(*site, e) for site, e in zip(sites, odds)])
    want = {r.doc_id: 1 / (1 + math.exp(-(e + shifts[site]))) for r, site, e in zip(rows, sites, odds)}
    got = {r.doc_id: r for r in classify(docs, model).collect()}
    assert {d: r.score for d, r in got.items()} == pytest.approx(want, rel=1e-6)
    assert all(r.keep == (r.score >= 0.5) for r in got.values()) and 0 < sum(r.keep for r in got.values()) < len(got)
