"""The pipeline's stages, each against a plain reading of its decision."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_neardup import brute as duplicates
from tidemark.llm.secrets import find_secrets

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns
    texts = lambda d: {r.doc_id: r.text for r in d.collect()}

    before, after = (texts(d) for d in seen["quality classifier"])
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(after[i] == before[i] for i in after)
    judged = [(i in after, labels[i].quality == 1 and labels[i].toxic == 0) for i in before if i in labels]
    assert sum(a == b for a, b in judged) > 0.85 * len(judged)  # 87 labels, 10 of them toxic

    before, after = (texts(d) for d in seen["MinHash near-dedup"])
    assert set(after) == {r[0] for r in duplicates(sorted(before.items()), 5) if r[3]}

    before, after = (texts(d) for d in seen["benchmark decontamination"])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(after) == {r[0] for r in contaminated(sorted(before.items()), items) if not r[-1]}

    before, after = (texts(d) for d in seen["secret scans"])
    assert set(before) == set(after)
    for i in before:
        assert (before[i] == after[i]) == (not find_secrets(before[i]))
        assert not [s for s in find_secrets(after[i]) if s[1] != "lexed"]

    before, pieces = seen["packing"]
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in before.collect()}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_hard_rows(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    rows = [(1, None, None, None, None, 1), (2, "", "en", "s", 0, 2), (2, "", "en", "s", 0, 2), (None, "text without an id", "en", "s", 18, 3),
            (4, "x " * 60_000, "en", "s", 120_000, 4), (5, "token=abcdefghijklmnop", None, "s", 22, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, label int")
    docs = docs.withColumn("id", F.lit("clash")).withColumn("c0", F.lit(1)).withColumn("host", F.lit(2))
    out = stage(spark, docs, SF)
    n = out.count()
    if name != "packing":
        assert out.columns == docs.columns
        if name in ("secret scans", "benchmark decontamination", "MinHash near-dedup"):
            assert n == len(rows)
    assert stage(spark, docs.limit(0), SF).count() == 0
