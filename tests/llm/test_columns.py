"""Extra columns whose names differ from the wanted ones in case only."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm.conversations import repair_report
from tidemark.llm.decontaminate import find_contamination, keep_clean
from tidemark.llm.lexical import rank_documents
from tidemark.llm.neardup import find_duplicates, keep_first
from tidemark.llm.packing import pack
from tidemark.llm.quality import classify, fit, keep_good
from tidemark.llm.secrets import redact, scan_secrets
from tidemark.llm.suffix_dedup import remove_repeats
from tidemark.llm.token_counts import count_tokens
from tidemark.llm.token_files import token_index, write_token_files
from tidemark.llm.toxicity import score_documents
from tidemark.llm.toxicity import fit as fit_toxicity
from tidemark.llm.warc import archive_pages
from tidemark.session import fresh_path

LONG = "one two three four five six seven eight nine ten eleven twelve"
DOCS = [(1, f"{LONG} token=abcdefghijklmnop", "s", "en"), (2, LONG, "s", "en"), (3, None, None, None), (4, LONG, "t", "de"),
        (5, "x" * 900, "t", "en")]


def clashing(df):
    names = df.columns
    return df.select(*names, *[F.lit("no") for _ in names]).toDF(*names, *[c.upper() for c in names])


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, source string, lang string").persist()
    items = spark.createDataFrame([("a", LONG), ("b", None)], "item_id string, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (5, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    return docs, items, labels


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("work", [
    lambda d, b, n: find_duplicates(d), lambda d, b, n: count_tokens(d), lambda d, b, n: find_contamination(d, b),
    lambda d, b, n: scan_secrets(d), lambda d, b, n: pack(d), lambda d, b, n: remove_repeats(d),
    lambda d, b, n: classify(d, fit(d, n)), lambda d, b, n: rank_documents(d, b),
    lambda d, b, n: score_documents(d, fit_toxicity(d, n))],
    ids=["neardup", "token_counts", "decontaminate", "secrets", "packing", "suffix", "quality", "lexical", "toxicity"])
def test_operators_read_the_named_columns(tables, work):
    docs, items, labels = tables
    assert rows(work(clashing(docs), clashing(items), clashing(labels))) == rows(work(docs, items, labels))


def test_filters_and_stages_keep_all_columns(spark, tables):
    docs, items, labels = tables
    wide = clashing(docs)
    model = fit(docs, labels)
    for work in (keep_first, redact, lambda d: keep_clean(d, items), lambda d: keep_good(d, model),
                 lambda d: corpus_pipeline.secrets(spark, d.withColumn("n_chars", F.lit(0).cast("bigint")) if "TEXT" not in d.columns
                                                   else d.select("*", F.lit(0).cast("bigint")).toDF(*d.columns, "n_chars"), "")):
        got, plain = work(wide), work(docs)
        own = [i for i, c in enumerate(got.columns) if c in plain.columns]
        assert sorted(str([r[i] for i in own]) for r in got.collect()) == sorted(str(list(r)) for r in plain.collect())


def test_files_and_conversations(spark, tables):
    docs, _, _ = tables
    got = []
    for df in (docs, clashing(docs)):
        path = fresh_path(spark, "ids")
        write_token_files(df, path)
        got.append(rows(token_index(spark, path)))
    assert got[0] == got[1]
    pages = spark.createDataFrame([(1, "http://a", "<p>x"), (2, "http://b", None)], "page_id long, url string, html string")
    a, b = (rows(archive_pages(p, fresh_path(spark, "arc"), fresh_path(spark, "warc")).select("page_id", "payload_digest", "record_type"))
            for p in (pages, clashing(pages)))
    assert a == b
    talks = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes.")], "conv_id long, turn int, role string, text string")
    assert rows(repair_report(clashing(talks))) == rows(repair_report(talks))
