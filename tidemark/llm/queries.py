"""Registered queries of the numbered operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import oracles, toxicity
from tidemark.llm.common import table
from tidemark.llm.conversations import repair_report
from tidemark.llm.decontaminate import find_contamination, hit_words
from tidemark.llm.lexical import rank_documents
from tidemark.llm.neardup import find_duplicates
from tidemark.llm.packing import pack
from tidemark.llm.quality import classify, fit
from tidemark.llm.secrets import scan_secrets, span_text
from tidemark.llm.suffix_dedup import remove_repeats
from tidemark.llm.token_counts import count_tokens
from tidemark.llm.token_files import token_index, write_token_files
from tidemark.llm.topk import top_k
from tidemark.llm.warc import archive_pages
from tidemark.session import discard, fresh_path


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    found = archive_pages(table(spark, sf_dir, "pages"), *paths)  # checkpointed: the archives were only for this query
    for path in paths:
        discard(spark, path)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", hit_words().alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.size("hit") > 0).alias("contaminated"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
                        count("hex").alias("n_hex"),
                        F.sha2(span_text(F.col("spans"), ("assign", "access", "hex")), 256).alias("base_sha256"),
                        span_text(F.col("spans")).alias("spans"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path)
    found = token_index(spark, path)  # checkpointed: the files were only for this query
    discard(spark, path)
    return found


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"), length=400)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, table(spark, sf_dir, "labels")))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                        F.size("passages").alias("n_passages"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_topk, op2_neardup, op3_token_counts, op4_warc, op5_decontamination, op6_secrets, op7_token_files, op8_packing,
                               op9_suffix_dedup, op10_quality, op11_lexical, op12_toxicity, op13_conversations)}
# the others need a tokenizer, a fitted model or, for op6, a lexer; op9's windows are too many for SQL on whole tables
ORACLES: dict[str, str] = {"op1_topk": oracles.TOPK, "op2_neardup": oracles.NEARDUP, "op4_warc": oracles.WARC,
                           "op5_decontamination": oracles.DECONTAMINATION, "op11_lexical": oracles.LEXICAL, "op13_conversations": oracles.CONVERSATIONS}
