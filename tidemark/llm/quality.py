"""Quality classifier of documents with host and path priors.

Method: hierarchical empirical Bayes.  A document's own evidence is a logistic model over form
(letter case, symbols, repetition, word length) and over words that labelled bad documents use and
good ones do not.  The expected share of good documents of a host, and of a path below it, comes from
grouped sums of that evidence over all documents; a host is shrunk toward the global share and a
path toward its host, the more the fewer documents it has.  How strongly is itself estimated from
how far hosts and paths differ (method of moments).  A document's posterior log-odds are its evidence
plus what its path's share differs from the global one.

``documents`` has no URL: by default ``source`` is taken for the host and ``lang`` stands in for the
path level, so what is called a path's share there is that of a source's documents in one language.

The model is fitted on a bounded sample of labelled rows (``sample``, chosen by a hash of the id);
everything else covers all documents.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import map_texts, pick, spread
from tidemark.session import cut_lineage, fresh_path

SAMPLE = 20_000
PREFIX = 5
SITES_AT_ONCE = 200_000  # paths with their shifts that may be sent to every task (about 20 MB)
_STRENGTH, _LEAST, _SHARE = 2.0, 6, 0.85  # a bad word: prior weight, least documents, least posterior share
_LEXICON = 20_000

_WORD_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
# upper, lower, digit, white space, beyond ASCII, symbol
_CLASS = np.array([0 if 65 <= b <= 90 else 1 if 97 <= b <= 122 else 2 if 48 <= b <= 57
                   else 3 if b in (9, 10, 11, 12, 13, 32) else 4 if b >= 128 else 5 for b in range(256)])


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_WORD_TABLE).split()


def tokens_of(words: set[bytes]) -> set[bytes]:
    """Words, and beginnings of the longer ones (marked by a star)."""
    return words | {w[:PREFIX] + b"*" for w in words if len(w) > PREFIX}


def features(text: str, lexicon: frozenset) -> list[float]:
    """Numbers about one text; an empty one has zeros."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    if not len(raw):
        return [0.0] * 11
    upper, lower, digit, space, beyond, symbol = (np.bincount(_CLASS[raw], minlength=6) / len(raw)).tolist()
    words = words_of(text)
    n = max(1, len(words))
    counts = Counter(words)
    distinct = set(counts)
    lines = [x for x in text.split("\n") if x]
    bad = len(lexicon & tokens_of(distinct)) if lexicon else 0
    return [math.log1p(len(words)), upper / max(1e-9, upper + lower), digit, symbol, beyond, len(distinct) / n,
            max(counts.values(), default=0) / n, sum(map(len, words)) / n / 10, len(set(lines)) / max(1, len(lines)),
            math.log1p(bad), float(bad > 0)]


@dataclass
class Model:
    """A fitted logistic model; ``base`` is the log-odds of good among the labelled."""

    lexicon: frozenset
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    base: float

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        z = np.clip((rows - self.centre) / self.scale, -8, 8)
        return np.clip(z @ self.weights[:-1] + self.weights[-1], -12, 12)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int, id_column: str, text_column: str) -> DataFrame:
    """text, good of about ``sample`` labelled documents with different texts.

    good: every label says quality 1 (or nothing) and none says toxic 1.  Rows without id or
    without either label take no part.
    """
    labels = pick(labels, doc_id="doc_id", quality="quality", toxic="toxic")
    judged = (labels.where(F.col("doc_id").isNotNull() & (F.col("quality").isNotNull() | F.col("toxic").isNotNull()))
                    .groupBy(F.col("doc_id").alias("label_id"))
                    .agg(((F.coalesce(F.min("quality"), F.lit(1)) == 1) &
                          (F.coalesce(F.max("toxic"), F.lit(0)) == 0)).cast("int").alias("good")))
    n = judged.count()
    share = min(1.0, sample / max(1, n))
    picked = judged.where(F.pmod(F.xxhash64("label_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    texts = pick(docs, label_id=id_column, text=text_column).withColumn("text", F.col("text").cast("string"))
    # the sample is bounded by a parameter, so it may travel whole
    return (texts.where("text IS NOT NULL").join(F.broadcast(picked), "label_id")
                 .groupBy(F.xxhash64("text").alias("copy")).agg(F.first("text").alias("text"), F.min("good").alias("good"))
                 .select("text", "good"))


def learn_lexicon(rows: DataFrame) -> frozenset:
    """Words and beginnings that nearly only bad documents use."""
    def count(batches):
        for batch in batches:
            seen, bad = Counter(), Counter()
            for text, good in zip(batch["text"], batch["good"]):
                own = tokens_of(set(words_of(text)))
                seen.update(own)
                if not good:
                    bad.update(own)
            some = [t for t in seen if bad[t]]
            yield pd.DataFrame({"token": pd.Series(some, dtype=object), "n": [seen[t] for t in some], "bad": [bad[t] for t in some]})
            rest = [t for t in seen if not bad[t]]
            yield pd.DataFrame({"token": pd.Series(rest, dtype=object), "n": [seen[t] for t in rest], "bad": [0] * len(rest)})

    share = rows.agg(F.avg(1 - F.col("good"))).first()[0] or 0.0
    counted = rows.mapInPandas(count, "token binary, n bigint, bad bigint").groupBy("token").agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    posterior = (F.col("bad") + _STRENGTH * share) / (F.col("n") + _STRENGTH)
    found = (counted.where((F.col("bad") >= _LEAST) & (posterior >= _SHARE))
                    .orderBy(F.desc("bad"), "token").limit(_LEXICON).collect())
    return frozenset(bytes(r.token) for r in found)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_column: str = "doc_id",
        text_column: str = "text") -> Model:
    """A model from at most about ``sample`` labelled documents.  Without labels of both kinds all is good."""
    rows = cut_lineage(labelled_sample(docs, labels, sample, id_column, text_column))
    lexicon = learn_lexicon(rows)

    @F.pandas_udf("array<double>")
    def measure(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: features(t, lexicon))

    got = rows.select(measure("text").alias("x"), "good").collect()  # bounded by sample
    x = np.array([r.x for r in got], np.float64).reshape(len(got), 11)
    y = np.array([r.good for r in got], np.float64)
    centre, scale = x.mean(axis=0) if len(x) else np.zeros(11), x.std(axis=0) + 1e-6 if len(x) else np.ones(11)
    if len(set(y.tolist())) < 2:
        return Model(lexicon, centre, scale, np.append(np.zeros(11), 4.0), 4.0)
    z = np.column_stack([np.clip((x - centre) / scale, -8, 8), np.ones(len(x))])
    weights = np.zeros(12)
    penalty = np.append(np.full(11, 1.0), 1e-6)
    for _ in range(40):  # Newton's method on the penalised likelihood
        p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * weights)
        weights += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    share = float(y.mean())
    return Model(lexicon, centre, scale, weights, math.log(share / (1 - share)))


def with_evidence(docs: DataFrame, model: Model, at: int, name: str) -> DataFrame:
    """The rows with a column ``name``: log-odds of good by the text (column number ``at``) alone; a null text is empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batch: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
        own = shared.value
        rows = np.fromiter((x for t in texts for x in features(t.as_py(), own.lexicon)), np.float64, 11 * len(texts))
        odds = pa.array(own.log_odds(rows.reshape(-1, 11)))
        return pa.RecordBatch.from_arrays([*batch.columns, odds], [*batch.schema.names, name])

    return map_texts(docs, at, judge, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def _strength(groups: DataFrame, centre: Column) -> float:
    """Documents a prior is worth: how much less groups differ than single documents do."""
    spread_ = F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - centre, 2))
    row = groups.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), spread_.alias("between"),
                     F.sum(F.col("square") - F.col("good") * F.col("good") / F.col("n")).alias("within"),
                     F.sum(F.col("n") * F.col("n")).alias("nn")).first()
    if not row.n or row.k < 2 or row.n == row.k:
        return 10.0
    inner = row.within / (row.n - row.k)
    share = (row.between - (row.k - 1) * inner) / max(1e-9, row.n - row.nn / row.n)
    return 1000.0 if share <= 0 else float(min(1000.0, max(1.0, inner / share)))


def site_priors(scored: DataFrame) -> DataFrame:
    """host, path, shift: log-odds of the path's shrunken share less the global ones.

    ``scored`` has host, path, evidence (log-odds).  Sums only; a host with most of all
    documents is summed before it is shuffled.
    """
    p = 1 / (1 + F.exp(-F.col("evidence")))
    paths = cut_lineage(scored.withColumn("p", p).groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("n"), F.sum("p").alias("good"), F.sum(F.col("p") * F.col("p")).alias("square")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("square").alias("square"))
    total = hosts.agg(F.sum("n"), F.sum("good")).first()
    centre = min(0.999, max(0.001, (total[1] or 0.5) / (total[0] or 1)))
    k = _strength(hosts, F.lit(centre))
    hosts = hosts.select("host", ((F.col("good") + k * centre) / (F.col("n") + k)).alias("host_share"))
    near = paths.join(hosts, "host")
    k = _strength(near, F.col("host_share"))
    share = (F.col("good") + k * F.col("host_share")) / (F.col("n") + k)
    share = F.least(F.lit(0.999), F.greatest(F.lit(0.001), share))
    return near.select("host", "path", (F.log(share / (1 - share)) - math.log(centre / (1 - centre))).alias("shift"))


def site_columns(host_column: str, path_column: str) -> tuple[Column, Column]:
    return (F.coalesce(F.col(f"`{host_column}`").cast("string"), F.lit("")).alias("host"),
            F.coalesce(F.col(f"`{path_column}`").cast("string"), F.lit("")).alias("path"))


def classify(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text",
             host_column: str = "source", path_column: str = "lang", threshold: float = 0.5) -> DataFrame:
    """id, host, path, evidence, score (posterior that the document is good), keep per input row.

    By default ``source`` is the host and ``lang`` stands in for the path, as ``documents`` has no URL.
    A null text is empty and judged as such; a null host or path is a site of its own.
    Repeated rows and null ids are judged row by row and count for their site.
    """
    own = pick(docs, id=id_column, host=host_column, path=path_column, text=text_column)
    rows = spread(own.select("id", *site_columns("host", "path"), "text"))
    scored = cut_lineage(with_evidence(rows, model, 3, "evidence").drop("text"))
    joined = scored.join(site_priors(scored), ["host", "path"])
    score = 1 / (1 + F.exp(-(F.col("evidence") + F.col("shift"))))
    return joined.select(F.col("id").alias(id_column), "host", "path", F.col("evidence"), score.alias("score"),
                         (score >= threshold).alias("keep"))


def keep_good(docs: DataFrame, model: Model, text_column: str = "text", host_column: str = "source",
              path_column: str = "lang", threshold: float = 0.5) -> DataFrame:
    """The rows that ``classify`` keeps, with all their columns.

    Nulls, empty texts and repeated rows are judged as there; an empty table stays empty.  The evidence of
    a text is computed once and written beside it.
    """
    spark, columns = docs.sparkSession, docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    name = {c: f"c{i}" for i, c in reversed(list(enumerate(columns)))}
    host, path = site_columns(name[host_column], name[path_column])
    folder = fresh_path(spark, "evidence")
    with_evidence(plain, model, columns.index(text_column), "evidence").withColumns({"host": host, "path": path}).write.parquet(folder)
    judged = spark.read.schema(T.StructType([*plain.schema.fields, *T._parse_datatype_string("evidence double, host string, path string").fields])).parquet(folder)
    priors = cut_lineage(site_priors(judged.select("host", "path", "evidence")))
    if priors.count() <= SITES_AT_ONCE:  # then the texts stay where they are; else they travel by site, split where one is hot
        priors = F.broadcast(priors)
    good = 1 / (1 + F.exp(-(F.col("evidence") + F.col("shift")))) >= threshold
    return judged.join(priors, ["host", "path"]).where(good).select(*plain.columns).toDF(*columns)
