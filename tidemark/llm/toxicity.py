"""Toxic passages and a toxicity score for every document.

Method: maximum-scoring segments.  Each word has a log-odds: how much more often documents labelled
toxic hold it than clean ones, under Dirichlet priors that chain from the beginnings of a word (4, 5, 6
bytes) to the word itself, so a rare word leans on its stem and an unknown one is its stem.  Shrunk by
its own uncertainty and lowered by a drift, it is a score whose mean over clean text is negative.  One
linear scan then finds all maximal segments of a text (every word run that cannot be made better by
growing or shrinking, and lies in no better one).

What scores chance gives: for clean text the best segment of n words follows an extreme-value law,
P(best >= s) = 1 - exp(-K n exp(-lambda s)).  lambda makes the mean of exp(lambda * score) one over clean
words, K comes from the best segments of clean documents.  K n exp(-lambda s) is the number of segments
as good that chance would give; those below ``significant`` are passages.  The document's score is a
logistic curve over surprise, -log of that number: the best segment's and that of all passages together.

The words are learned from three of four parts of at most about ``sample`` labelled documents, the
curve and the law from the fourth.  ``held_out`` documents are in neither.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pick, spread
from tidemark.llm.words import LOWER, find_words, mix, parts, text_buffer, word_bytes
from tidemark.session import cut_lineage

# fixed byte class: ASCII letters, digits and everything beyond ASCII
WORD = word_bytes((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
SAMPLE = 40_000       # labelled documents to learn from, about
LARGEST = 1_000_000   # words and beginnings of a model
STEMS = (4, 5, 6)     # bytes of the beginnings that words lean on
STRENGTH = 2.0        # documents that a prior is worth
LEANING = 3.0         # most that a beginning's log-odds say about a word
SHRINK = 1.0          # standard deviations taken off a log-odds
DRIFT = 0.3           # least amount by which a word loses, on average, in nine of ten clean texts
SIGNIFICANT = 0.01
RATES = np.round(np.geomspace(0.02, 5.0, 60), 6)  # tried for lambda


# --- words and their beginnings --------------------------------------------------------


def word_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Keys of each word, one row per word: its beginnings, shortest first, and the word; 0 where it has none.

    A word has the beginnings that are shorter than it is.
    """
    out = np.zeros((len(start), len(STEMS) + 1), np.uint64)
    out[:, -1] = code
    if not len(start):
        return out
    packed, length = np.zeros(len(start), np.uint64), end - start
    for k in range(max(STEMS)):
        own = LOWER[data[np.minimum(start + k, len(data) - 1)]].astype(np.uint64)
        packed = packed << np.uint64(8) | own
        if k + 1 in STEMS:
            at = STEMS.index(k + 1)
            long = length > k + 1
            out[long, at] = mix(packed[long] * np.uint64(2654435761) + np.uint64(k + 1))
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (text, toxic): per key its parent, depth, and in how many toxic and clean documents it is."""
    for batch in batches:
        for first, last in parts(batch.column(0)):
            data, bounds = text_buffer(batch.column(0).slice(first, last - first))
            toxic = batch.column(1).slice(first, last - first).to_numpy(zero_copy_only=False).astype(bool)
            start, end, code, edges = find_words(data, bounds, WORD)
            keys = word_keys(data, start, end, code)
            text = np.searchsorted(edges, np.arange(len(start)), "right") - 1
            parent = np.zeros(len(start), np.uint64)
            for depth in range(keys.shape[1]):
                has = np.flatnonzero(keys[:, depth])
                own, doc, above = keys[has, depth], text[has], parent[has]
                order = np.lexsort((doc, own))
                own, doc, above = own[order], doc[order], above[order]
                fresh = np.ones(len(own), bool)
                fresh[1:] = (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])
                own, doc, above = own[fresh], doc[fresh], above[fresh]
                at = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, int)
                if len(at):
                    bad = np.add.reduceat(toxic[doc].astype(np.int64), at)
                    many = np.diff(np.append(at, len(own)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own[at].view(np.int64)), pa.array(above[at].view(np.int64)), pa.array(np.full(len(at), depth, np.int32)),
                         pa.array(bad), pa.array(many - bad)], ["key", "parent", "depth", "toxic", "clean"])
                parent[has] = keys[has, depth]


@dataclass
class Lexicon:
    """Scores of known words and beginnings, sorted by key; ``other`` is that of unknown words."""

    keys: np.ndarray
    scores: np.ndarray
    other: float

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The score of each word: its own, else that of its longest known beginning."""
        out = np.full(len(keys), self.other)
        if not len(self.keys):
            return out
        left = np.arange(len(keys))
        for depth in range(keys.shape[1] - 1, -1, -1):
            own = keys[left, depth]
            place = np.searchsorted(self.keys, own).clip(max=len(self.keys) - 1)
            known = (self.keys[place] == own) & (own != 0)
            out[left[known]] = self.scores[place[known]]
            left = left[~known]
        return out


def chained_scores(key: np.ndarray, parent: np.ndarray, depth: np.ndarray, toxic: np.ndarray, clean: np.ndarray,
                   n_toxic: int, n_clean: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys, sorted, and their log-odds less SHRINK deviations, never beyond zero.

    The prior of a key is worth STRENGTH documents, parted as its parent's log-odds say; beyond LEANING
    they say no more, as a parent's documents are counted in the key again.
    """
    order = np.argsort(key)
    key, parent, depth, toxic, clean = key[order], parent[order], depth[order], toxic[order], clean[order]
    odds, scores = np.zeros(len(key)), np.zeros(len(key))
    for level in range(len(STEMS) + 1):
        own = np.flatnonzero(depth == level)
        if not len(own):
            continue
        place = np.searchsorted(key, parent[own]).clip(max=len(key) - 1)
        above = np.where(key[place] == parent[own], np.clip(odds[place], -LEANING, LEANING), 0.0)
        share = n_toxic * np.exp(above) / (n_toxic * np.exp(above) + n_clean)
        a, b = toxic[own] + STRENGTH * share, clean[own] + STRENGTH * (1 - share)
        odds[own] = np.log(a / n_toxic) - np.log(b / n_clean)
        scores[own] = np.sign(odds[own]) * np.maximum(0.0, np.abs(odds[own]) - SHRINK * np.sqrt(1 / (a + 1) + 1 / (b + 1)))
    return key, scores


# --- segments --------------------------------------------------------------------------


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(start, end, score) of all maximal scoring segments, in order, in time linear in the scores.

    Neighbours of one sign count as one; a stack holds the candidates, each with the sum before it
    and behind it and the last earlier candidate that began lower.
    """
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    good = scores > 0
    if not good.any():
        return []
    edge = np.flatnonzero(np.diff(np.concatenate([[False], good, [False]]).astype(np.int8)))
    found: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum behind, earlier one that began lower
    for start, end in zip(edge[::2].tolist(), edge[1::2].tolist()):
        low, high = float(sums[start]), float(sums[end])
        back = len(found) - 1
        while True:
            while back >= 0 and found[back][2] >= low:
                back = found[back][4]
            if back < 0 or found[back][3] >= high:
                found.append((start, end, low, high, back))
                break
            start, low, before = found[back][0], found[back][2], found[back][4]  # takes in all from there on
            del found[back:]
            back = before
    return [(start, end, high - low) for start, end, low, high, _ in found]


def segments_of(column: pa.Array, lexicon: Lexicon, drift: float) -> Iterator[tuple]:
    """Per text: word scores, maximal segments, and first and last byte of each word within the text."""
    data, bounds = text_buffer(column)
    start, end, code, edges = find_words(data, bounds, WORD)
    scores = lexicon.of(word_keys(data, start, end, code)) - drift
    for k in range(len(column)):
        a, b = edges[k], edges[k + 1]
        yield scores[a:b], maximal_segments(scores[a:b]), start[a:b] - bounds[k], end[a:b] - bounds[k], data[bounds[k]:bounds[k + 1]]


# --- model -----------------------------------------------------------------------------


@dataclass
class Model:
    lexicon: Lexicon
    drift: float
    rate: float           # lambda
    scale: float          # K
    weights: np.ndarray   # of the best surprise, of all passages' surprise, constant
    significant: float

    def chance(self, words: int, score: float) -> float:
        """Segments as good that chance gives in a clean text of so many words."""
        return self.scale * max(1, words) * math.exp(-min(700.0, self.rate * score))

    def score(self, words: int, segments: list[float]) -> float:
        z = float(features(words, segments, self) @ self.weights)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def features(words: int, segments: list[float], model: Model) -> np.ndarray:
    """Surprise of the best segment up to that of a passage, logarithm of all passages' together, one."""
    surprise = [-math.log(max(1e-300, model.chance(words, s))) for s in segments]
    best = max(surprise, default=-math.log(max(1e-300, model.chance(words, 0.0))))
    level = -math.log(model.significant)
    return np.array([max(-10.0, min(level, best)), math.log1p(sum(s for s in surprise if s > level)), 1.0])


def remainder(column: str) -> Column:
    """crc32 of the id as text modulo 5; a null id is the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % 5


def labelled_texts(docs: DataFrame, labels: DataFrame, sample: int, label: str) -> DataFrame:
    """text, toxic, part (0 to 3) of about ``sample`` labelled documents, without held-out ones.

    A document is toxic if any of its labels says so; rows without id or label take no part.
    """
    known = pick(labels, label_id="doc_id", toxic=label).where(F.col("label_id").isNotNull() & F.col("toxic").isNotNull())
    judged = (known.where(remainder("label_id") != 0).groupBy("label_id").agg((F.max("toxic") > 0).alias("toxic")))
    n = judged.count()
    share = int(min(1.0, sample / max(1, n)) * 1_000_000)
    # bounded by the parameter, so it may travel whole
    judged = judged.where(F.pmod(F.xxhash64("label_id"), F.lit(1_000_000)) < share)
    return docs.join(F.broadcast(judged), docs["id"] == judged["label_id"]).select(
        "text", "toxic", (remainder("label_id") - 1).alias("part"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, significant: float = SIGNIFICANT, id_column: str = "doc_id",
        text_column: str = "text", label: str = "toxic") -> Model:
    """A model from about ``sample`` labelled documents.

    Without labels of both kinds every document scores the share of toxic labels (a half without any).
    """
    rows = cut_lineage(labelled_texts(_texts(docs, id_column, text_column), labels, sample, label))
    sizes = {(bool(r.toxic), bool(r.last)): r["count"] for r in rows.groupBy("toxic", (F.col("part") == 3).alias("last")).count().collect()}
    n_toxic, n_clean = sizes.get((True, False), 0), sizes.get((False, False), 0)
    total = sum(sizes.values())
    share = (sizes.get((True, True), 0) + n_toxic + 0.5) / (total + 1)
    nothing = Model(Lexicon(np.zeros(0, np.uint64), np.zeros(0), 0.0), DRIFT, 1.0, 1.0,
                    np.array([0.0, 0.0, math.log(share / (1 - share))]), significant)
    if not n_toxic or not n_clean:
        return nothing
    counted = (rows.where("part <> 3").select("text", "toxic")
                   .mapInArrow(_count, "key bigint, parent bigint, depth int, toxic bigint, clean bigint")
                   .groupBy("key").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.sum("toxic").alias("toxic"),
                                       F.sum("clean").alias("clean")))
    kept = counted.where("toxic + clean > 1").orderBy(F.desc(F.expr("toxic + clean")), "key").limit(LARGEST).toArrow()
    columns = [kept.column(c).to_numpy() for c in ("key", "parent", "depth", "toxic", "clean")]
    keys, scores = chained_scores(columns[0].view(np.uint64), columns[1].view(np.uint64), *columns[2:], n_toxic, n_clean)
    lexicon = Lexicon(keys, scores, 0.0)
    held = rows.where("part = 3") if sizes.get((True, True), 0) and sizes.get((False, True), 0) else rows
    return _calibrated(held, lexicon, nothing)


MEASURED = "toxic boolean, words bigint, total double, growth array<double>, segments array<double>"


def _measured(rows: DataFrame, lexicon: Broadcast, drift: float) -> DataFrame:
    """Of labelled texts: number of words, their total score, sums of exp(rate * score), scores of segments."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in parts(batch.column(0)):
                words, total, growth, segments = [], [], [], []
                for scores, found, *_ in segments_of(batch.column(0).slice(first, last - first), lexicon.value, drift):
                    words.append(len(scores))
                    total.append(float(scores.sum()))
                    growth.append([float(np.exp(np.minimum(r * scores, 500)).sum()) for r in RATES])
                    segments.append([s for _, _, s in found])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(first, last - first), pa.array(words, pa.int64()), pa.array(total, pa.float64()),
                     pa.array(growth, pa.list_(pa.float64())), pa.array(segments, pa.list_(pa.float64()))],
                    ["toxic", "words", "total", "growth", "segments"])

    return rows.select("text", "toxic").mapInArrow(run, MEASURED)


def _calibrated(rows: DataFrame, lexicon: Lexicon, nothing: Model) -> Model:
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)
    mean = F.col("total") / F.greatest(F.col("words"), F.lit(1))
    usual = _measured(rows, shared, 0.0).where(~F.col("toxic")).agg(F.percentile_approx(mean, 0.9, 1000)).first()[0]
    drift = max(0.0, DRIFT + (usual or 0.0))
    measured = cut_lineage(_measured(rows, shared, drift))
    shared.destroy()
    clean = measured.where(~F.col("toxic"))
    sums = clean.agg(F.sum("words").alias("words"), *[F.sum(F.col("growth")[k]).alias(f"g{k}") for k in range(len(RATES))]).first()
    means = np.array([sums[f"g{k}"] or 0.0 for k in range(len(RATES))]) / max(1, sums["words"] or 0)
    below = np.flatnonzero(means <= 1.0)  # the mean falls first and then rises through one
    rate = float(RATES[below[-1]]) if len(below) else float(RATES[0])
    best = F.coalesce(F.array_max("segments"), F.lit(0.0))
    law = clean.agg(F.avg(F.greatest(F.col("words"), F.lit(1)) * F.exp(-rate * best))).first()[0]
    model = Model(lexicon, drift, rate, 1 / max(1e-9, law or 1.0), nothing.weights, nothing.significant)
    got = measured.select("toxic", "words", "segments").toArrow()  # bounded by the sample
    y = got.column("toxic").to_numpy(zero_copy_only=False).astype(float)
    x = np.array([features(w, s, model) for w, s in zip(got.column("words").to_pylist(), got.column("segments").to_pylist())]).reshape(-1, 3)
    model.weights = logistic(x, y)
    return model


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    """Weights of most penalised likelihood by Newton's method, steps halved until they help; the last column is the constant."""
    centre, spread_ = x[:, :-1].mean(axis=0), x[:, :-1].std(axis=0) + 1e-9
    z = np.column_stack([(x[:, :-1] - centre) / spread_, np.ones(len(x))])
    hold = np.append(np.full(x.shape[1] - 1, penalty * len(y)), 1e-9)

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, np.where(y > 0, -1, 1) * (z @ w)).sum() + (hold * w * w).sum() / 2)

    weights = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ weights, -500, 500)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(hold + 1e-9), z.T @ (y - p) - hold * weights)
        size, before = 1.0, loss(weights)
        while loss(weights + size * step) > before and size > 1e-6:
            size /= 2
        weights = weights + size * step
        if np.abs(size * step).max() < 1e-7:
            break
    slopes = weights[:-1] / spread_
    return np.append(slopes, weights[-1] - slopes @ centre)


def _texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return pick(docs, id=id_column, text=text_column).withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))


# --- documents -------------------------------------------------------------------------

PASSAGES = "array<struct<start:bigint,end:bigint,score:double,chance:double>>"


def score_documents(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, held_out, n_words, score, passages (start and end in code points, end exclusive, score, chance) per input row.

    ``passages`` are the maximal segments that chance would give fewer than ``model.significant`` times.  A null
    text is empty; texts without words have the score of no evidence.  Repeated rows and null ids are
    scored row by row (a null id counts as held out); other columns are not read.
    """
    rows = spread(_texts(docs, id_column, text_column))
    kind = rows.schema["id"].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(model)  # at most LARGEST keys
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("chance", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for first, last in parts(batch.column(1)):
                words, scores, passages = [], [], []
                for each, found, start, end, raw in segments_of(batch.column(1).slice(first, last - first), own.lexicon, own.drift):
                    n = len(each)
                    words.append(n)
                    scores.append(own.score(n, [s for _, _, s in found]))
                    kept = [(a, b, s, chance) for a, b, s in found if (chance := own.chance(n, s)) < own.significant]
                    if kept:  # bytes to code points
                        chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                        kept = [{"start": int(chars[start[a]]), "end": int(chars[end[b - 1]]), "score": s, "chance": c} for a, b, s, c in kept]
                    passages.append(kept)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(words, pa.int64()), pa.array(scores, pa.float64()),
                     pa.array(passages, spans)], ["id", "n_words", "score", "passages"])

    made = rows.mapInArrow(run, f"id {kind}, n_words bigint, score double, passages {PASSAGES}")
    return made.select(F.col("id").alias(id_column), (remainder("id") == 0).alias("held_out"), "n_words", "score", "passages")
