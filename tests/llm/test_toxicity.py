"""Segments, counts and the extreme-value law against plain versions; accuracy on documents held out."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import toxicity
from tidemark.llm.queries import op12_toxicity
from tidemark.llm.toxicity import Lexicon, Model, chained_scores, fit, logistic, maximal_segments, score_documents, word_keys
from tidemark.llm.words import find_words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_segments(scores, low=0, high=None):
    """The best run (shortest, then first, of equals), then the same left and right of it."""
    high = len(scores) if high is None else high
    best = None
    for a in range(low, high):
        for b in range(a + 1, high + 1):
            s = sum(scores[a:b])
            if s > 0 and (best is None or (s, a - b) > best[0]):
                best = ((s, a - b), a, b)
    if best is None:
        return []
    _, a, b = best
    return [*brute_segments(scores, low, a), (a, b, best[0][0]), *brute_segments(scores, b, high)]


def test_segments_are_the_maximal_ones():
    rng = random.Random(1)
    for _ in range(400):
        scores = [rng.choice([-3.25, -2.0, -1.0, 0.5, 1.0, 2.5, 4.0]) + rng.random() / 64 for _ in range(rng.randrange(0, 24))]
        got = maximal_segments(np.array(scores))
        want = brute_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want], scores
        assert all(abs(x[2] - y[2]) < 1e-9 for x, y in zip(got, want))
    assert maximal_segments(np.zeros(0)) == [] and maximal_segments(np.array([-1.0, 0.0])) == []


def test_segments_take_linear_time():
    import time
    rng = np.random.default_rng(0)
    took = []
    for size in (20_000, 200_000):
        scores = rng.choice([-1.0, 1.0], size)
        start = time.process_time()
        maximal_segments(scores)
        took.append(time.process_time() - start)
    assert took[1] < 40 * took[0] + 0.5


def plain_keys(word):
    raw = re.sub("[A-Z]", lambda m: m[0].lower(), word).encode()
    return [raw[:n] if len(raw) > n else None for n in toxicity.STEMS] + [raw]


def test_counts_and_scores(spark):
    texts = [("Idiot idiots IDIOTIC x", True), ("a fine day", False), ("", False), ("idiots are fine, straße", True), ("straßen 12345678", False)] * 3
    rows = spark.createDataFrame(texts, "text string, toxic boolean")
    kinds = "key bigint, parent bigint, depth int, toxic bigint, clean bigint"
    got = Counter()
    for r in rows.mapInArrow(toxicity._count, kinds).collect():
        got[r.key] += 1000 * r.toxic + r.clean
    want, names = Counter(), {}
    for text, toxic in texts:
        own = set()
        for word in WORD.findall(text):
            data = np.frombuffer(word.encode(), np.uint8)
            start, end, code, _ = find_words(data, np.array([0, len(data)]), toxicity.WORD)
            for name, key in zip(plain_keys(word), word_keys(data, start, end, code)[0].view(np.int64).tolist()):
                assert (name is None) == (key == 0)
                if name is not None:
                    assert names.setdefault(key, name) == name
                    own.add(key)
        for key in own:
            want[key] += 1000 if toxic else 1
    assert got == want


def test_unknown_words_lean_on_their_beginnings():
    key, parent = np.array([9, 5, 7], np.uint64), np.array([5, 0, 5], np.uint64)
    keys, scores = chained_scores(key, parent, np.array([3, 0, 3]), np.array([1, 40, 0]), np.array([0, 0, 0]), 100, 900)
    assert keys.tolist() == [5, 7, 9] and scores[0] > scores[2] > scores[1] > 0
    lexicon = Lexicon(keys, scores, -0.5)
    assert lexicon.of(np.array([[5, 0, 0, 9], [5, 0, 0, 1], [0, 0, 0, 1]], np.uint64)).tolist() == [scores[2], scores[0], -0.5]


def test_chance_follows_the_law():
    """Best segments of random texts are as rare as the fitted law says."""
    rng = np.random.default_rng(3)
    values, shares = np.array([-1.0, 0.4, 2.0]), np.array([0.8, 0.15, 0.05])
    rates = np.linspace(0.05, 5, 5000)
    rate = rates[np.flatnonzero((shares[:, None] * np.exp(values[:, None] * rates)).sum(0) <= 1)[-1]]
    best = lambda n: max((s for _, _, s in maximal_segments(rng.choice(values, n, p=shares))), default=0.0)
    scale = 1 / np.mean([500 * math.exp(-rate * best(500)) for _ in range(400)])
    model = Model(Lexicon(np.zeros(0, np.uint64), np.zeros(0), 0.0), 0.0, float(rate), float(scale), np.zeros(3), 0.01)
    bests = np.array([best(500) for _ in range(600)])
    for level in (0.3, 0.1):
        share = np.mean([1 - math.exp(-model.chance(500, b)) < level for b in bests])
        assert abs(share - level) < 0.06


def test_logistic_is_stationary():
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.normal(size=300), rng.normal(size=300), np.ones(300)])
    y = (x[:, 0] + rng.normal(size=300) > 0).astype(float)
    w = logistic(x, y, penalty=0.0)
    assert np.abs(x.T @ (y - 1 / (1 + np.exp(-x @ w)))).max() < 1e-3


@pytest.fixture(scope="module")
def tables(spark):
    sf = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def test_held_out_documents(spark, tables):
    docs, labels = tables
    found = score_documents(docs, fit(docs, labels))
    rows = found.join(labels, "doc_id").select("doc_id", "held_out", "score", "toxic").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    toxic, clean = [r.score for r in held if r.toxic], [r.score for r in held if not r.toxic]
    assert np.mean([s >= 0.5 for s in toxic]) > 0.85 and np.mean([s < 0.5 for s in clean]) > 0.98
    assert np.mean([[t > c for c in clean] for t in toxic]) > 0.95  # some labelled texts are junk without a word of their own


def test_held_out_labels_and_other_columns_play_no_part(spark, tables):
    docs, labels = tables
    small = docs.where("doc_id % 10 = 0").limit(300).cache()
    flipped = labels.withColumn("toxic", (1 - toxicity.F.col("toxic")).cast("int")).where(toxicity.remainder("doc_id") == 0)
    changed = labels.where(toxicity.remainder("doc_id") != 0).unionByName(flipped)
    a = {r.doc_id: r.score for r in score_documents(small, fit(docs, labels, sample=2000)).collect()}
    other = docs.withColumns({"lang": toxicity.F.lit("x"), "source": toxicity.F.lit("y"), "n_chars": toxicity.F.lit(0)})
    b = {r.doc_id: r.score for r in score_documents(small, fit(other, changed, sample=2000)).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_passages_are_whole_words_of_the_text():
    words = [np.frombuffer(w.encode(), np.uint8) for w in ("böse", "schlimm")]
    keys = [word_keys(d, *find_words(d, np.array([0, len(d)]), toxicity.WORD)[:3])[0, -1] for d in words]
    lexicon = Lexicon(np.sort(np.array(keys, np.uint64)), np.array([6.0, 6.0]), 0.0)
    text = "ünd dänn Böse, Schlimm. ünd " * 2
    (scores, found, start, end, raw), = toxicity.segments_of(pa.array([text]), lexicon, 1.0)
    assert scores.tolist() == [-1, -1, 5, 5, -1] * 2 and [(a, b, s) for a, b, s in found] == [(2, 9, 17.0)]


def test_edges(spark, tables):
    docs, labels = tables
    model = fit(docs, labels, sample=2000)
    odd = [(1, None, "a"), (2, "", "b"), (3, " .,;", "c"), (None, "idiot scum moron " * 3, "d"), (4, "x" * 300_000, "e"),
           (4, "word " * 100_000, "f"), (5, "idiot scum moron " * 3, "g"), (5, "idiot scum moron " * 3, "g")]
    df = spark.createDataFrame(odd, "doc_id long, text string, Text string").withColumn("score", toxicity.F.lit(7))
    got = score_documents(df, model).collect()
    assert len(got) == len(odd) and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].score == by_id[2].score == by_id[3].score < 0.5 and by_id[1].n_words == 0
    assert by_id[None].held_out and by_id[None].score == by_id[5].score > 0.5
    span = by_id[5].passages[0]
    assert "idiot scum moron" in odd[6][1][span.start:span.end]
    assert score_documents(df.limit(0), model).count() == 0
    for none in (labels.limit(0), labels.where("toxic = 0"), labels.withColumn("toxic", toxicity.F.lit(None).cast("int"))):
        scores = {r.score for r in score_documents(df, fit(docs, none)).collect()}
        assert len(scores) == 1


def test_query(spark):
    got = op12_toxicity(spark, "/root/testdata/sf0.001")
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert all(r.predicted == int(r.score >= 0.5) for r in rows)
