"""Ranked search against scores of every pair, written from the definition."""

import math
import re

import numpy as np
import pytest

from tidemark.llm import lexical, words
from tidemark.llm.lexical import Level, level_of, rank_documents, tree
from tidemark.llm.queries import op11_lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    read = [(d, t) for d, t in ((d, terms(x)) for d, x in docs) if t]
    n_docs, length = len(read), sum(len(t) for _, t in read)
    df = {}
    for _, t in read:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in set(items):
        scores = []
        for d, t in read:
            m = 100 - 75 + (75 * len(t) * n_docs) // length
            score = 0
            for w in terms(text):
                if tf := t.count(w):
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * tf // (1000 * tf + 8 * m))
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k])]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r[0], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert rows_of(op11_lexical(spark, sf)) == brute(docs, items)


WORDS = "Alpha beta gamma DELTA epsilon zeta eta theta iota kappa straße Zürich ١٢ x1 the the the of".split()
DOCS = [(1, None), (2, ""), (3, " .,;"), (4, "alpha"), (5, "Alpha beta"), (5, "Alpha beta"), (None, "alpha beta"), (6, "beta alpha"),
        (7, "filler " * 40_000 + "needle"), (8, "ZÜRICH zürich Zürich"), (9, "the of " * 50)]
ITEMS = [(1, "alpha beta beta"), (1, "alpha beta beta"), (1, "zürich"), (2, None), (3, "!!"), (None, "the alpha"), (4, "needle haystack"),
         (5, "nothing of this kind occurs"), (6, " ".join(WORDS))]


def test_edges_ties_and_clashing_columns(spark):
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in DOCS], "doc_id long, text string, Text string, item_id string, rank int")
    items = spark.createDataFrame([(i, t, "z") for i, t in ITEMS], "item_id long, text string, TEXT string")
    want = brute(DOCS, ITEMS)
    assert rows_of(rank_documents(docs, items)) == want
    assert rows_of(rank_documents(docs, items, block_postings=2)) == want  # several blocks of items
    assert rows_of(rank_documents(docs, items, k=2)) == brute(DOCS, ITEMS, 2)
    assert rank_documents(docs.limit(0), items).count() == 0 and rank_documents(docs, items.limit(0)).count() == 0


def random_texts(rng, count, vocabulary):
    shares = 1 / np.arange(1, vocabulary + 1)
    return [" ".join(f"w{i}" for i in rng.choice(vocabulary, rng.integers(1, 60), p=shares / shares.sum())) for _ in range(count)]


def test_many_trees_prune_and_stay_exact(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = random_texts(rng, 700, 400)
    docs, items = list(enumerate(texts)), [(i, " ".join(t.split()[:12])) for i, t in enumerate(random_texts(rng, 60, 400))]
    items += [(100 + i, texts[i * 7]) for i in range(20)]  # passages found whole, so bounds bite
    got = rank_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert rows_of(got) == brute(docs, items)


def test_pruning_saves_pairs_and_whole_numbers_agree():
    rng = np.random.default_rng(1)
    rows, terms_ = np.repeat(np.arange(600), 8), np.concatenate([rng.choice(300, 8, replace=False) // 3 + 100 * (k % 3) for k in range(600)])
    fresh = level_of(rows, terms_, rng.integers(1, 1000, len(rows)), 600)
    rows = np.repeat(np.arange(600), np.diff(fresh.first))
    wanted = np.arange(0, 600, 40)
    spots = np.concatenate([np.arange(fresh.first[w], fresh.first[w + 1]) for w in wanted])
    items = lexical.item_block(rows[spots], fresh.terms[spots], np.ones(len(spots), np.int64), np.full(len(spots), 50))
    place = np.searchsorted(items.terms, fresh.terms)
    known = items.terms[np.minimum(place, len(items.terms) - 1)] == fresh.terms
    found = []
    for exact in (True, False):
        items.exact = exact
        run = lexical.Search(items, 3)
        some, row = np.unique(rows[known], return_inverse=True)
        run.add(row, place[known], fresh.values[known], some, np.zeros(len(some), bool))
        found.append((run.best.scores.tolist(), run.best.ids.tolist()))
        assert run.met < len(some) * len(wanted)  # whole batches were dropped
    assert found[0] == found[1]
    dense = np.zeros((600, 300), np.int64)
    dense[rows, fresh.terms] = fresh.values
    scores = 50 * (dense[items.keys] > 0) @ dense.T
    for k, own in enumerate(scores):
        best = sorted((-s, i) for i, s in enumerate(own.tolist()) if s > 0)[:3]
        assert [(-s, i) for i, s in zip(found[0][1][k], found[0][0][k]) if s] == [(s, i) for s, i in best]


def test_nodes_hold_maxima():
    levels = tree(Level(np.array([0, 2, 3, 5]), np.array([0, 2, 1, 0, 1]), np.array([3, 1, 4, 9, 2])), 2)
    assert [len(v) for v in levels] == [3, 2, 1]
    assert levels[2].terms.tolist() == [0, 1, 2] and levels[2].values.tolist() == [9, 4, 1]


@pytest.mark.parametrize("table,pattern", [(words.ALPHANUMERIC, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (words.SPACED, r"[^\x20\x09-\x0D]+"),
                                           (lexical.TERM, TERM.pattern)])
def test_words_are_whole_at_every_edge_of_a_piece(monkeypatch, table, pattern):
    text = "Hello, WORLD of ABC-defGHI Zürich. x Y z"
    raw = text.encode()
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    want = [m.encode() for m in re.findall(pattern, lowered)]
    for size in range(1, len(raw) + 2):
        monkeypatch.setattr(words, "_PIECE", size)
        monkeypatch.setattr(words, "_POWERS", [])
        data = np.frombuffer(raw, np.uint8)
        start, end, code, edges = words.find_words(data, np.array([0, len(data)]), table)
        assert [raw[s:e].lower() for s, e in zip(start, end)] == [w.lower() for w in want], size
        assert edges.tolist() == [0, len(want)]
