"""Repeated passages against brute force over every window."""

import hashlib
import os
import random
from collections import Counter

import pytest

from tidemark.llm import suffix_dedup
from tidemark.llm.suffix_dedup import remove_repeats
from tidemark.llm.suffix_order import common_prefix, order


def brute(rows, length):
    seen = Counter()
    raws = [(i, (t or "").encode()) for i, t in rows]
    for _, b in raws:
        seen.update(b[k:k + length] for k in range(len(b) - length + 1))
    out = []
    for i, b in raws:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)),
                    hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df, length):
    return sorted(((r[0], r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in remove_repeats(df, length).collect()), key=str)


def test_order():
    r = random.Random(1)
    for n in (0, 1, 2, 50, 400):
        strings = [bytes(r.choice(b"ab") for _ in range(r.choice([0, 3, 40, 90]))) for _ in range(n)]
        strings += [b"x" * 60 + bytes([r.choice(b"xy")]) * r.randint(0, 40) for _ in range(n)]
        placed, shared = order(strings)
        assert [strings[k] for k in placed] == sorted(strings)
        assert shared[1:] == [len(os.path.commonprefix([strings[a], strings[b]])) for a, b in zip(placed, placed[1:])]
        assert all(common_prefix(a, b) == len(os.path.commonprefix([a, b])) for a, b in zip(strings, strings[1:]))


@pytest.mark.parametrize("crowd", [1024, 2])
def test_hard_rows(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdeé ") for _ in range(r.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(40) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate([None, "", "short", "a" * 300, "a" * 301, "ab" * 200, "same " * 50, "same " * 50, "x" * 99, "x" * 100])]
    for k in range(120):
        p = r.choice(shared)
        a = r.randint(0, len(p) // 2)
        cut = p[a:a + r.randint(60, 240)]
        rows.append((1000 + k, prose(r.randint(0, 30)) + cut + prose(r.randint(0, 30)) + r.choice(shared)[:130]))
    rows += [(2000, rows[30][1]), (2001, rows[30][1]), (None, rows[31][1]), (2002, rows[32][1][:-1]), (2003, "q" + rows[32][1])]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, h int")
    for length in (100, 37):
        want = brute(rows, length)
        assert result(df, length) == want and any(x[2] for x in want)
    assert remove_repeats(df.limit(0)).count() == 0


def test_documents_and_pieces(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(docs, 400) == brute(rows, 400)


def test_long_texts_in_pieces():
    import numpy as np

    r = random.Random(5)
    data = bytes(r.choice(b"abcd") for _ in range(60_000))
    array = np.frombuffer(data, np.uint8)
    size = suffix_dedup._PIECE
    try:
        for piece in (5000, 1 << 20):
            suffix_dedup._PIECE = piece
            found = suffix_dedup.anchors(array, np.array([0, 20_000, 20_300, 60_000]), 400)
            covered = Counter()
            for t, at, low, high in zip(found["text"], found["at"], found["low"], found["high"]):
                covered.update((int(t), int(at - o)) for o in range(low, high + 1))
            want = [(t, s) for t, n in ((0, 20_000), (1, 300), (2, 39_700)) for s in range(max(0, n - 399))]
            assert sorted(covered) == want and set(covered.values()) == {1}
    finally:
        suffix_dedup._PIECE = size


def test_memory_of_workers(spark):
    import tracemalloc

    import numpy as np

    # a task's search for anchors holds little beside its texts
    r = np.random.default_rng(3)
    data = r.integers(97, 123, 4 << 20, np.uint8)
    bounds = np.arange(0, len(data) + 1, 2048)
    suffix_dedup.anchors(data[:4096], bounds[:3], 400)  # tables that are kept
    tracemalloc.start()
    try:
        suffix_dedup.anchors(data, bounds, 400)
        assert tracemalloc.get_traced_memory()[1] < 16 << 20
    finally:
        tracemalloc.stop()
    # batches for Python are small, and no task of the last step needs two workers
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, "64m")
    try:
        found = remove_repeats(spark.createDataFrame([(1, "a" * 500), (2, "b" * 500 + "c")], "doc_id long, text string"))
        assert spark.conf.get(key) == "8m"
        last = found._jdf.queryExecution().optimizedPlan().children().last().toString()  # of the union: texts that stay whole
        assert "MapInArrow" in last and "ArrowEvalPython" not in last
        assert sorted((x.doc_id, x.n_bytes, x.n_removed) for x in found.collect()) == [(1, 500, 500), (2, 501, 500)]
    finally:
        spark.conf.set(key, was)


def test_a_class_that_many_texts_hold_can_be_split(spark, monkeypatch):
    from tidemark.llm import suffix_dedup

    r = random.Random(8)
    words = lambda n: "".join(r.choices("abcdefgh ", k=n))
    line = words(900)
    rows = [(i, words(20) + line + words(20)) for i in range(900)] + [(2000 + i, words(20) + line[250:700] + words(20)) for i in range(20)]
    rows += [(3000 + i, words(60 + 400) * 2) for i in range(60)]
    plans, cut = [], suffix_dedup.cut_lineage

    def watched(df):
        if "ranges" in df.columns:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(suffix_dedup, "cut_lineage", watched)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: [tuple(s) for s in x.spans] for x in remove_repeats(docs).collect()}
    # Spark splits a hot key of a join only if no aggregate stands between the join and the shuffle
    assert len(plans) == 1 and "collect_list(struct(from" not in plans[0]
    assert all(any(a <= 20 and b >= 920 for a, b in got[i]) for i in range(900))
    assert all(any(a <= 20 and b >= 470 for a, b in got[2000 + i]) for i in range(20))
