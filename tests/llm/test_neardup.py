"""Near duplicates against brute force over all pairs."""

import random
import re

import pytest

from tidemark.llm import neardup
from tidemark.llm.graph import components
from tidemark.llm.neardup import find_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size, percent=80):
    sets = []
    for i, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            a, b = sets[x], sets[y]
            i, j = rows[x][0], rows[y][0]
            if i is None or j is None or not a or not b:
                continue
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i) for (i, _), s in zip(rows, sets)), key=str)


def result(df, size):
    return sorted((tuple(r) for r in find_duplicates(df, size).collect()), key=str)


@pytest.mark.parametrize("size", [4, 5])
def test_documents(spark, size):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows, size)
    assert result(docs, size) == want and sum(not r[3] for r in want) > 5


@pytest.mark.parametrize("cell", [5, 2048])
def test_chains_and_hard_rows(spark, monkeypatch, cell):
    monkeypatch.setattr(neardup, "CELL", cell)
    r = random.Random(11)
    words = [f"w{k}" for k in range(400)]
    rows = [(i, t) for i, t in enumerate([None, "", " \n", "one", "ONE", "one two", "one  two", "one two three"], 1)]
    base = [r.choice(words) for _ in range(120)]
    chain = list(base)
    for k in range(40):  # each close to the one before it, the ends far apart
        rows.append((100 + k, " ".join(chain)))
        chain[3 * k % 120] = f"x{k}"
    for k in range(60):  # a crowd of copies with one change each
        own = list(base[::-1])
        own[r.randrange(120)] = f"y{k}"
        rows.append((300 + k, " ".join(own)))
    rows += [(305, "one"), (305, "other text here now"), (400, "other text here now"), (None, "one"), (None, "alone")]
    rows += [(500 + k, " ".join(base[:60] + [r.choice(words) for _ in range(60)])) for k in range(20)]
    r.shuffle(rows)
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, node int")
    assert result(df, 4) == brute(rows, 4)
    assert find_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(2)
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(40)] + [(7, 7), (300, 299), (299, 300)]
    edges += [(r.randrange(1000, 1100), r.randrange(1000, 1100)) for _ in range(60)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root[x] for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
