"""Contaminated words against a brute-force reading of the definition."""

import hashlib
import re

from tidemark.llm.decontaminate import benchmark_blocks, find_contamination, hit_words
from tidemark.llm.queries import op5_decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for at in range(len(w) - n + 1 if w and i is not None else 0):
            windows.setdefault(tuple(w[at:at + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, named = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for at in range(len(w) - n + 1):
                if own := windows.get(tuple(w[at:at + n])):
                    hit.update(range(at, at + n))
                    named |= own
        out.append((d, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(),
                    bool(hit)))
    return out


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = sorted(tuple(r) for r in op5_decontamination(spark, sf).collect())
    want = sorted(brute(docs, items))
    assert got == want and any(r[-1] for r in want)


ITEMS = [(1, "one two three four five six seven eight nine ten eleven TWELVE"), (2, "short item"), (3, None), (4, " .,"),
         (5, "a a a a a a a a a a a a"), (None, "null id words are not searched for in any document at all"),
         (6, "short item"), (10, "Zürich straße naïve ١٢ x"), (7, "solo"), (2, "another text of two")]
DOCS = [(1, "zero one two three four five six seven eight nine ten x"), (2, None), (3, ""), (4, "Short, ITEM! short item"),
        (5, "a " * 30), (6, "one two three four five six seven eight nine"), (7, "one-two.three four five six seven eight nine"
        "\nten\televen twelve one two"), (8, "zürich STRAßE naïve ١٢ X"), (8, "zürich straße naïve ١٢ X"), (None, "so solo"),
        (9, "ten eleven"), (10, ("filler word " * 3000 + "short item ") * 3), (11, "item short")]


def test_edges_and_blocks(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in DOCS], "doc_id long, text string, items string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = sorted(brute(DOCS, ITEMS), key=str)
    for block in (2, 500_000):
        got = find_contamination(docs, items, block_windows=block)
        rows = [(r.doc_id, r.n_words, r.n, len(r.items), hashlib.sha256(",".join(r.items).encode()).hexdigest(), r.n > 0)
                for r in got.withColumn("n", hit_words()).collect()]
        assert sorted(rows, key=str) == want
    assert find_contamination(docs.limit(0), items).count() == 0
    assert all(not r.hit for r in find_contamination(docs, items.limit(0)).collect())


def test_a_long_item_spans_blocks(spark):
    long = " ".join(f"w{i}" for i in range(400))
    items = [(1, long), (2, " ".join(long.split()[100:300])), (3, "w5 w6")]
    df = spark.createDataFrame(items, "item_id long, text string")
    blocks = list(benchmark_blocks(df, 10, 150, "item_id", "text"))
    assert max(sum(map(len, b.owners)) for b in blocks) <= 150
    pairs = [(t, b.items[i]) for b in blocks for t, o in zip(b.texts, b.owners) for i in o]
    assert len(pairs) == len(set(pairs)) == 391 + 191 + 1
    docs = [(1, long), (2, long[600:1400]), (3, "w4 w5 w6 w7"), (4, "none of it")]
    got = find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), df, block_windows=150)
    rows = [(r.doc_id, r.n_words, r.n, len(r.items), hashlib.sha256(",".join(r.items).encode()).hexdigest(), r.n > 0)
            for r in got.withColumn("n", hit_words()).collect()]
    assert sorted(rows) == sorted(brute(docs, items))
