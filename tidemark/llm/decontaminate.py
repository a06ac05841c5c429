"""Benchmark passages in documents.

Method: prefix-filtered set join.  A benchmark window (``window`` consecutive words of an item)
is a set of shingles of up to ``SHINGLE`` words.  Shingles are ordered by their frequency over
all documents; since a window must be contained whole, its prefix is its single rarest shingle.
Documents join on prefix shingles only.  The place of the prefix inside its window gives the one
start the document's window can have (positional bound), and it must lie inside the document's
words (length bound).  What is left is verified word by word, on hashes and then on the bytes.

The benchmark is the stated query set: it is read in blocks of at most ``block_windows`` windows.
Each block is one broadcast of bounded size and one step over the documents in the same stage, so
documents are never shuffled whatever their keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ids_and_texts, map_texts, pick, spread
from tidemark.llm.words import ALPHANUMERIC, find_words, parts, shingle_hashes, text_buffer

SHINGLE = 3


@dataclass
class Block:
    """Distinct windows of some items, by number of words: hashes, texts and owning items."""

    items: list[str]
    lengths: np.ndarray  # words per window
    hashes: np.ndarray  # window x longest window, zero-padded
    texts: list[bytes]  # words joined by a space
    owners: list[list[int]]  # places in items

    def shingles(self, at: int) -> np.ndarray:
        n = int(self.lengths[at])
        return shingle_hashes(self.hashes[at, :n], min(SHINGLE, n))


@dataclass
class Prefixes:
    """The rarest shingle of each window: sorted hash, window and place in it, by shingle size."""

    size: int
    keys: np.ndarray
    first: np.ndarray  # per key, its first entry
    windows: np.ndarray
    places: np.ndarray


def benchmark_blocks(benchmark: DataFrame, window: int, block_windows: int, id_column: str,
                     text_column: str) -> Iterator[Block]:
    """Blocks of at most ``block_windows`` windows with their owners; an item may go on in the next block.

    Items stream to the driver one by one.
    """
    rows = (pick(benchmark, id=id_column, text=text_column)
            .select(F.col("id").cast("string"), F.col("text").cast("string"))
            .where("id IS NOT NULL AND text IS NOT NULL").dropDuplicates().toLocalIterator())
    items: list[str] = []
    seen: dict[bytes, int] = {}
    words_of: list[np.ndarray] = []
    owners: list[list[int]] = []
    held = 0  # pairs of a window and an owner in the block

    def block() -> Block:
        lengths = np.array([len(w) for w in words_of], np.int64)
        hashes = np.zeros((len(words_of), window), np.uint64)
        for k, w in enumerate(words_of):
            hashes[k, :len(w)] = w
        return Block(list(items), lengths, hashes, list(seen), [list(o) for o in owners])

    for row in rows:
        data = np.frombuffer(row.text.encode("utf-8", "replace"), np.uint8)
        start, end, code, _ = find_words(data, np.array([0, len(data)]), ALPHANUMERIC)
        if not len(code):
            continue
        low = data.tobytes().lower()
        words = [low[s:e] for s, e in zip(start, end)]
        items.append(row.id)
        n = min(window, len(words))
        for at in range(len(words) - n + 1):
            if held >= block_windows:
                yield block()
                for kept in (items, seen, words_of, owners):
                    kept.clear()
                held = 0
                items.append(row.id)
            k = seen.setdefault(b" ".join(words[at:at + n]), len(seen))
            if k == len(words_of):
                words_of.append(code[at:at + n])
                owners.append([])
            if not owners[k] or owners[k][-1] != len(items) - 1:
                owners[k].append(len(items) - 1)
                held += 1
    if seen:
        yield block()


def shingle_frequencies(rows: DataFrame, block: Block) -> dict[int, int]:
    """How often each shingle of the block occurs in all documents; absent ones are left out."""
    wanted = {s: np.unique(np.concatenate(found)) for s in range(1, SHINGLE + 1) if (
        found := [block.shingles(k) for k in range(len(block.lengths)) if min(SHINGLE, block.lengths[k]) == s])}
    shared = rows.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.value
        totals = {s: np.zeros(len(k), np.int64) for s, k in keys.items()}
        for batch in batches:
            for first, last in parts(batch.column(1)):
                data, bounds = text_buffer(batch.column(1).slice(first, last - first))
                _, _, words, edges = find_words(data, bounds, ALPHANUMERIC)
                for s, k in keys.items():
                    codes, _ = _inside(shingle_hashes(words, s), edges, s)
                    place = np.searchsorted(k, codes).clip(max=len(k) - 1)
                    totals[s] += np.bincount(place[k[place] == codes], minlength=len(k))
        for s, k in keys.items():
            some = np.flatnonzero(totals[s])
            yield pa.RecordBatch.from_arrays(
                [pa.array(k[some].view(np.int64)), pa.array(totals[s][some])], ["shingle", "n"])

    counted = rows.mapInArrow(count, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    found = {int(r.shingle): r.n for r in counted.collect()}  # at most the shingles of one block
    shared.destroy()
    return found


def _inside(codes: np.ndarray, edges: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that do not run over the end of a text, and the place of their first word."""
    keep = np.ones(len(codes), bool)
    for back in range(1, size):
        ends = edges[1:-1] - back
        keep[ends[(ends >= 0) & (ends < len(codes))]] = False
    return codes[keep], np.flatnonzero(keep)


def rarest_prefixes(block: Block, frequency: dict[int, int]) -> list[Prefixes]:
    by_size: dict[int, list[tuple]] = {}
    for k in range(len(block.lengths)):
        codes = block.shingles(k)
        ranked = [(frequency.get(int(c), 0), int(c), at) for at, c in enumerate(codes.view(np.int64))]
        rarity, code, at = min(ranked)
        if rarity:  # a window whose rarest shingle is in no document is in no document
            by_size.setdefault(min(SHINGLE, int(block.lengths[k])), []).append((code, k, at))
    out = []
    for size, entries in by_size.items():
        table = np.array(entries, np.int64)
        table = table[np.argsort(table[:, 0].view(np.uint64), kind="stable")]
        keys, first = np.unique(np.ascontiguousarray(table[:, 0]).view(np.uint64), return_index=True)
        out.append(Prefixes(size, keys, np.append(first, len(table)), table[:, 1].copy(), table[:, 2].copy()))
    return out


def find_windows(data: np.ndarray, bounds: np.ndarray, block: Block, prefixes: list[Prefixes]):
    """(text, first word in the text, window) of every verified occurrence, and words per text."""
    start, end, words, edges = find_words(data, bounds, ALPHANUMERIC)
    found = []
    low = None
    for p in prefixes:
        codes, at = _inside(shingle_hashes(words, p.size), edges, p.size)
        key = np.searchsorted(p.keys, codes).clip(max=len(p.keys) - 1)
        hit = np.flatnonzero(p.keys[key] == codes)
        if not len(hit):
            continue
        key, at = key[hit], at[hit]
        many = p.first[key + 1] - p.first[key]
        entry = np.repeat(p.first[key], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        window, first = p.windows[entry], np.repeat(at, many) - p.places[entry]
        text = np.searchsorted(edges, np.repeat(at, many), "right") - 1
        fits = (first >= edges[text]) & (first + block.lengths[window] <= edges[text + 1])
        window, first, text = window[fits], first[fits], text[fits]
        same = np.ones(len(window), bool)
        for k in range(block.hashes.shape[1]):
            inside = k < block.lengths[window]
            same &= ~inside | (words[np.where(inside, first + k, 0)] == block.hashes[window, k])
        for w, f, t in zip(window[same].tolist(), first[same].tolist(), text[same].tolist()):
            if low is None:
                low = data.tobytes().lower()
            n = int(block.lengths[w])
            if b" ".join([low[s:e] for s, e in zip(start[f:f + n], end[f:f + n])]) == block.texts[w]:
                found.append((t, f, w))
    return found, start, end, edges


HITS = "n_words bigint, hit array<struct<start:bigint,end:bigint>>, items array<string>"


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_column: str = "doc_id",
                       text_column: str = "text", item_column: str = "item_id", item_text: str = "text",
                       block_windows: int = 500_000) -> DataFrame:
    """id, n_words, hit (runs of covered words, end exclusive), items (sorted ids of items found) per input row.

    A word is a run of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased.  An
    item with fewer words than ``window`` is one window; items without words, text or id
    take no part, repeated items count once per id.  A null document text has no words.
    Repeated documents and null ids are answered row by row; other columns are not read.
    """
    rows = spread(ids_and_texts(docs, id_column, text_column))
    id_type = rows.schema["id"].dataType.simpleString()
    state = rows.withColumns({"n_words": F.lit(None).cast("bigint"),
                              "hit": F.expr("CAST(NULL AS array<struct<start:bigint,end:bigint>>)"),
                              "items": F.expr("CAST(NULL AS array<string>)")})
    blocks = [None]
    for block in benchmark_blocks(benchmark, window, block_windows, item_column, item_text):
        prefixes = rarest_prefixes(block, shingle_frequencies(rows, block))
        if prefixes:
            state = _step(state, id_type, block, prefixes)
            blocks.append(None)
    if len(blocks) == 1:  # nothing to look for: only count words
        state = _step(state, id_type, Block([], np.zeros(0, np.int64), np.zeros((0, window), np.uint64), [], []), [])
    return state.select(F.col("id").alias(id_column), "n_words", "hit", "items")


def _step(state: DataFrame, id_type: str, block: Block, prefixes: list[Prefixes]) -> DataFrame:
    shared = state.sparkSession.sparkContext.broadcast((block, prefixes))
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, prefixes = shared.value
        for batch in batches:
            n_words, hits, items = [], [], []
            for first, last in parts(batch.column(1)):
                data, bounds = text_buffer(batch.column(1).slice(first, last - first))
                found, _, _, edges = find_windows(data, bounds, block, prefixes)
                n_words += np.diff(edges).tolist()
                runs: list[set] = [set() for _ in range(last - first)]
                named: list[set] = [set() for _ in range(last - first)]
                for t, f, w in found:
                    base = f - int(edges[t])
                    runs[t].add((base, base + int(block.lengths[w])))
                    named[t].update(block.items[i] for i in block.owners[w])
                for k in range(first, last):
                    for r in batch.column(3)[k].as_py() or ():
                        runs[k - first].add((r["start"], r["end"]))
                    named[k - first].update(batch.column(4)[k].as_py() or ())
                hits += [_merged(r) for r in runs]
                items += [sorted(n) for n in named]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(hits, run_type),
                 pa.array(items, pa.list_(pa.string()))], ["id", "text", "n_words", "hit", "items"])

    return state.mapInArrow(look, f"id {id_type}, text string, {HITS}")


def _merged(runs: set) -> list[dict]:
    out: list[dict] = []
    for start, end in sorted(runs):
        if out and start <= out[-1]["end"]:
            out[-1]["end"] = max(end, out[-1]["end"])
        else:
            out.append({"start": start, "end": end})
    return out


def hit_words():
    """Number of covered words."""
    return F.aggregate("hit", F.lit(0).cast("bigint"), lambda a, r: a + r["end"] - r["start"])


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_column: str = "text",
               item_column: str = "item_id", item_text: str = "text", block_windows: int = 500_000) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs, with all their columns.

    The same search as ``find_contamination``; the texts are only asked yes or no, so rows
    do not travel.
    """
    columns = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    at = columns.index(text_column)
    text = F.coalesce(F.col(f"c{at}").cast("string"), F.lit(""))
    probe = plain.select(F.lit(0).alias("id"), text.alias("text"))
    kept = plain
    for block in benchmark_blocks(benchmark, window, block_windows, item_column, item_text):
        prefixes = rarest_prefixes(block, shingle_frequencies(probe, block))
        if prefixes:
            kept = _without_hits(kept, at, block, prefixes)
    return kept.toDF(*columns)


def _without_hits(docs: DataFrame, at: int, block: Block, prefixes: list[Prefixes]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((block, prefixes))

    def keep(batch: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
        own, keys = shared.value
        clean = np.ones(len(texts), bool)
        data, bounds = text_buffer(texts)
        clean[[t for t, _, _ in find_windows(data, bounds, own, keys)[0]]] = False
        return batch.filter(pa.array(clean))

    return map_texts(docs, at, keep)
