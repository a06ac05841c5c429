"""Token ids in Simple-8b files: written by Spark tasks, read back vectorised.

Method: Simple-8b word-aligned coding.  A 64-bit word holds a 4-bit selector and 60 data bits;
the selector says how many ids of how many bits the word packs.  Each position takes the
selector that packs most ids.  A block holds ``BLOCK`` ids and starts on a word boundary, so
blocks are encoded and decoded side by side.  Ids of ``ESCAPE_BITS`` bits or more do not fit a
word: their place holds 0 and the value stands in the block's escape list.

A file is one range of documents in id order::

    blocks     words (u64 LE), then escapes as (u32 place in block, u64 id)
    footer     per block: u64 byte offset, u32 ids, u32 words, u32 escapes
               per document: i64 id, u8 (1 if the id is null), u64 number of ids
               u64 footer offset, u32 part number, u32 blocks, u64 documents, magic ``S8BFILE1``

Every block and the footer is one row of Spark's text writer, which sends a string's bytes
unchanged and adds one line feed; the offsets in the footer allow for it.  So files are written
by executors to any store Spark can write to, with its commit protocol behind them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.common import ids_and_texts
from tidemark.llm.tokens import BYTE_BPE, encode_column
from tidemark.llm.words import parts
from tidemark.session import cut_lineage

BLOCK = 4096
ESCAPE_BITS = 60
MAGIC = b"S8BFILE1"
_TAIL = np.dtype([("footer", "<u8"), ("part", "<u4"), ("blocks", "<u4"), ("docs", "<u8"), ("magic", "S8")])
_BLOCK = np.dtype([("at", "<u8"), ("ids", "<u4"), ("words", "<u4"), ("escapes", "<u4")])
_DOC = np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u8")])
_ESCAPE = np.dtype([("place", "<u4"), ("id", "<u8")])
# fixed values: ids per word and bits per id, by selector
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_AT_ONCE = 1 << 20


# --- the coding ----------------------------------------------------------------------


def encode_blocks(ids: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(number of ids, words, escapes) of each block of ``BLOCK`` ids; the last may be shorter."""
    if not len(ids):
        return []
    ids = ids.astype(np.uint64)
    blocks = -(-len(ids) // BLOCK)
    reach = int(COUNTS.max())
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[:len(ids)] = ids
    wide = np.flatnonzero(flat >> np.uint64(ESCAPE_BITS))
    escaped = flat[wide]
    flat[wide] = 0
    # each block is followed by zeros, which its last word may pack along
    grid = np.zeros((blocks, BLOCK + reach), np.uint64)
    grid[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    # bits of each id, and from these the widest id of the next n, by doubling
    bits = np.minimum(np.frexp(grid.astype(np.float64))[1], ESCAPE_BITS).astype(np.uint8)
    widest = {1: bits}
    for n in sorted(set(COUNTS.tolist()))[1:]:
        half = max(k for k in widest if 2 * k >= n or k == max(widest))
        near = widest[half]
        while 2 * half < n:
            near = _wider(near, near, half)
            half *= 2
        widest[n] = _wider(near, near, n - half)
    last = np.uint8(len(COUNTS) - 1)
    choice = np.full((blocks, BLOCK), last)
    for s in range(last):
        fits = widest[int(COUNTS[s])][:, :BLOCK] <= BITS[s]
        if fits.any():
            np.minimum(choice, last - fits * (last - np.uint8(s)), out=choice)
    # all blocks walk from word to word together
    place = np.arange(blocks, dtype=np.int64) * BLOCK
    stop = place + BLOCK
    taken = np.zeros(blocks * BLOCK, bool)
    step = COUNTS[choice].reshape(-1)
    while len(place):
        taken[place] = True
        place = place + step[place]
        open_ = place < stop
        if not open_.all():
            place, stop = place[open_], stop[open_]
    owner, start = np.divmod(np.flatnonzero(taken), BLOCK)
    real = owner * BLOCK + start < len(ids)
    start, owner = start[real], owner[real]
    selector = choice[owner, start]
    words = selector.astype(np.uint64) << np.uint64(60)
    line, spot = grid.reshape(-1), owner * grid.shape[1] + start
    for s in np.unique(selector):
        if BITS[s]:
            at = np.flatnonzero(selector == s)
            packed, place = words[at], spot[at]
            for k in range(COUNTS[s]):
                packed |= line[place + k] << np.uint64(k * BITS[s])
            words[at] = packed
    cut = np.searchsorted(owner, np.arange(blocks + 1))
    which = np.searchsorted(wide, np.arange(blocks + 1) * BLOCK)
    out = []
    for b in range(blocks):
        lost = np.zeros(which[b + 1] - which[b], _ESCAPE)
        lost["place"] = wide[which[b]:which[b + 1]] - b * BLOCK
        lost["id"] = escaped[which[b]:which[b + 1]]
        out.append((min(BLOCK, len(ids) - b * BLOCK), words[cut[b]:cut[b + 1]], lost))
    return out


def _wider(a: np.ndarray, b: np.ndarray, by: int) -> np.ndarray:
    """Larger of each value and the one ``by`` places on; nothing stands beyond the end."""
    out = a.copy()
    np.maximum(a[:, :-by], b[:, by:], out=out[:, :-by])
    return out


def decode_blocks(blocks: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """All ids of consecutive blocks."""
    if not blocks:
        return np.zeros(0, np.uint64)
    words = np.concatenate([w for _, w, _ in blocks])
    selector = (words >> np.uint64(60)).astype(np.int64)
    n = COUNTS[selector]
    ends = np.cumsum(n)
    out = np.zeros(int(ends[-1]), np.uint64)
    for s in np.unique(selector):
        if BITS[s]:
            at = np.flatnonzero(selector == s)
            shifts = (np.arange(COUNTS[s]) * BITS[s]).astype(np.uint64)
            mask = np.uint64((1 << int(BITS[s])) - 1)
            out[(ends[at] - n[at])[:, None] + np.arange(COUNTS[s])] = (words[at][:, None] >> shifts) & mask
    lengths = np.array([len(w) for _, w, _ in blocks])
    block_ends = np.concatenate([[0], ends[np.cumsum(lengths) - 1]])
    parts = []
    for b, (count, _, lost) in enumerate(blocks):
        ids = out[block_ends[b]:block_ends[b] + count]
        ids[lost["place"]] = lost["id"]
        parts.append(ids)
    return np.concatenate(parts)


# --- files ---------------------------------------------------------------------------


def write_token_files(docs: DataFrame, path: str, tokenizer: str = BYTE_BPE, end_id: int | None = 2,
                      id_column: str = "doc_id", text_column: str = "text", file_bytes: int = 64 << 20) -> None:
    """Encode whole texts and write their ids in ascending id order, about ``file_bytes`` of text a file.

    A null text is empty (its only id is ``end_id``); null ids come first; rows with equal
    ids follow each other in the order of a hash of their text, so they may span files.
    ``end_id`` None appends nothing.  Columns other than id and text are not read.
    """
    rows = ids_and_texts(docs, id_column, text_column, "bigint")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // file_bytes))
    ordered = (rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(files, "id", "tie")
                   .sortWithinPartitions("id", "tie").drop("tie"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, blocks, docs_seen = 0, [], []
        waiting: list[np.ndarray] = []  # ids not yet in a block
        held = 0

        def rows_of(packed: list) -> Iterator[pa.RecordBatch]:
            nonlocal at
            data = []
            for count, words, lost in packed:
                data.append(words.astype("<u8").tobytes() + lost.tobytes())
                blocks.append((at, count, len(words), len(lost)))
                at += len(data[-1]) + 1
            if data:
                yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary())], ["value"])

        for batch in batches:
            for first, last in parts(batch.column(1)):
                names, texts = (batch.column(k).slice(first, last - first) for k in (0, 1))
                ids, n = encode_column(tokenizer, texts)
                if end_id is not None:
                    ids, n = np.insert(ids, np.cumsum(n), end_id), n + 1
                seen = np.zeros(len(n), _DOC)
                seen["id"], seen["null"], seen["n"] = pc.fill_null(names, 0).to_numpy(), names.is_null().to_numpy(False), n
                docs_seen.append(seen)
                waiting.append(ids)
                held += len(ids)
                if held >= _AT_ONCE:
                    ids = np.concatenate(waiting)
                    whole = held // BLOCK * BLOCK
                    yield from rows_of(encode_blocks(ids[:whole]))
                    waiting, held = [ids[whole:]], held - whole
        yield from rows_of(encode_blocks(np.concatenate([np.zeros(0, "<u4"), *waiting])))
        table = np.concatenate(docs_seen) if docs_seen else np.zeros(0, _DOC)
        tail = np.array([(at, TaskContext.get().partitionId(), len(blocks), len(table), MAGIC)], _TAIL)
        footer = np.array(blocks, _BLOCK).tobytes() + table.tobytes() + tail.tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([footer], pa.binary())], ["value"])

    (ordered.mapInArrow(encode, "value binary").select(F.col("value").cast("string").alias("value"))
            .write.option("lineSep", "\n").option("compression", "none").text(path))


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """part, place (in its file), doc_id, start (in its file), n_tokens, ids_crc32 [, ids] per document."""
    schema = "part bigint, place bigint, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    types = [pa.int64()] * 6
    if with_ids:
        schema, types = schema + ", ids array<bigint>", types + [pa.list_(pa.int64())]
    names = [f.split()[0] for f in schema.split(", ")]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                for rows in _documents(data.as_buffer(), with_ids):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(decode, schema)


def _documents(data, with_ids: bool) -> Iterator[list]:
    raw = np.frombuffer(data, np.uint8)
    tail = raw[len(raw) - 1 - _TAIL.itemsize:len(raw) - 1].view(_TAIL)[0]
    if tail["magic"] != MAGIC:
        raise ValueError("not a token file")
    at = int(tail["footer"])
    blocks = raw[at:at + int(tail["blocks"]) * _BLOCK.itemsize].view(_BLOCK)
    at += blocks.nbytes
    docs = raw[at:at + int(tail["docs"]) * _DOC.itemsize].view(_DOC)
    ends = np.cumsum(docs["n"].astype(np.int64))
    have, have_from, done, next_block = np.zeros(0, np.uint64), 0, 0, 0
    while done < len(docs):
        # documents in steps of about a million ids, or one longer document
        upto = max(done + 1, int(np.searchsorted(ends, have_from + _AT_ONCE)))
        while have_from + len(have) < ends[upto - 1]:
            some = []
            while next_block < len(blocks) and len(some) < 256:
                b = blocks[next_block]
                w = int(b["at"])
                e = w + 8 * int(b["words"])
                some.append((int(b["ids"]), raw[w:e].view("<u8"),
                             raw[e:e + int(b["escapes"]) * _ESCAPE.itemsize].view(_ESCAPE)))
                next_block += 1
            have = np.concatenate([have, decode_blocks(some)])
        rows: list[list] = [[] for _ in range(6 + with_ids)]
        for k in range(done, upto):
            n = int(docs["n"][k])
            start = int(ends[k]) - n
            ids = have[start - have_from:start - have_from + n].astype("<u4")
            values = [int(tail["part"]), k, None if docs["null"][k] else int(docs["id"][k]), start, n,
                      zlib.crc32(ids.tobytes())]
            for column, v in zip(rows, values + [ids.tolist()] * with_ids):
                column.append(v)
        used = int(ends[upto - 1]) - have_from
        have, have_from, done = have[used:], have_from + used, upto
        yield rows


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start over all files, n_tokens, ids_crc32: decoded from the files."""
    docs = cut_lineage(read_token_files(spark, path))
    totals = docs.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row per file
    before = W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return docs.join(bases, "part").select("doc_id", (F.col("start") + F.col("base")).alias("start"),
                                           "n_tokens", "ids_crc32")
