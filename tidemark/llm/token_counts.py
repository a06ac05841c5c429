"""Exact token counts of documents of any length.

Method: overlap resynchronisation.  A document longer than ``chunk_chars`` becomes chunks that
overlap by ``overlap_chars`` and are dealt over the cluster.  Each chunk is encoded with
offsets.  In an overlap the left chunk *proves* boundaries: a word of the tokenizer's own
pre-splitting that ends ``MARGIN`` characters before the chunk's end cannot depend on what
follows.  Where the right chunk has a word start at a proven boundary, both scans run alike
from there on, so the two are spliced at that place and the tokens counted once.  A document
with an overlap that has no common boundary (a run of letters longer than the overlap, say) is
encoded again with four times wider chunks and overlaps, until one chunk holds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import by_size, ids_and_texts, spread
from tidemark.llm.tokens import BYTE_BPE, encode_ids, load
from tidemark.llm.words import parts
from tidemark.session import cut_lineage

MARGIN = 32  # more than any added token's text and any look-ahead of the pre-splitting
_AT_ONCE = 1 << 20

_BOUNDS = "array<struct<at:bigint,n:bigint>>"
_CHUNK = f"row string, chunk bigint, n_tokens bigint, head {_BOUNDS}, tail {_BOUNDS}"


def count_tokens(docs: DataFrame, tokenizer: str = BYTE_BPE, limit: int = 1024, id_column: str = "doc_id",
                 text_column: str = "text", chunk_chars: int = 16_384, overlap_chars: int = 512) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Counts are those of the library on the whole text, without added special tokens and
    without truncation.  A null text counts as empty (0 bytes, 0 tokens); repeated rows and
    null ids are counted row by row; columns other than id and text are not read.  Files
    ending in ``.model`` have no offsets that prove a boundary and are encoded whole.
    """
    rows = ids_and_texts(docs, id_column, text_column)
    rows = spread(rows)
    whole = tokenizer.endswith(".model")
    short = rows if whole else rows.where(F.length("text") <= chunk_chars)
    id_type = rows.schema["id"].dataType.simpleString()

    def short_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[int] = []
            for first, last in parts(batch.column(1), _AT_ONCE):
                texts = batch.column(1).slice(first, last - first).to_pylist()
                counts += [len(ids) // 4 for ids in encode_ids(tokenizer, texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    counted = (short.withColumn("n_bytes", F.octet_length("text").cast("bigint"))
                    .mapInArrow(short_counts, f"id {id_type}, n_bytes bigint, n_tokens bigint"))
    if not whole:
        # a digest names a long text: copies are encoded once, and a task that runs again gives the same names
        long = rows.where(F.length("text") > chunk_chars).withColumn("row", F.md5("text"))
        sizes = long.select("row", "id", F.octet_length("text").cast("bigint").alias("n_bytes"))
        spliced = _long_counts(long.select("row", "text"), tokenizer, chunk_chars, overlap_chars)
        counted = counted.unionByName(sizes.join(spliced, "row").select("id", "n_bytes", "n_tokens"))
    return counted.select(F.col("id").alias(id_column), "n_bytes", "n_tokens",
                          (F.col("n_tokens") > limit).alias("over_limit"))


def _long_counts(long: DataFrame, tokenizer: str, chunk_chars: int, overlap_chars: int) -> DataFrame:
    """row, n_tokens of every long document; widens until no overlap is left unaligned."""
    done = None
    while True:
        chunks = cut_lineage(_encoded_chunks(long, tokenizer, chunk_chars, overlap_chars))
        counts = _spliced(chunks)
        part = counts.where("unaligned = 0").select("row", "n_tokens")
        done = part if done is None else done.unionByName(part)
        failed = counts.where("unaligned > 0").select("row")
        if failed.isEmpty():
            return done
        long = long.join(failed, "row", "left_semi")
        chunk_chars, overlap_chars = 4 * chunk_chars, 4 * overlap_chars


def _encoded_chunks(long: DataFrame, tokenizer: str, size: int, overlap: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                # the last chunk is longer than the overlap, or there is only one
                starts = list(range(0, max(1, len(text) - overlap), size))
                for at in range(0, len(starts), 64):
                    part = starts[at:at + 64]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row] * len(part), pa.string()), pa.array([s // size for s in part], pa.int64()),
                         pa.array([s == starts[-1] for s in part], pa.bool_()),
                         pa.array([text[s:] if s == starts[-1] else text[s:s + size + overlap] for s in part],
                                  pa.string())], ["row", "chunk", "last", "text"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(tokenizer)
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(4))))
            for part in by_size(rows, (len(r[3]) for r in rows), _AT_ONCE):
                out = []
                codes = model.encode_batch([r[3] for r in part], add_special_tokens=False)
                for (row, chunk, last, text), code in zip(part, codes):
                    base = chunk * size
                    head = _starts(code, 0, min(overlap, len(text))) if chunk else []
                    tail = [] if last else _starts(code, size, size + overlap - MARGIN)
                    out.append((row, chunk, len(code), [{"at": base + p, "n": n} for p, n in head],
                                [{"at": base + p, "n": n} for p, n in tail]))
                bounds = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), [pa.string(), pa.int64(), pa.int64(), bounds, bounds])],
                    ["row", "chunk", "n_tokens", "head", "tail"])

    pieces = long.mapInArrow(cut, "row string, chunk bigint, last boolean, text string")
    return pieces.dropDuplicates(["row", "chunk"]).mapInArrow(encode, _CHUNK)


def _starts(code, low: int, high: int) -> list[tuple[int, int]]:
    """(character, tokens before it) of the words that start in [low, high) of one chunk.

    Tokens of one character's bytes share its place, so a start is where the word number
    changes, and that at the first token of the new word.
    """
    first = None
    for at in range(low, high):
        first = code.char_to_token(at)
        if first is not None:
            break
    if first is None:
        return []
    found, n = [], first
    total = len(code)
    while n > 0 and code.token_to_word(n - 1) == code.token_to_word(n):
        n -= 1  # low may lie inside a word: step back to where it starts
    word = None
    while n < total:
        at = code.token_to_chars(n)[0]
        if at >= high:
            break
        if code.token_to_word(n) != word:
            word = code.token_to_word(n)
            if at >= low:
                found.append((at, n))
        n += 1
    return found


def _spliced(chunks: DataFrame) -> DataFrame:
    """Tokens per row: all chunks, less what lies beyond each splice on its two sides."""
    left = chunks.select("row", (F.col("chunk") + 1).alias("chunk"), "tail", F.col("n_tokens").alias("all"))
    right = chunks.where("chunk > 0").select("row", "chunk", "head")
    cut = F.array_min(F.array_intersect("tail.at", "head.at"))
    at = right.join(left, ["row", "chunk"]).withColumn("cut", cut)
    kept = F.element_at(F.map_from_entries("tail"), F.col("cut"))
    skipped = F.element_at(F.map_from_entries("head"), F.col("cut"))
    twice = at.select("row", F.when(F.col("cut").isNotNull(), F.col("all") - kept + skipped).alias("twice"))
    parts = (chunks.select("row", "n_tokens", F.lit(0).alias("bad"))
                   .unionByName(twice.select("row", (-F.coalesce("twice", F.lit(0))).alias("n_tokens"),
                                             F.col("twice").isNull().cast("int").alias("bad"))))
    return parts.groupBy("row").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("bad").alias("unaligned"))
