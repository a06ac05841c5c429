"""Documents packed into fixed-length training sequences with next to no padding.

Method: minimum bin slack.  Whole windows of ``capacity`` ids leave a document as they are;
its remainder waits in a pool.  A sequence starts with the longest waiting piece, and a
subset-sum over the multiset of waiting lengths (one big integer as the bitset of reachable
sums, counts split in powers of two) finds the sum closest to the room left; walking the saved
bitsets back gives how many pieces of each length make that sum.  Only where no multiset fills
the room exactly is one further piece cut to close the gap.

The rows of each task are packed on their own, with a pool of bounded size: no shuffle, no
shared state.  What is left at a task's end (less than one sequence) is cut at powers of two,
which need no padding.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict, deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ids_and_texts, spread
from tidemark.llm.tokens import BYTE_BPE, KNOWN, encode_ids
from tidemark.llm.words import parts

_AT_ONCE = 1 << 20
_POOL_IDS = 1 << 22  # waiting ids before sequences are made: 16 MB
_SEQUENCE_BITS = 36  # sequences of one task


def fill(lengths: list[int], count: Callable[[int], int], room: int) -> dict[int, int]:
    """How many pieces of each length sum closest to ``room`` without passing it.

    ``lengths`` are ascending, ``count`` has the number of pieces of a length.  Longer pieces
    are tried first and the search ends as soon as the room can be filled to the last id.
    """
    reach, mask, steps = 1, (1 << room + 1) - 1, []
    for k in range(bisect_right(lengths, room) - 1, -1, -1):
        length = lengths[k]
        left, group = min(count(length), room // length), 1
        while left:
            take = min(group, left)
            more = reach | reach << length * take & mask
            if more != reach:
                steps.append((length, take, reach))
                reach = more
            left -= take
            group *= 2
        if reach >> room & 1:
            break
    target = reach.bit_length() - 1
    chosen: dict[int, int] = defaultdict(int)
    for length, take, before in reversed(steps):
        if not before >> target & 1:
            target -= length * take
            chosen[length] += take
    return chosen


class Packer:
    """Sequences of one task; ``out`` gets (doc, start, ids, doc_tokens, sequence, offset, sequence length)."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.sequence = capacity, first
        self.pool: dict[int, deque] = {}
        self.lengths: list[int] = []  # of the pool, ascending
        self.waiting = 0
        self.out: list[tuple] = []

    def add(self, doc, ids: np.ndarray) -> None:
        whole = len(ids) // self.capacity * self.capacity
        for at in range(0, whole, self.capacity):
            self._emit([(doc, at, ids[at:at + self.capacity], len(ids))])
        if whole < len(ids):
            self._wait((doc, whole, ids[whole:].copy(), len(ids)))

    def pack(self, leave: int) -> None:
        """Make full sequences until at most ``leave`` ids wait."""
        while self.waiting > leave and self.waiting >= self.capacity:
            pieces = [self._take(self.lengths[-1])]
            room = self.capacity - len(pieces[0][2])
            if room:
                for length, n in fill(self.lengths, lambda k: len(self.pool[k]), room).items():
                    pieces += [self._take(length) for _ in range(n)]
                    room -= length * n
            if room:
                pieces.append(self._cut(self.lengths[-1], room))
            self._emit(pieces)

    def finish(self) -> None:
        self.pack(0)
        while self.waiting:
            room = 1 << self.waiting.bit_length() - 1
            pieces = []
            while room:
                length = self.lengths[-1]
                pieces.append(self._take(length) if length <= room else self._cut(length, room))
                room -= len(pieces[-1][2])
            self._emit(pieces)

    def _wait(self, piece: tuple) -> None:
        length = len(piece[2])
        if length not in self.pool:
            self.pool[length] = deque()
            insort(self.lengths, length)
        self.pool[length].append(piece)
        self.waiting += len(piece[2])

    def _take(self, length: int) -> tuple:
        queue = self.pool[length]
        piece = queue.popleft()
        if not queue:
            del self.pool[length]
            del self.lengths[bisect_left(self.lengths, length)]
        self.waiting -= length
        return piece

    def _cut(self, length: int, n: int) -> tuple:
        doc, start, ids, total = self._take(length)
        self._wait((doc, start + n, ids[n:], total))
        return doc, start, ids[:n], total

    def _emit(self, pieces: list[tuple]) -> None:
        offset, size = 0, sum(len(p[2]) for p in pieces)
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, ids, total, self.sequence, offset, size))
            offset += len(ids)
        self.sequence += 1


def pack(docs: DataFrame, capacity: int = 2048, tokenizer: str = BYTE_BPE, end_id: int | None = 1,
         id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False, known: int = KNOWN) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens [, ids].

    Every id of every document lies in exactly one piece; pieces of a sequence are gapless.
    Sequences have ``capacity`` ids, but for the last few of each task, which have a power of
    two.  A null text is empty and still has ``end_id``; with ``end_id`` None an empty
    document has no piece.  ``known`` bounds the words a worker remembers.  Repeated rows and null ids are packed row by row; columns other
    than id and text are not read.
    """
    rows = spread(ids_and_texts(docs, id_column, text_column))
    id_type = rows.schema["id"].dataType.simpleString()
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    schema = (f"id {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
              "offset bigint, sequence_tokens bigint" + (", ids array<bigint>" if with_ids else ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(capacity, TaskContext.get().partitionId() << _SEQUENCE_BITS)
        kind = pa.null()

        def flush() -> Iterator[pa.RecordBatch]:
            out, packer.out = packer.out, []
            if out:
                doc, start, ids, total, sequence, offset, size = zip(*out)
                columns = [pa.array(doc, kind)] + [pa.array(c, pa.int64()) for c in (
                    start, map(len, ids), (zlib.crc32(i.tobytes()) for i in ids), total, sequence, offset, size)]
                if with_ids:
                    columns.append(pa.array([i.tolist() for i in ids], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])

        for batch in batches:
            kind = batch.schema.field(0).type
            for first, last in parts(batch.column(1), _AT_ONCE):
                names, texts = (batch.column(k).slice(first, last - first).to_pylist() for k in (0, 1))
                for name, ids in zip(names, encode_ids(tokenizer, texts, known)):
                    packer.add(name, np.frombuffer(ids + end, "<u4"))
                if packer.waiting > _POOL_IDS:
                    packer.pack(_POOL_IDS // 2)
                yield from flush()
        packer.finish()
        yield from flush()

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_column)
