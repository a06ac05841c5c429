"""Words of UTF-8 texts as 64-bit hashes, found over whole Arrow batches with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_PIECE = 1 << 20
_MASK64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_RNG = np.random.default_rng(20240229)
_BYTE_CODE = _RNG.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0xD6E8FEB86659FD93)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32  # A-Z only


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_bytes(*separators: tuple[int, int]) -> np.ndarray:
    """Table of 256: which bytes belong to words; separators are inclusive ranges."""
    table = np.ones(256, bool)
    for low, high in separators:
        table[low:high + 1] = False
    return table


# fixed byte classes of the two word definitions in use
SPACED = word_bytes((0x20, 0x20), (0x09, 0x0D))
ALPHANUMERIC = word_bytes((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads differences to all bits."""
    x = (x ^ x >> np.uint64(32)) * _MIX
    x = (x ^ x >> np.uint64(29)) * _MIX
    return x ^ x >> np.uint64(32)


_POWERS: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, _PIECE + 1)
        _POWERS[:] = [_powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)]
    return _POWERS[0], _POWERS[1]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and the n + 1 offsets of its texts."""
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0]:bounds[-1]], (bounds - bounds[0]).astype(np.int64)


def parts(column: pa.Array, most: int = 4 << 20):
    """(first, last + 1) row ranges of about ``most`` bytes each."""
    _, bounds = text_buffer(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + most, "right")) - 1)
        yield first, last
        first = last


def find_words(data: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, end, hash) of every word, A-Z lower-cased, and per text the index of its first word.

    The bytes are worked on in pieces that end between words, so memory grows with the
    number of words, not with eight bytes for each byte of text.
    """
    starts, ends, hashes = [], [], []
    inner = np.zeros(len(data) + 1, bool)
    inner[bounds[:-1]] = True  # a text starts here: a word never runs over
    low, size = 0, len(data)
    while low < size:
        high = min(size, low + _PIECE)
        while high < size:
            back = np.flatnonzero(~table[LOWER[data[low:high]]])  # a capital is part of a word
            if len(back):
                high = low + int(back[-1]) + 1
                break
            high = min(size, high + _PIECE)  # one word fills the piece
        piece = LOWER[data[low:high]]
        word = table[piece]
        fresh = inner[low:high]
        begin = word.copy()
        begin[1:] &= ~word[:-1] | fresh[1:]
        stop = word.copy()
        stop[:-1] &= ~word[1:] | fresh[1:]
        s, e = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        if len(s):
            power, inverse = _tables(len(piece) + 1)
            sums = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(_BYTE_CODE[piece] * power[:len(piece)], out=sums[1:])
            starts.append(s + low)
            ends.append(e + low)
            hashes.append(mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64)))
        low = high
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    code = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return start, end, code, np.searchsorted(start, bounds)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive words, over all texts together."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(_BASE) + words[k:k + n])
    return out
