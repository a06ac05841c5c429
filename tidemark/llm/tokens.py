"""Public tokenizer files inside Spark tasks."""

from __future__ import annotations

import functools
import itertools
import os
import re
from array import array

import numpy as np
import pyarrow as pa

from tidemark.llm.words import text_buffer

BYTE_BPE = "byte_bpe_50k.json"


def resolve(name: str) -> str:
    """A file name of the public collection, or a path every executor has."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def load(name: str):
    """The library's tokenizer, once per Python worker and on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(resolve(name))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@functools.cache
def load_pieces(name: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=resolve(name))


# A space between two characters that are no white space.  The byte-level pattern always
# starts a new match there, whatever stands around it, so both sides encode on their own.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_OTHER_SPACES = ("\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
                 "\u2028\u2029\u202f\u205f\u3000")
# Letters whose class every Unicode version agrees on, then marks that take no letter with them.
_WORD_MARKS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([.,;:!?%$&*#|]*)")
# The byte-level alphabet: bytes that print stand for themselves, the others for 256, 257, ...
_HIDDEN = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
_ALPHABET = {b: 256 + k for k, b in enumerate(_HIDDEN)}
KNOWN = 1_000_000  # remembered pieces: about 200 MB of a Python worker


class WordEncoder(dict):
    """Ids of whole texts for byte-level BPE, remembering the ids of words seen before.

    A text is cut at single spaces (see ``_CUT``); each unseen piece goes through the
    tokenizers library once and its ids are kept as little-endian unsigned 32-bit bytes.
    A space and letters are one word of the pre-splitting and go to the library's model at
    once; marks behind it are a word of their own, and so is a line feed between two
    characters that are no white space: a piece that starts with one stands at a line's start.  When more
    than ``known`` pieces are kept, the later ones go: frequent words come early.
    """

    def __init__(self, name: str):
        super().__init__()
        self.tokenizer = load(name)
        self.split = self.tokenizer.model.tokenize
        self.plain: dict[str, bytes] = {}
        self.known = KNOWN

    def __missing__(self, word: str) -> bytes:
        if word.isalpha() and word.isascii():
            ids = self._model_ids("Ġ" + word)
        elif word[:1] == "\n":
            ids = self._marks("\n") + self._word("", word[1:])
        else:
            ids = self._word(" ", word)
        self[word] = ids
        return ids

    def _word(self, start: str, word: str) -> bytes:
        lettered = _WORD_MARKS.fullmatch(word)
        if not lettered:
            return self._one(start + word)
        if start and lettered[2]:
            return self[lettered[1]] + self._marks(lettered[2])
        return self._model_ids((start + lettered[1]).encode().decode("latin-1").translate(_ALPHABET)) + \
            self._marks(lettered[2])

    def _model_ids(self, spelled: str) -> bytes:
        """Ids of one word spelled in the byte-level alphabet."""
        return array("I", [t.id for t in self.split(spelled)]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [_CUT.split(t) if _odd(t) else t.replace("\n", " \n").split(" ") for t in texts]
        out = [self._one(c[0]) + b"".join(map(self.__getitem__, c[1:])) for c in cut]
        if len(self) > self.known:
            self._forget()
        return out

    def _forget(self) -> None:
        kept = list(itertools.islice(self.items(), self.known * 3 // 5))
        self.clear()
        self.update(kept)
        self.plain.clear()

    def _marks(self, marks: str) -> bytes:
        if marks not in self.plain:
            self.plain[marks] = self._one(marks) if marks else b""
        return self.plain[marks]

    def _one(self, piece: str) -> bytes:
        return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()


def _odd(text: str) -> bool:
    """Whether white space stands at an end of the text or beside other white space, or is of a rare kind."""
    return (text[:1].isspace() or text[-1:].isspace() or "  " in text or "\n\n" in text or " \n" in text or "\n " in text
            or any(c in text for c in _OTHER_SPACES))


@functools.cache
def word_encoder(name: str) -> WordEncoder:
    return WordEncoder(name)


# Bytes by what a piece may end or start with.  No match of the byte-level pattern holds a letter and then
# something that is neither letter nor mark of a letter, nor any character and then white space.
_LETTER, _NO_LETTER, _SOLID, _FIRST = (np.zeros(256, bool) for _ in range(4))
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_NO_LETTER[:128] = ~_LETTER[:128]
_NO_LETTER[ord("|")] = False  # <|endoftext|> is one token
_SOLID[0x21:] = True
_FIRST[0x21:] = True  # begins a character that is no white space
_WIDE_SPACES = (0xC2, 0xE1, 0xE2, 0xE3)  # first bytes of all white space beyond ASCII
_FIRST[[*_WIDE_SPACES]] = False
_PIECE = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+")
_SPELLED = [chr(_ALPHABET.get(b, b)) for b in range(256)]


def piece_bounds(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Offsets of pieces of the texts that the byte-level pattern matches apart, whatever stands around them.

    Texts are cut behind a letter A-Z or a-z, before a space or line feed behind another character
    that is no white space, and behind a line feed between two such characters.
    """
    size = len(data)
    cut = np.zeros(size + 1, bool)
    cut[bounds] = True
    cut[1:-1] |= _LETTER[data[:-1]] & _NO_LETTER[data[1:]]
    line = data == 0x0A
    at = np.flatnonzero((data == 0x20) | line)
    at = at[at > 0]
    at = at[_SOLID[data[at - 1]]]
    wide = np.isin(data[np.maximum(at - 2, 0)], _WIDE_SPACES) | np.isin(data[np.maximum(at - 3, 0)], _WIDE_SPACES)
    at = at[~(wide & (data[at - 1] >= 0x80))]
    cut[at] = True
    fed = at[line[at] & (at + 1 < size)]
    cut[fed[_FIRST[data[fed + 1]] & ~cut[fed + 1]] + 1] = True
    return np.flatnonzero(cut)


class PieceEncoder(WordEncoder):
    """As ``WordEncoder``, for a column of texts: each different piece of it is looked up once."""

    def __init__(self, name: str):
        super().__init__(name)
        self.coded = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size())]

    def __missing__(self, piece: str) -> bytes:
        if not _PIECE.fullmatch(piece):
            ids = self._one(piece)
        elif piece.isascii():
            ids = self._model_ids(piece.replace(" ", "Ġ"))
        else:
            ids = self._model_ids("".join(map(_SPELLED.__getitem__, piece.encode())))
        self[piece] = ids
        return ids

    def _model_ids(self, spelled: str) -> bytes:
        return b"".join([self.coded[t.id] for t in self.split(spelled)])

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many of them are each text's."""
        data, bounds = text_buffer(texts)
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        offsets = piece_bounds(data, bounds)
        pieces = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        own = [self[p] for p in pieces.dictionary.to_numpy(zero_copy_only=False).tolist()]
        if len(self) > self.known:
            self._forget()
        kind = pieces.indices.to_numpy()
        flat = np.frombuffer(b"".join(own), "<u4")
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // 4
        n = sizes[kind]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[kind] - ends[:-1], n) + np.arange(ends[-1])]
        return ids, np.diff(ends[np.searchsorted(offsets, bounds)])


@functools.cache
def piece_encoder(name: str) -> PieceEncoder:
    return PieceEncoder(name)


def encode_column(name: str, texts: pa.Array, known: int = KNOWN) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a column of texts without nulls one after the other, and how many are each text's; as ``encode_ids``."""
    if os.path.basename(name) == BYTE_BPE:
        encoder = piece_encoder(name)
        encoder.known = known
        return encoder.encode_column(texts)
    coded = encode_ids(name, texts.to_pylist(), known)
    return np.frombuffer(b"".join(coded), "<u4"), np.fromiter(map(len, coded), np.int64, len(coded)) // 4


def encode_ids(name: str, texts: list[str], known: int = KNOWN) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit bytes, as the library gives them.

    At most about ``known`` pieces of text are remembered from one call to the next.  Tables other than the byte-level one go through the library text by text.
    """
    if name.endswith(".model"):
        return [np.array(x, "<u4").tobytes() for x in load_pieces(name).encode(texts, num_threads=1)]
    if os.path.basename(name) == BYTE_BPE:
        encoder = word_encoder(name)
        encoder.known = known
        return encoder.encode(texts)
    return [np.array(e.ids, "<u4").tobytes() for e in load(name).encode_batch_fast(texts, add_special_tokens=False)]
