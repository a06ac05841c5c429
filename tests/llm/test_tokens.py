"""Token counts, token files and packing against the library on whole texts."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm.token_counts import count_tokens
from tidemark.llm.tokens import encode_ids

HARD = [None, "", " ", "  ", "\n", "a", " a", "a ", "don't we'll 've", "x  y   z", "tab\tx\n\n y", " lead", "end  ",
        "é ü ñ ß 漢字 かな 😀😀   nb  em", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>c", "<|endoftext|",
        "word,word. Word!! ### a*** b&&& c|d", "١٢٣ 12345 1.5", "a" * 3000, "ab'" * 900, " " * 2500 + "x",
        "\x1c a \x1f\x85 b", ("lorem ipsum, " * 700).strip(), "x" * 700 + " " + "y z " * 500, "'s 't 're" * 300,
        ("foo " * 60 + "<|endoftext|> " + "bar's ") * 20, "\r\n" * 900, "the end.", "the end."]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_word_encoder_matches_library(library):
    import numpy as np

    texts = [x or "" for x in HARD]
    for _ in range(2):
        got = encode_ids("byte_bpe_50k.json", texts)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library(x) for x in texts]


def test_columns_match_library_and_send_each_piece_once(library):
    import random

    import numpy as np
    import pyarrow as pa

    from tidemark.llm.tokens import BYTE_BPE, PieceEncoder, encode_column

    marks = ["a", "Zé", " ", "  ", "\n", "\t", "\x1c", "\u3000", "\xa0", "\u2009", "”", ",", "|", "<", "'s", "'", "9", "漢", "<|endoftext|>", "\r\n", "\x85", "»"]
    r = random.Random(3)
    texts = [x or "" for x in HARD] + ["".join(r.choices(marks, k=r.randrange(1, 30))) for _ in range(20_000)]
    ids, n = encode_column(BYTE_BPE, pa.array(["left out", *texts]).slice(1))
    want = [library(x) for x in texts]
    assert n.tolist() == list(map(len, want))
    assert ids.tolist() == [i for w in want for i in w]
    assert encode_column(BYTE_BPE, pa.array([], pa.string()))[1].tolist() == []

    # words with marks and at line starts are the word again: the library and the memory see it once
    encoder, asked = PieceEncoder(BYTE_BPE), []
    split, one = encoder.split, encoder._one
    encoder.split = lambda x: asked.append(x) or split(x)
    encoder._one = lambda x: asked.append(x) or one(x)
    text = "\n".join(["word", "and word, and word.", "word! and word", "word: and word;"])
    for _ in range(2):
        ids, n = encoder.encode_column(pa.array([text, text]))
        assert ids.tolist() == library(text) * 2 and n.tolist() == [len(library(text))] * 2
    assert sorted(asked) == sorted(["word", "and", "Ġand", "Ġword", ",", ".", "!", ":", ";", "\n"])
    encoder.known = 3
    for _ in range(3):
        ids, _ = encoder.encode_column(pa.array([text]))
        assert ids.tolist() == library(text) and len(encoder) <= 10


@pytest.mark.parametrize("chunk,overlap", [(200, 64), (1000, 100), (16_384, 512)])
def test_counts_of_hard_texts(spark, library, chunk, overlap):
    rows = [(i if i else None, t, 7) for i, t in enumerate(HARD)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in count_tokens(df, chunk_chars=chunk, overlap_chars=overlap).collect()}
    assert len(got) == len(HARD)
    for i, t, _ in rows:
        n = len(library(t))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 1024), t


def test_counts_of_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = {r.doc_id: len(library(r.text)) for r in docs.collect()}
    got = {r.doc_id: r.n_tokens for r in count_tokens(docs, chunk_chars=900, overlap_chars=96).collect()}
    assert got == want
    assert count_tokens(docs.limit(0)).count() == 0


def test_pieces_file(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    df = spark.createDataFrame([(1, "some text here"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in count_tokens(df, "piece_bpe_32k.model").collect()}
    assert got == {1: len(sp.encode("some text here")), 2: 0}


def test_simple8b_round_trip():
    import numpy as np

    from tidemark.llm.token_files import BLOCK, decode_blocks, encode_blocks

    r = np.random.default_rng(5)
    wide = r.integers(0, 2**64, 9000, np.uint64) >> r.integers(0, 64, 9000).astype(np.uint64)
    for ids in (np.zeros(0, np.uint32), np.zeros(5000, np.uint32), np.arange(BLOCK), r.integers(0, 50257, 3 * BLOCK + 7),
                wide, np.full(300, 2**64 - 1, np.uint64), np.repeat(wide[:99], 120)):
        blocks = encode_blocks(ids)
        assert sum(n for n, _, _ in blocks) == len(ids)
        assert decode_blocks(blocks).tolist() == ids.tolist()


def expected_index(rows, library):
    import zlib

    import numpy as np

    at, out = 0, []
    for i, t in rows:
        ids = np.array(library(t) + [2], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_token_files(spark, library, tmp_path):
    from tidemark.llm.token_files import read_token_files, token_index, write_token_files

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    write_token_files(docs, f"{tmp_path}/a", file_bytes=100_000)
    got = sorted(tuple(r) for r in token_index(spark, f"{tmp_path}/a").collect())
    assert got == expected_index(sorted((r.doc_id, r.text) for r in docs.collect()), library)

    rows = [(i, t) for i, t in enumerate(HARD)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows[::-1]] + [(None, "nobody", "y")],
                               "doc_id long, text string, ids string")
    write_token_files(df, f"{tmp_path}/b")
    got = sorted((tuple(r) for r in token_index(spark, f"{tmp_path}/b").collect()), key=lambda r: r[1])
    assert got == expected_index([(None, "nobody")] + rows, library)
    ids = {r.doc_id: r.ids for r in read_token_files(spark, f"{tmp_path}/b", with_ids=True).collect()}
    assert all(ids[i] == library(t) + [2] for i, t in rows)
    write_token_files(df.limit(0), f"{tmp_path}/c")
    assert token_index(spark, f"{tmp_path}/c").count() == 0


def test_fill_is_the_best_subset():
    import itertools
    import random

    from tidemark.llm.packing import fill

    r = random.Random(3)
    for _ in range(200):
        pieces = [r.randint(1, 40) for _ in range(r.randint(0, 9))]
        room = r.randint(1, 90)
        lengths = {n: pieces.count(n) for n in set(pieces)}
        best = max(s for k in range(len(pieces) + 1) for c in itertools.combinations(pieces, k)
                   if (s := sum(c)) <= room)
        got = fill(sorted(lengths), lengths.get, room)
        assert sum(n * k for n, k in got.items()) == best
        assert all(k <= lengths[n] for n, k in got.items())


def test_packing(spark, library):
    import zlib

    import numpy as np

    from tidemark.llm.packing import pack

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    hard = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(HARD)] + [(None, "nobody")],
                                 "doc_id long, text string")
    df = docs.union(hard)
    for capacity in (64, 2048):
        pieces = pack(df, capacity).collect()
        want = {r.doc_id: np.array(library(r.text) + [1], "<u4") for r in df.collect()}
        by_doc, by_seq = {}, {}
        for p in pieces:
            by_doc.setdefault(p.doc_id, []).append(p)
            by_seq.setdefault(p.sequence_id, []).append(p)
        assert set(by_doc) == set(want)
        for doc, own in by_doc.items():
            at = 0
            for p in sorted(own, key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(want[doc])
                assert p.ids_crc32 == zlib.crc32(want[doc][at:at + p.length].tobytes())
                at += p.length
            assert at == len(want[doc])
        for own in by_seq.values():
            at = 0
            for p in sorted(own, key=lambda p: p.offset):
                assert p.offset == at
                at += p.length
            assert at == own[0].sequence_tokens and (at == capacity or at < capacity and at & at - 1 == 0)
    assert pack(df.limit(0)).count() == 0
    same = spark.createDataFrame([(1, "word " * 1499)] * 40, "doc_id long, text string")
    assert sum(p.length for p in pack(same).collect()) == 40 * (len(library("word " * 1499)) + 1)
