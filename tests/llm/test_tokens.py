import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from invarium.llm.byte_bpe import bpe_decode, bpe_encode
from invarium.llm.packing import decompose, pack_documents

TEXTS = [
    "Hello  world, it's  2024!\n\n  x\ty  z　 q   r", "", None, " ", "  lead", "trail  ", "é è ß ß́ é a ́b", "don't they'll 's 'll",
    "a" * 70000 + " " * 70000 + "b\n" * 500, "<|endoftext|> <|startoftext|>", "\x1c \x1d a \x1f b\x85 c", "ΣΑΣ ΣΑΣ. ΟΔΟΣ ", "日本語 テスト　全角 한국어", "tab\t\t tab \r\n crlf \x0b\x0c v",
]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")


@pytest.fixture(scope="module")
def byte_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_encode_decode_like_library(spark):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = bpe_decode(bpe_encode(docs(spark, TEXTS), path, P.PATTERN), path).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        text = TEXTS[r.doc_id] or ""
        assert list(r.ids) == library.encode_ordinary(text), r.doc_id
        assert bytes(r.decoded) == text.encode()


def test_packing_round_trip(spark, byte_tokenizer):
    rows = pack_documents(docs(spark, TEXTS * 2), P.path("byte_bpe_50k.json"), end_id=0).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    for i, text in enumerate(TEXTS * 2):
        want = [*byte_tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [x for r in own for x in np.frombuffer(r.ids, "<u4")] == want
        assert all(r.length in {1 << k for k in range(11)} and r.length == len(r.ids) // 4 and r.doc_tokens == len(want) and r.offset == 0 and r.sequence_id >> 58 == int(r.length).bit_length() - 1 for r in own)
        assert [r.start for r in own] == list(np.cumsum([0] + [r.length for r in own[:-1]]))


def test_decompose():
    pieces, exponents = decompose(np.array([1, 1024, 2051, 7]), 10)
    assert pieces.tolist() == [1, 1, 4, 3] and exponents.tolist() == [0, 10, 10, 10, 1, 0, 2, 1, 0]


def test_empty_and_null_tables(spark):
    empty = docs(spark, []).select("doc_id", "text")
    assert pack_documents(empty, P.path("byte_bpe_50k.json"), 0).count() == 0
    assert bpe_encode(empty, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0
    null = spark.createDataFrame([(None, None), (None, None)], "doc_id long, text string")
    rows = pack_documents(null, P.path("byte_bpe_50k.json"), 0).collect()
    assert [(r.doc_id, r.length) for r in rows] == [(None, 1)] * 2


def test_queries_digests(spark):
    from invarium.llm.queries import QUERIES

    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: r for r in QUERIES["op2_byte_bpe"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(d)
    for r in d:
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert zlib.crc32(np.array([0], "<u4").tobytes()) == 558161692
