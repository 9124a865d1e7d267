import zlib

import numpy as np
import public_tokenizers as P
import pytest

from invarium.llm import token_store as S
from invarium.llm.shared import scratch_path
from tests.llm.test_tokens import TEXTS


def test_cuts_follow_content():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 49000, 30000)
    a = S.chunk_ends(len(ids), S.cut_points(ids).tolist())
    moved = np.concatenate([rng.integers(0, 49000, 777), ids])
    b = S.chunk_ends(len(moved), S.cut_points(moved).tolist())
    assert len(set(np.array(a) + 777) & set(b)) > len(a) // 2
    sizes = np.diff([0, *a])
    assert sizes.max() <= S.MOST and sizes[:-1].min() >= S.LEAST and sizes.sum() == len(ids)
    assert S.chunk_ends(9000, []) == [4096, 8192, 9000]


def test_joined_crc():
    rng = np.random.default_rng(2)
    ids, shifts = rng.integers(0, 1 << 20, 5000).astype("<u4"), S._shifts()
    ends = [0, 1, 500, 4500, 5000]
    crcs = np.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends, ends[1:])], np.uint32)
    assert S.joined_crc32(crcs, np.diff(ends), np.array([0, 4]), shifts).tolist() == [zlib.crc32(ids.tobytes())]


@pytest.fixture(scope="module")
def store(spark):
    texts = [*TEXTS, *TEXTS, " ".join(f"word{i} thing" for i in range(4000)), "lead " + " ".join(f"word{i} thing" for i in range(4000))]
    rows = [(100 - i, t, 1) for i, t in enumerate(texts)] + [(None, "no id", 2), (100, TEXTS[0], 1)]
    path = scratch_path(spark, "t")
    S.write_store(spark.createDataFrame(rows, "doc_id long, text string, key int"), P.path("word_bpe_49k.json"), 2, path)
    return rows, S.TokenStore(spark, path)


def test_round_trip(spark, store):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    rows, st = store
    want, start = [], 0
    for doc_id, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, st.read_digests().collect()), key=lambda r: r[1]) == want
    full = sorted(st.read_ids().collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.n_tokens, zlib.crc32(np.frombuffer(r.ids, "<u2").astype("<u4").tobytes())) for r in full] == want
    chunks = st.chunks()
    assert chunks.count() == chunks.select("key").distinct().count() < st.recipes().selectExpr("sum(size(hashes))").first()[0]


def test_damage_is_found(spark, store):
    _, st = store
    path = scratch_path(spark, "damaged")
    r = st.recipes()
    st.chunks().selectExpr("0 AS kind", "key", "payload").write.partitionBy("kind").parquet(f"{path}/data")
    r.selectExpr("pack", "seq", "local_start", "doc_id", "n_tokens", "unhex('00') AS root", "hashes", "lens").write.parquet(f"{path}/recipes")
    st.manifest().write.parquet(f"{path}/manifest")
    with pytest.raises(Exception, match="differ"):
        S.TokenStore(spark, path).read_digests().collect()


def test_empty(spark):
    assert S.stored(spark.createDataFrame([], "doc_id long, text string"), P.path("word_bpe_49k.json"), 2).read_digests().count() == 0
