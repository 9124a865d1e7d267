import random
import re

import numpy as np
import pyarrow as pa
import pytest

from invarium.llm import jaccard as J
from invarium.llm import simhash as S
from tests.llm.test_simhash import roots


def brute_set(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def made(seed=1):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    texts = ["", None, "one two", "One  two", "a b c d e", " \n"]
    for _ in range(25):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(30, 300))]
        if rng.random() < 0.5:  # a quoted passage, which makes nothing alike by itself
            base[10:10] = passage
        texts += [" ".join(edited(rng, base, rng.randint(0, len(base) // 50))) for _ in range(4)]
    return texts


def test_sets_like_brute_force():
    texts = [*made(), "w " * 300, "日本 語 テ ス ト"]
    hashes, offsets = J.sets_of(pa.array(texts), 5)
    sets = [set(hashes[a:b].tolist()) for a, b in zip(offsets, offsets[1:])]
    want = [brute_set(t) for t in texts]
    assert [len(s) for s in sets] == [len(s) for s in want]
    for i in range(0, len(texts), 3):
        for j in range(i):
            assert len(sets[i] & sets[j]) == len(want[i] & want[j])


def test_bands_bring_pairs_together():
    assert J.n_bands(0.8) == 23 and J.n_bands(1.0) == 1
    rng = np.random.default_rng(1)
    share = []
    for _ in range(200):
        both, a, b = (np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64)) for n in (80, 10, 10))
        sets = np.concatenate([both, a, both, b])
        keys = J.band_keys(sets, np.array([0, 90, 180]), 23)
        share.append((keys[0] == keys[1]).mean())
    assert min(share) > 0 and abs(np.mean(share) - 0.8**3) < 0.03


@pytest.mark.parametrize("chunk_rows,unit_size", [(J.CHUNK_ROWS, J.UNIT_SIZE), (3, 400)])
def test_near_dedup_like_brute_force(spark, monkeypatch, chunk_rows, unit_size):
    monkeypatch.setattr(J.jaccard_links, "__defaults__", (chunk_rows, unit_size))
    texts = made()
    sets = [brute_set(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if similarity(sets[i], sets[j]) >= 0.8]
    prints = S.fingerprints_of(pa.array(texts), 3, 42)
    far = [p for p in pairs if np.bitwise_count(prints[p[0]] ^ prints[p[1]]) > 2]
    assert len(far) > 10  # out of reach of op8's radius
    want = roots(len(texts), pairs)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in S.dedup_near(docs, shingle=5, least=0.8).collect()) == sorted(set(want))


def test_stage_settings(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(104)]  # 100 shingles; an inner word stands in five
    near, far = list(words), list(words)
    near[20] = near[60] = "x"  # 90 of 110
    far[20] = far[50] = far[80] = "y"  # 85 of 115
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate([words, near, far])], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()) == [0, 2]


def test_clashing_columns(spark):
    rows = [(i, "a b c d e f g h", f"g{i}", f"f{i}", i) for i in range(3)] + [(9, "other words stand here", "x", "y", 0)]
    docs = spark.createDataFrame(rows, "`my id` long, `my text` string, __gone string, gone string, fingerprint int")
    out = S.dedup_near(docs, key="my id", text="my text")
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == [rows[0], rows[3]]
    texts = spark.createDataFrame([("b", "a b c d e f g h"), ("a", "a b c d e f g h"), (None, "a b c d e f g h")], "doc_id string, text string")
    assert sorted((r.doc_id or "") for r in S.dedup_near(texts).collect()) == ["", "a"]
