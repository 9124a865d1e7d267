import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from invarium.llm import bit_slices as B
from invarium.llm import simhash as S
from invarium.llm.components import components


def brute_print(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, pairs):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def close_pairs(values):
    x = np.array(values, np.uint64)
    d = np.bitwise_count(x[:, None] ^ x[None, :])
    return list(zip(*np.nonzero(np.triu(d <= 2, 1))))


TEXTS = [None, "", " \t", "one", "One two", "a b c", "A  b\nc", "a b c d é Ü ß", "x\x1cy z w", "日本 語 テ ス ト", "w " * 300, " ".join(f"w{i}" for i in range(5000))]


def test_fingerprints_like_brute_force():
    assert S.fingerprints_of(pa.array(TEXTS), 3, 42).tolist() == [brute_print(t) for t in TEXTS]


def clusters(n, spread, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, max(1, n // 20)).astype(np.uint64)
    out = set()
    while len(out) < n:
        v = int(rng.choice(centres))
        for _ in range(int(rng.integers(0, spread))):
            v ^= 1 << int(rng.integers(0, 64))
        out.add(v)
    return np.array(sorted(out), np.uint64)


@pytest.mark.parametrize("n,spread", [(1, 1), (2, 2), (63, 4), (64, 3), (65, 3), (700, 4)])
def test_bit_sliced_pairs(n, spread):
    values = clusters(n, spread)[:n]
    a, b = B.pairs_large(values, 2)
    assert sorted(map(tuple, np.sort(np.stack([a, b], 1), 1))) == close_pairs(values)
    bucket = np.sort(np.random.default_rng(1).integers(0, max(1, n // 7), n))
    bucket = np.unique(bucket, return_inverse=True)[1]
    a, b = B.pairs_small(values, bucket, 2)
    want = [(i, j) for i, j in close_pairs(values) if bucket[i] == bucket[j]]
    assert sorted(map(tuple, np.sort(np.stack([a, b], 1), 1))) == want


@pytest.mark.parametrize("radius", [0, 1, 5, 26, 63, 64])
def test_any_radius(radius):
    rng = np.random.default_rng(radius)
    values = rng.integers(0, 1 << 63, 150).astype(np.uint64) & np.uint64((1 << rng.integers(3, 62)) - 1)
    distance = np.bitwise_count(values[:, None] ^ values[None, :])
    near = B.unpacked(B.block_near(values, B.planes_of(values), radius))[:, : len(values)]
    assert (near == (distance <= radius)).all()
    sizes, none = np.full(len(values), 9), np.zeros(len(values), bool)
    label = B.clustered(values, sizes, none, radius, 0.8)
    want = roots(len(values), list(zip(*np.nonzero(np.triu(distance <= radius, 1)))))
    assert len(set(zip(label.tolist(), want))) == len(set(want)) == len(set(label.tolist()))


@pytest.mark.parametrize("limit", [S.BUCKET_LIMIT, 5])
def test_components_like_brute_force(spark, limit):
    values = clusters(400, 4, 7)
    distinct = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fingerprint long")
    want = roots(len(values), close_pairs(values))
    at = {int(v): i for i, v in enumerate(values.view(np.int64))}
    pairs = [(at[r.a], at[r.b]) for r in S.near_links(distinct, limit).collect()]
    assert roots(len(values), pairs) == want


def test_label_propagation(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_like_brute_force(spark):
    from invarium.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    prints = [brute_print(t) for _, t in docs]
    want = roots(len(docs), close_pairs(prints))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op8_simhash"](spark, sf).collect()}
    assert got == {d: (f"{p:016x}", docs[w][0]) for (d, _), p, w in zip(docs, prints, want)}


def test_edges(spark):
    rows = [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (4, "A b c d"), (None, "alone here now"), (9, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", S.F.lit("x"))
    found = sorted((r.doc_id or -1, r.component_id or -1) for r in S.near_duplicates(S.fingerprint(docs)).collect())
    assert found == [(-1, -1), (-1, 4), (4, 4), (5, 4), (5, 4), (8, 8), (9, 8)]
    assert sorted((r.doc_id or -1) for r in S.dedup_near(docs).collect()) == [-1, -1, 4, 8]
    assert S.near_duplicates(S.fingerprint(docs.limit(0))).count() == 0
