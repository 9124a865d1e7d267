import numpy as np
from pyspark.sql import functions as F

from invarium.llm.hilbert import hilbert_index
from invarium.llm.neighbours import best_pairs, nearest


def brute(ids, x, queries, k):
    x = np.asarray(x, float)
    out = {}
    for q in queries:
        at = ids.index(q)
        s = (x * x[at]).sum(axis=1)
        out[q] = sorted(((-s[i], ids[i]) for i in range(len(ids)) if ids[i] != q))[:k]
    return out


def test_curve_visits_neighbours():
    grid = np.array([(i, j, k) for i in range(8) for j in range(8) for k in range(8)])
    index = hilbert_index(grid, 3)
    assert sorted(index.tolist()) == list(range(512))
    assert np.abs(np.diff(grid[np.argsort(index)], axis=0)).sum(axis=1).max() == 1


def test_best_pairs_ties():
    who, names, scores = best_pairs(np.array([[1.0, 0]]), np.array([[1.0, 5], [1, 6], [2, 0], [0, 1]]), [[9], [4, 7], [8], [1]], 3)
    assert names.tolist() == [8, 4, 7] and scores.tolist() == [2, 1, 1] and who.tolist() == [0, 0, 0]


def test_recall_and_scores(spark):
    from invarium.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows])
    want = brute(ids, x, [i for i in ids if i % 20 == 0], 20)
    got = QUERIES["op3_neighbours"](spark, sf).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert found.keys() == want.keys()
    hit = 0
    for q, own in found.items():
        own.sort()
        assert [r[0] for r in own] == list(range(1, 21))
        assert [(-s, v) for _, v, s in own] == sorted((-s, v) for _, v, s in own)
        for _, v, s in own:
            assert abs(s - float((x[ids.index(q)].astype(float) * x[ids.index(v)].astype(float)).sum())) < 1e-12
        hit += len({v for _, v, _ in own} & {v for _, v in want[q]})
    assert hit / (20 * len(want)) >= 0.9


def test_copies_and_bad_rows(spark):
    rows = [(i, [1.0, 0.0]) for i in range(1, 60)] + [(100, [0.5, -0.0]), (120, [0.5, 0.0]), (140, None), (160, [0.0, 0.0]), (180, [float("nan"), 1.0]), (200, [None, 1.0]), (220, [float("inf"), 1.0]), (None, [1.0, 0.0]), (240, [1.0, 2.0, 3.0]), (20, [1.0, 0.0])]
    got = nearest(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rep int").repartition(4), F.col("vec_id") % 20 == 0, k=5).collect()
    found = {}
    for r in sorted(got, key=lambda r: r.rank):
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert found == {20: [1, 2, 3, 4, 5], 40: [1, 2, 3, 4, 5], 100: [1, 2, 3, 4, 5], 120: [1, 2, 3, 4, 5]}


def test_empty(spark):
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0
    assert nearest(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0
