import collections
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from invarium.llm.language_model import LANE, PRIOR2, PRIOR3, score_documents


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(rows, held, prior2=PRIOR2, prior3=PRIOR3):
    """An automaton of dictionaries, read token by token: states are histories, failure arcs drop their first token."""
    count, arcs, starts = collections.Counter(), collections.defaultdict(dict), 0
    for (_, t), h in zip(rows, held):
        if not h:
            seq = ["<s>", *words(t), "</s>"]
            starts += 1
            for i in range(1, len(seq)):
                for n in range(1, min(i + 1, 3) + 1):
                    if n == 1 or i - n + 1 >= 0:
                        count[tuple(seq[i - n + 1 : i + 1])] += 1
    one = {k[0]: c for k, c in count.items() if len(k) == 1}
    total, distinct = sum(one.values()), len(one)
    history = lambda h: starts if h == ("<s>",) else count[h]
    prior = {1: prior2, 2: prior3}

    def p(h, w):
        if not h:
            return (one.get(w, 0) + 1) / (total + distinct + 1)
        return (count[(*h, w)] + prior[len(h)] * p(h[1:], w)) / (history(h) + prior[len(h)])

    for gram in count:
        arcs[gram[:-1]][gram[-1]] = math.log10(p(gram[:-1], gram[-1]))
    out = []
    for (i, t), h in zip(rows, held):
        state, score, base, known = ("<s>",), 0.0, 0.0, 0
        seq = [*words(t), "</s>"]
        for w in seq:
            base += math.log10(p((), w))
            known += w in one
            at = state
            while at and w not in arcs.get(at, {}):
                score += math.log10(prior[len(at)] / (history(at) + prior[len(at)]))
                at = at[1:]
            score += arcs[at][w] if at else math.log10(p((), w))
            state = (*at, w)[-2:]
            while state and not count[state]:
                state = state[1:]
        out.append((i, h, len(seq), known, total, round(base, 6), round(score, 6)))
    return sorted(out, key=repr)


def rounded(df):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in df.collect()), key=repr)


ROWS = [(1, "The cat sat"), (2, "the CAT ran\nfast  É"), (3, None), (4, ""), (5, "the cat sat on the mat"), (5, "the cat sat on the mat"), (None, "cat the"), (6, "unknown words here"), (7, "the cat ran " * LANE + "the dog"), (8, "a b " * 600)]


@pytest.mark.parametrize("out", [set(), {5, 6, 8}, {7}, {1, 2, 3, 4, 5, 6, 7, 8, None}])
def test_like_brute_force(spark, out):
    docs = spark.createDataFrame([(*r, "x", 3) for r in ROWS], "doc_id long, text string, block string, held_out int")
    held = F.coalesce(F.col("doc_id"), F.lit(-1)).isin(*[-1 if x is None else x for x in out]) if out else F.lit(False)
    assert rounded(score_documents(docs, held)) == brute(ROWS, [r[0] in out for r in ROWS])


def test_empty(spark):
    assert score_documents(spark.createDataFrame([], "doc_id long, text string"), F.lit(False)).count() == 0


def test_query(spark):
    from invarium.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = rounded(QUERIES["op7_language_model"](spark, sf))
    want = brute(rows, [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows])
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs(a - b) < 1e-3 for g, w in zip(got, want) for a, b in zip(g[5:], w[5:]))
    held = [g for g in got if g[1]]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bigrams = score_documents(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, prior3=1e15).filter("held_out").agg(F.sum("score")).first()[0]
    assert sum(g[6] for g in held) > bigrams
    assert sum(g[6] for g in held) > sum(g[5] for g in held)  # better than the unigrams on held-out texts
