import random
import re

import corpus_pipeline
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_near_dedup import brute_set, similarity
from tests.llm.test_simhash import roots

NAMES = "doc_id long, text string, lang string, n_chars long, `__lines` string, gone int, `a.b` string, block string, fingerprint long"


def prose(rng, n):
    out = []
    while len(out) < n:
        out += [f"word{rng.randrange(4000)}" for _ in range(rng.randint(4, 9))] + ["the", "of", "and"]
        out[-1] += "."
    return " ".join(out)


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows, clashing names."""
    rng = random.Random(11)
    base, passage = prose(rng, 120), prose(rng, 60)
    words = base.split()
    words[50] = "edited"
    texts = [None, "", " \n\t", "x", base, base, " ".join(words), prose(rng, 90) + " " + passage + " " + prose(rng, 20), prose(rng, 40) + "\n" + passage, prose(rng, 30_000), "same line\n" + prose(rng, 60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, base), (100, base), (None, base), (None, None)] + [(200 + i, f"Boiler plate\n{prose(rng, 60)}\nboiler plate") for i in range(12)]
    rows = [(i, t, None if k % 3 else "en", len(t) if t else None, "own", 1, None, "b", None) for k, (i, t) in enumerate(rows)]
    return rows, spark.createDataFrame(rows, NAMES).repartition(3)


def test_stages_keep_columns_of_odd_documents(spark):
    rows, docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        got = out.collect()
        assert {r[0] for r in got} <= {r[0] for r in rows} and all((r["__lines"], r.gone, r["a.b"], r.block, r.fingerprint) == ("own", 1, None, "b", None) for r in got)
    pieces = corpus_pipeline.packing(spark, docs, "").collect()
    assert {r.doc_id for r in pieces} == {r[0] for r in rows} and all(r.length == r.length & -r.length for r in pieces)


def test_quality_rules_of_odd_documents(spark):
    rows, docs = odd_documents(spark)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.quality_rules(spark, docs, "").collect()]
    words = lambda t: re.findall("[^\x20\x09-\x0d]+", t or "")
    assert all(len(words(t)) >= 20 for _, t in got)
    assert sorted(map(repr, got)) == sorted(repr(r[:2]) for r in rows if len(words(r[1])) >= 20)  # these are all clean


def test_line_dedup_of_odd_documents(spark):
    rows, docs = odd_documents(spark)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.line_dedup(spark, docs, "").collect()]
    assert sorted(map(repr, got)) == sorted(repr((i, t)) for i, _, _, t in brute_lines([r[:2] for r in rows], 10, 1))


def test_near_dedup_of_odd_documents(spark):
    rows, docs = odd_documents(spark)
    sets = [brute_set(r[1]) for r in rows]
    label = roots(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if similarity(sets[a], sets[b]) >= 0.8])
    first = {}
    for (i, *_), group in zip(rows, label):
        first[group] = min(x for x in (first.get(group), i) if x is not None) if i is not None or group in first else None
    gone = {i for (i, *_), group in zip(rows, label) if i is not None and first[group] is not None and first[group] < i}
    got = sorted(repr(r.doc_id) for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect())
    assert got == sorted(repr(r[0]) for r in rows if r[0] not in gone)


def test_substring_dedup_of_odd_documents(spark):
    rows, docs = odd_documents(spark)
    got = corpus_pipeline.substring_dedup(spark, docs, "").collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    seen = {}
    for r in sorted(got, key=lambda r: (r.doc_id is None, r.doc_id)):
        own = r.text.lower().split()
        for k in range(len(own) - 50):
            assert seen.setdefault(tuple(own[k : k + 51]), (r.doc_id, r.text)) == (r.doc_id, r.text)
    kept = {r.doc_id: r.text for r in got}
    assert kept[4] == rows[4][1] and kept[9] == rows[9][1] and kept[100] == ""


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id: r.text for r in docs.collect()}
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = corpus_pipeline.staged(stage(spark, seen, sf), name)
        assert seen.columns == docs.columns
        rows = {r.doc_id: r.text for r in seen.collect()}
        assert 0 < len(rows) <= len(kept) and set(rows) <= set(kept)
        assert all(r.n_chars == len(r.text) for r in seen.collect()) or name in ("quality_rules", "simhash_near_dedup")
        kept = rows
    pieces = corpus_pipeline.packing(spark, seen, sf).collect()
    assert {r.doc_id for r in pieces} == set(kept)
    assert corpus_pipeline.run(spark, sf).count() == len(pieces)


def test_empty(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs_out = stage(spark, docs, "")
        assert docs_out.count() == 0
