import re

import numpy as np
import pyarrow as pa
import pytest

from invarium.llm import quality_rules as Q

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    hit = {i + k for starts in windows.values() if len(starts) > 1 for i in starts for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in Q.SYMBOLS for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit), "n_lines": len(lines), "n_distinct": len(set(words)), "n_stops": sum(w[-1] in ".,;:!?\"')" for w in words),
        "n_symbol_words": sum(w[-1] in Q.SYMBOLS for w in words), "n_exclaims": sum(w[-1] == "!" for w in words),
        "n_other": sum("!" <= c <= "~" and not c.isalnum() for c in text), "n_caps": sum("A" <= c <= "Z" for c in text),
    }


def texts():
    rng = np.random.default_rng(3)
    out = [None, "", " \t\n", "a", "a\n\na\n a\na", "é ß#* <b> 日本 x y", "x " * 40, "one two three four five six seven eight nine " * 3, "\x0b\x0c\r", "|a|\x1cb"]
    for _ in range(200):
        out.append("".join(rng.choice(["a ", "b ", "c\n", "dé ", "#", "e\t", "."], int(rng.integers(0, 120)))))
    return out


def test_measures_like_brute_force():
    all_texts = texts()
    found = Q.measure_texts(pa.array(all_texts))
    for i, t in enumerate(all_texts):
        assert {k: int(v[i]) for k, v in found.items()} == brute(t), repr(t)


def test_em_recovers_accuracies():
    rng = np.random.default_rng(0)
    n, n_rules = 20000, 5
    good = rng.random(n) < 0.8
    votes = np.where(good[:, None], rng.choice(3, (n, n_rules), p=[0.04, 0.2, 0.76]), rng.choice(3, (n, n_rules), p=[0.6, 0.2, 0.2]))
    codes, counts = np.unique((votes * 3 ** np.arange(n_rules)).sum(1), return_counts=True)
    model = Q.fit_votes(list(zip(codes.tolist(), counts.tolist())), n_rules)
    assert abs(model.prior - 0.8) < 0.05
    score = np.log(model.prior / (1 - model.prior)) + sum(np.array(model.weights[k])[votes[:, k]] for k in range(n_rules))
    assert ((score > 0) == good).mean() > 0.95


def test_query_agrees_with_brute_force_and_labels(spark):
    from invarium.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in QUERIES["op5_quality_rules"](spark, sf).collect()}
    assert rows.keys() == docs.keys()
    for i, t in docs.items():
        b, r = brute(t), rows[i]
        assert all(r[k] == b[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert r.base_failed == (b["n_words"] < 20 or 100 * b["n_repeat_words"] > 30 * b["n_words"])
        assert not (r.base_failed and r.kept)
    labels = [(r.quality, rows[r.doc_id].kept) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    good = [k for q, k in labels if q == 1]
    bad = [k for q, k in labels if q == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.3


@pytest.mark.parametrize("rows", [[], [(None, None, 1), (1, "", 2), (2, "word " * 5, 3)]])
def test_edges(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    assert Q.quality_filter(docs).collect() == []
    assert Q.judged(Q.measured(docs, ["doc_id"]), Q.fit_votes([])).count() == len(rows)


def test_filter_keeps_columns(spark):
    text = " ".join(f"word{i} thing." for i in range(60))
    docs = spark.createDataFrame([(1, text, None, 7), (1, text, None, 7)], "doc_id long, text string, __x string, n_words int")
    assert [tuple(r) for r in Q.quality_filter(docs).collect()] == [(1, text, None, 7)] * 2
