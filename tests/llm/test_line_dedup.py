import collections
import re

import numpy as np
import pyarrow as pa
import pytest

from invarium.llm import bloom
from invarium.llm.line_dedup import dedup_lines, line_keys

STRIP = " \t\n\x0b\x0c\r"


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def brute(rows, min_docs, least):
    found = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            found[lower(x.strip(STRIP))].add(("no key", t) if i is None else i)  # rows that share a key are one document
    seen = {k: len(v) for k, v in found.items()}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(k := lower(x.strip(STRIP))) >= least and seen[k] >= min_docs)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def rows():
    rng = np.random.default_rng(5)
    pool = ["Hot Line", " hot line\t", "é", "x", "", "ÉCOLE", "école", "a\rb", "long " * 30, "日本", "  "] + [f"line {i}" for i in range(60)]
    out = [(i, "\n".join(rng.choice(pool, int(rng.integers(0, 9))))) for i in range(150)]
    return out + [(None, "hot line\nx"), (None, None), (7, out[7][1]), (7, out[7][1]), (500, ""), (501, "\n\n"), (502, "hot line")] + [(600, "twelve times")] * 12 + [(None, f"unnamed\n{i}") for i in range(10)]


@pytest.mark.parametrize("min_docs,least", [(3, 1), (10, 1), (4, 5)])
def test_like_brute_force(spark, min_docs, least):
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows()], "doc_id long, text string, lines string").repartition(5)
    got = [(r.doc_id, r["__n_lines"], r["__n_dropped"], r.text) for r in dedup_lines(docs, min_docs, least, log2_bits=18).collect()]
    assert sorted(got, key=repr) == brute(rows(), min_docs, least)


def test_keep_first(spark):
    docs = spark.createDataFrame([(10, "a\nb\na"), (9, "a\nc"), (11, "A")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in dedup_lines(docs, 2, keep_first=True, log2_bits=18).collect()}
    assert got == {9: "a\nc", 10: "b", 11: ""}


def test_clashing_columns(spark):
    names = ["__drop", "__lines", "__n_dropped", "__N_lines", "__row_key", "__key", "__text", "row", "lines", "drop", "c0", "a.b"]
    rows = [(i, f"x\nown {i}", *[f"{n} {i}" for n in names]) for i in range(3)]
    docs = spark.createDataFrame(rows, "`the id` long, `the text` string, " + ", ".join(f"`{n}` string" for n in names))
    out = dedup_lines(docs, 3, key="the id", text="the text", log2_bits=18)
    assert out.columns == [*docs.columns, "___n_lines", "___n_dropped"]
    assert sorted(map(tuple, out.collect())) == [(r[0], f"own {r[0]}", *r[2:], 2, 1) for r in rows]


def test_long_text(spark):
    docs = spark.createDataFrame([(i, "\n".join(["x", *(f"{i} {k}" for k in range(30_000)), "x"])) for i in range(3)], "doc_id long, text string")
    got = [(r["__n_lines"], r["__n_dropped"], r.text.count("\n")) for r in dedup_lines(docs, 3, log2_bits=20).collect()]
    assert got == [(30_002, 2, 29_999)] * 3


def test_empty(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string"), log2_bits=18).count() == 0


def test_filters_merge():
    a, b = bloom.partial(np.array([1, 1, 5, 1 << 17])), bloom.partial(np.array([5, 9]))
    assert a.column("piece").to_pylist() == [0, 1] and np.frombuffer(a.column("twice")[0].as_py(), np.uint32).tolist() == [1]
    assert np.frombuffer(b.column("once")[0].as_py(), np.uint32).tolist() == [5, 9]


def test_line_keys():
    t, n, k = line_keys(pa.array(["a\n B \n\n\x0bc", None, "", "É"]), 1)
    assert t.tolist() == [0, 0, 0, 3] and n.tolist() == [0, 1, 3, 0] and [x.as_py().decode() for x in k] == ["a", "b", "c", "É"]
