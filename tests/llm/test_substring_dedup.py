import random

import numpy as np
import pyarrow as pa

from invarium.llm import substring_dedup as S
from invarium.llm.jaccard import _linked
from invarium.llm.substring_dedup import bands_for, dedup_substrings, without


def prose(rng, n, ends=True):
    out = []
    while len(out) < n:
        k = rng.randint(5, 14)
        out += [f"w{rng.randint(0, 10**6)}" for _ in range(k)]
        if ends:
            out[-1] += "."
    return " ".join(out)


def test_paragraphs_cover_the_text():
    rng = random.Random(1)
    texts = [prose(rng, 200).replace(". ", ".\n", 3), None, "", "one two.", "a b c d e. f g h i j! k", prose(rng, 300, ends=False), "\n\n x \n y"]
    p = S.Paragraphs(pa.array(texts))
    assert p.lo.tolist() == [0, *p.hi[:-1].tolist()] and p.hi[-1] == len(p.words)
    for i, t in enumerate(texts):
        own = range(p.begin[i], p.begin[i + 1])
        assert sum(int(p.n_words[k]) for k in own) == len((t or "").split())
        assert [int(p.number[k]) for k in own] == list(range(len(own)))
    alone = S.Paragraphs(pa.array([texts[0]]))
    assert alone.whole.tolist() == p.whole[p.begin[0] : p.begin[1]].tolist()


def test_similar_pairs_keep_components():
    rng = np.random.default_rng(0)
    sets = []
    for _ in range(30):
        base = rng.integers(0, 1 << 60, 40).astype(np.uint64)
        for _ in range(int(rng.integers(1, 5))):
            own = base.copy()
            own[rng.integers(0, 40, int(rng.integers(0, 8)))] = rng.integers(0, 1 << 60)
            sets.append(np.unique(own))

    def parts(pairs):
        root = list(range(len(sets)))
        for a, b in pairs:
            old, new = sorted((root[a], root[b]), reverse=True)
            root = [new if r == old else r for r in root]
        return root

    every = [(i, j) for i in range(len(sets)) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) - 1e-9]
    found = _linked(list(range(len(sets))), list(range(len(sets))), sets, 0.8)
    assert parts(found) == parts(every)
    assert len(found) == len(sets) - len(set(parts(every)))  # a forest
    assert _linked(list(range(len(sets))), parts(every), sets, 0.8) == []


def test_cuts():
    assert without(b"a b c d\ne f\ng", [(2, 5)]) == b"a d\ne f\ng"
    assert without(b"a b\nc d\ne", [(2, 7)]) == b"a\ne"
    assert without(b"a b\n\ne", [(0, 3)]) == b"\ne"


def windows(text, n):
    words = text.lower().split()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def test_passages_go_whole(spark):
    """Passages of 51 words quoted inside texts, in sentences, bare, in lines of four words and with other line breaks."""
    rng = random.Random(5)
    rows, want = [], {}
    for case in range(40):
        passage = prose(rng, 51, ends=case % 2 == 0).split()[:51]
        for copy in range(3):
            own = [" ".join(passage), "\n".join(" ".join(passage[i : i + 4]) for i in range(0, 51, 4)), "\n\n".join(" ".join(passage[i : i + 9]) for i in range(0, 51, 9))][(case + copy) % 3]
            key = 1000 * copy + case
            rows.append((key, f"{prose(rng, 40, ends=case % 3 == 0)} start{key} {own} stop{key} {prose(rng, 25)}"))
            want[key] = 51 if copy else 0
    clean = [(9000 + i, prose(rng, rng.randint(1, 200))) for i in range(60)]
    docs = spark.createDataFrame(rows + clean, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in dedup_substrings(docs, block_bytes=2000).collect()}
    removed = {k: got[k]["__n_removed_words"] for k in want}
    assert removed == want
    assert all(got[k].text == t and got[k]["__n_removed_words"] == 0 for k, t in clean)
    seen, left = {}, 0
    for r in got.values():
        for w in windows(r.text, 51):
            left += seen.setdefault(w, r.doc_id) != r.doc_id
    assert left == 0 or sum(removed[k] != want[k] for k in want)


def test_passages(spark):
    rng = random.Random(2)
    passage = prose(rng, 70)
    words = passage.split()
    edited = " ".join(w if k != 30 else "edited" for k, w in enumerate(words))
    short = prose(rng, 14)
    rows = [(10, prose(rng, 50) + " and then " + passage + " " + prose(rng, 50)), (4, prose(rng, 30) + "\n" + passage), (12, "cut " + passage + "\n" + prose(rng, 30)), (13, "b c\n" + edited)]
    rows += [(30, prose(rng, 40) + "\n" + short), (31, short + "\n" + prose(rng, 40))]
    clean = [(100 + i, prose(rng, rng.randint(1, 120))) for i in range(40)]
    again = " ".join(words * 3)
    rows += clean + [(None, passage), (200, None), (201, ""), (4, rows[1][1]), (300, "w " * 20000), (301, "w " * 20000), (302, again)]
    docs = spark.createDataFrame([(i, t, "x", 3, 4) for i, t in rows], "doc_id long, text string, block string, n_removed int, `__Spans` int").repartition(3)
    out = dedup_substrings(docs)
    assert out.columns == [*docs.columns, "__n_removed_words", "___spans"]
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    assert all(r.text == rows[1][1] for r in got[4]) and len(got[4]) == 2
    for i in (10, 12, None):
        assert got[i][0]["__n_removed_words"] == len(words) and got[i][0]["___spans"]
    assert got[13][0].text == "b c"  # the edited word does not part the run
    assert got[None][0].text == ""
    assert got[302][0].text == ""
    assert set(got[300][0].text.split()) == {"w"} and got[301][0].text == ""  # repeats within a document go as well
    for i, t in clean + [rows[4], rows[5]]:
        assert got[i][0].text == t and got[i][0]["__n_removed_words"] == 0
    assert got[200][0].text == got[201][0].text == ""
    r = got[10][0]
    assert rows[0][1].encode()[r["___spans"][0] : r["___spans"][1]].decode() == passage
    assert (r.block, r.n_removed, r["__Spans"]) == ("x", 3, 4)


def test_text_keys(spark):
    rng = random.Random(4)
    passage = prose(rng, 60)
    rows = [("a", passage + " " + prose(rng, 10)), ("b", prose(rng, 10) + " " + passage), (None, passage), ("c", "x")]
    got = {r["k.y"]: r for r in dedup_substrings(spark.createDataFrame(rows, "`k.y` string, `t x` string"), key="k.y", text="t x").collect()}
    n = len(passage.split())
    assert sorted([got["a"]["__n_removed_words"], got["b"]["__n_removed_words"]]) == [0, n] and got[None]["t x"] == "" and got["c"]["t x"] == "x"


def test_bands():
    assert bands_for(0.8, 0.99) == 3 and bands_for(0.8, 0.8) == 1 and 1 - 0.5 ** bands_for(0.5, 0.999) >= 0.999


def test_near_paragraphs_collide(spark):
    """Recall of the bands and precision of the verification on pairs of long paragraphs."""
    rng = np.random.default_rng(6)
    hit = 0
    for _ in range(300):
        base = rng.integers(0, 1 << 62, 60).astype(np.uint64)
        other = base.copy()
        other[:6] = rng.integers(0, 1 << 62, 6)  # 54 of 66
        minima = [[S.mixed(np.uint64(0) + np.min(S.mixed(x ^ s)) + s) for s in S.mixed(np.arange(1, S.BANDS + 1, dtype=np.uint64))] for x in (base, other)]
        hit += any(a == b for a, b in zip(*minima))
    assert hit >= 0.97 * 300


def test_empty(spark):
    assert dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0
