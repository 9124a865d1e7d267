import numpy as np
import pytest
from pyspark.sql import functions as F

from invarium.llm.quality_classifier import FEATURES, _strength, fit_logistic, site_quality


def test_logistic_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, len(FEATURES)))
    y = (x[:, 0] - 2 * x[:, 3] + rng.normal(size=3000) * 0.3 > 0).astype(float)
    m = fit_logistic(x, y)
    assert (((x @ np.array(m.weights) + m.bias) > 0) == y).mean() > 0.93
    assert fit_logistic(x[:0], y[:0]).rate == 0.5


def test_strength_follows_spread(spark):
    def groups(spread):
        rng = np.random.default_rng(1)
        rows = []
        for _ in range(40):
            p = np.clip(0.5 + spread * rng.normal() + 0.1 * rng.normal(size=50), 0, 1)
            rows.append((50, float(p.sum()), float((p * p).sum()), 0.5))
        return spark.createDataFrame(rows, "n long, s double, s2 double, parent double")

    assert _strength(groups(0.2)) < 5 < _strength(groups(0.001))


def test_sparse_sites_shrink(spark):
    good = " ".join(f"word{i} here." if i % 9 == 8 else f"word{i}" for i in range(80))
    junk = " ".join(f"jun{i}###" for i in range(80))
    rows = [(i, good, "good", "a") for i in range(60)] + [(100 + i, junk, "bad", "b") for i in range(60)] + [(300, good, "new", "c"), (301, None, None, None), (None, good, "good", "a")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, source string, lang string, evidence double")
    labels = spark.createDataFrame([(i, 1) for i in range(20)] + [(100 + i, 0) for i in range(20)] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in site_quality(docs, labels, F.col("source"), F.col("lang")).collect()}
    assert len(got) == len(rows)
    assert all(got[i].kept for i in range(60)) and not any(got[100 + i].kept for i in range(60))
    assert got[0].host_quality > 0.9 and got[100].host_quality < 0.1
    assert got[100].host_quality < got[300].path_quality < got[0].path_quality + 1e-6
    assert site_quality(docs.limit(0), labels, F.col("source"), F.col("lang")).count() == 0
    assert site_quality(docs, labels.limit(0), F.col("source"), F.col("lang")).count() == len(rows)


def strength(groups):
    """Method of moments over (n, sum, sum of squares, parent)."""
    groups = [g for g in groups if g[0] > 1]
    df = sum(n - 1 for n, *_ in groups)
    if len(groups) < 2 or not df:
        return 1e6
    within = sum(s2 - s * s / n for n, s, s2, _ in groups) / df
    total, squares = sum(g[0] for g in groups), sum(g[0] ** 2 for g in groups)
    size = (total - squares / total) / (len(groups) - 1)
    between = (sum(n * (s / n - parent) ** 2 for n, s, _, parent in groups) / (len(groups) - 1) - within) / max(size, 1e-9)
    return min(max(within / between, 1.0), 1e6) if between > 0 and within > 0 else 1e6


def test_posteriors_like_brute_force(spark):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(400):
        host = None if i % 41 == 0 else f"h{int(rng.integers(0, 12)) ** 2 // 9}"
        path = None if i % 53 == 0 else f"{host}/p{int(rng.integers(0, 3))}"
        bad = rng.random() < (0.8 if host in ("h0", "h4") else 0.1)
        text = None if i % 97 == 0 else " ".join(f"x{k}#$" if bad and k % 3 else f"word{rng.integers(0, 99)}" for k in range(int(rng.integers(1, 90))))
        rows.append((i, text, host, path))
        if rng.random() < 0.4:
            labels += [(i, int(not bad))] * (1 + i % 2)
    labels += [(9, 0), (9, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    got = {r.doc_id: r for r in site_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int"), F.col("host"), F.col("path")).collect()}
    given = {}
    for i, y in labels:
        given.setdefault(i, []).append(y)
    outcome = {i: float(np.mean(given[i])) if i in given else got[i].evidence for i, *_ in rows}

    def sums(of):
        groups = {}
        for i, _, host, path in rows:
            own = groups.setdefault(of(host, path), [0, 0.0, 0.0])
            for k, x in enumerate((1, outcome[i], outcome[i] ** 2)):
                own[k] += x
        return groups

    hosts, paths = sums(lambda h, p: h), sums(lambda h, p: (h, p))
    mean = sum(outcome.values()) / len(rows)
    strong = strength([(*g, mean) for g in hosts.values()])
    host_quality = {h: (s + strong * mean) / (n + strong) for h, (n, s, _) in hosts.items()}
    held = strength([(*g, host_quality[h]) for (h, _), g in paths.items()])
    share = sum(round(np.mean(y) + 1e-9) for y in given.values())
    rate = (share + 1) / (len(given) + 2)
    logit = lambda p: np.log(p / (1 - p))
    for i, _, host, path in rows:
        n, s, _ = paths[host, path]
        clip = lambda p: min(max(p, 1e-6), 1 - 1e-6)
        prior = clip((s - outcome[i] + held * host_quality[host]) / (n - 1 + held))
        quality = 1 / (1 + np.exp(-(logit(got[i].evidence) - logit(rate) + logit(prior))))
        want = (host_quality[host], (s + held * host_quality[host]) / (n + held), quality)
        assert np.allclose((got[i].host_quality, got[i].path_quality, got[i].quality), want, atol=1e-6), i
        assert got[i].kept == (got[i].quality >= 0.5)


def test_labels_of_the_corpus(spark):
    from invarium.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r.kept for r in QUERIES["op6_quality_classifier"](spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert np.mean([got[r.doc_id] for r in labels if r.quality == 1]) > 0.98
    assert np.mean([got[r.doc_id] for r in labels if r.quality == 0]) < 0.05
