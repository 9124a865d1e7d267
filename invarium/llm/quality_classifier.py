"""Quality classifier with hierarchical empirical Bayes (operator 6).

A logistic model over shape features of the text gives each document's own
evidence.  Sites share quality: a document's outcome is its label where it has
one and its evidence elsewhere, and a host's posterior is the mean of a Beta
distribution of the global prior and its outcomes, a path's of its host's
posterior and its own outcomes.  How much the prior weighs is estimated from the
data by moments: a level whose groups hardly differ gets a strong prior, and a
group with few documents stays near its parent.  A document's posterior combines
its evidence with the prior of its path without itself, so that no label speaks
for its own document.

All sums are grouped aggregations of three numbers a document, so that a host
with a third of all documents is pre-aggregated in every task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from invarium.llm.quality_rules import measured
from invarium.llm.shared import staged

#: Labelled documents that the logistic model is fitted on at most (by hash of their key).
SAMPLE = 20_000

#: Each feature is SQL over the metrics of the whole text.
FEATURES = (
    "n_symbols / (word_chars + 1D)", "n_symbol_words / (n_words + 1D)", "n_other / (word_chars + 1D)", "n_exclaims / (n_words + 1D)", "n_caps / (word_chars + 1D)",
    "n_repeat_words / (n_words + 1D)", "n_dup_lines / (n_lines + 1D)", "least(word_chars / (n_words + 1D), 20D) / 10D", "least(n_stops / (n_words + 1D), 1D)",
    "n_distinct / (n_words + 1D)", "log1p(n_words) / 10D",
)


@dataclass(frozen=True)
class Logistic:
    weights: tuple[float, ...]
    bias: float
    rate: float  # of good documents among the labels

    def log_odds(self) -> Column:
        total = F.lit(self.bias)
        for w, f in zip(self.weights, FEATURES):
            total = total + F.lit(w) * F.expr(f)
        return total


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> Logistic:
    """Ridge logistic regression by Newton's method; one class or no rows: the smoothed rate alone."""
    rate = float((y.sum() + 1) / (len(y) + 2))
    if len(set(y.tolist())) < 2:
        return Logistic((0.0,) * len(FEATURES), float(np.log(rate / (1 - rate))), rate)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = np.column_stack([np.ones(len(x)), (x - mean) / spread])
    beta, penalty = np.zeros(z.shape[1]), np.r_[1e-6, np.full(x.shape[1], ridge)]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * beta)
        beta += step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    weights = beta[1:] / spread
    return Logistic(tuple(map(float, weights)), float(beta[0] - weights @ mean), rate)


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, least: float = 1.0, most: float = 1e6) -> float:
    """Prior documents of a level, by moments: within-group variance over between-group variance."""
    row = groups.filter("n > 1").agg(
        F.sum((F.col("s2") - F.col("s") * F.col("s") / F.col("n"))).alias("within"), F.sum(F.col("n") - 1).alias("df"),
        F.sum(F.col("n") * (F.col("s") / F.col("n") - F.col("parent")) ** 2).alias("between"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.count("*").alias("groups"),
    ).first()
    if not row["groups"] or row["groups"] < 2 or not row["df"]:
        return most
    within = row["within"] / row["df"]
    size = (row["n"] - row["n2"] / row["n"]) / (row["groups"] - 1)
    between = (row["between"] / (row["groups"] - 1) - within) / max(size, 1e-9)
    return float(np.clip(within / between, least, most)) if between > 0 and within > 0 else most


def site_quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """(doc_id, evidence, host_quality, path_quality, quality, kept) of every document.

    ``labels``: (key, label 0 or 1) of some; at most ``sample`` of them fit the
    logistic model, everything else covers all documents.  Null and empty texts
    have no words and are judged by that, texts of any length are measured whole;
    null hosts and paths are groups of their own; null keys are judged and cannot
    match a label; repeated rows count each, repeated labels are one, their mean,
    which the logistic model takes as 1 from one half on; ties at ``threshold``
    are kept; without labels the evidence is one half everywhere; an empty table
    gives an empty table; other columns play no part.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col(f"`{text}`").cast("string").alias("text"))
    measures = staged(measured(rows, ["doc_id", "host", "path"]), "measures")
    known = labels.filter(F.col(f"`{label}`").isin(0, 1) & F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{label}`").cast("double").alias("y"))
    known = staged(known.groupBy("doc_id").agg(F.avg("y").alias("y")), "labels")
    features = F.array(*[F.expr(f) for f in FEATURES]).alias("x")
    labelled = measures.join(known, "doc_id")
    # a share by hash that is sure to be near the bound, so that no task sends more than its part of the sample
    share = min(1.0, 1.05 * sample / max(1, known.count()))
    chosen = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < int(share * (1 << 32)))
    fitted = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(features, (F.col("y") >= 0.5).cast("double").alias("y")).collect()
    model = fit_logistic(np.array([r.x for r in fitted], float).reshape(-1, len(FEATURES)), np.array([r.y for r in fitted], float))

    p = F.least(F.greatest(1 / (1 + F.exp(-model.log_odds())), F.lit(1e-6)), F.lit(1 - 1e-6))
    judged = staged(measures.join(known, "doc_id", "left").select("doc_id", F.coalesce("host", F.lit("")).alias("host"), F.col("host").isNull().alias("no_host"), F.coalesce("path", F.lit("")).alias("path"), F.col("path").isNull().alias("no_path"), p.alias("evidence"), F.coalesce("y", p).alias("outcome")), "evidence")
    at_host, at_path = ["host", "no_host"], ["host", "no_host", "path", "no_path"]
    sums = [F.count("*").alias("n"), F.sum("outcome").alias("s"), F.sum(F.col("outcome") * F.col("outcome")).alias("s2")]
    paths = staged(judged.groupBy(*at_path).agg(*sums), "paths")
    hosts = paths.groupBy(*at_host).agg(*[F.sum(c).alias(c) for c in ("n", "s", "s2")])
    overall = hosts.agg(F.sum("s"), F.sum("n")).first()
    mean = overall[0] / overall[1] if overall[1] else 0.5
    strong = _strength(hosts.withColumn("parent", F.lit(mean)))
    hosts = staged(hosts.withColumn("host_quality", (F.col("s") + strong * mean) / (F.col("n") + strong)).select(*at_host, "host_quality"), "hosts")
    paths = staged(paths.join(hosts, at_host).withColumn("parent", F.col("host_quality")), "paths-of-hosts")
    held = _strength(paths)
    paths = staged(paths.withColumn("path_quality", (F.col("s") + held * F.col("parent")) / (F.col("n") + held)).select(*at_path, "n", "s", "host_quality", "path_quality"), "path-quality")
    others = (F.col("s") - F.col("outcome") + held * F.col("host_quality")) / (F.col("n") - 1 + held)
    prior = F.least(F.greatest(others, F.lit(1e-6)), F.lit(1 - 1e-6))
    odds = _logit(F.col("evidence")) - float(np.log(model.rate / (1 - model.rate))) + _logit(prior)
    scored = judged.join(paths, at_path).withColumn("quality", 1 / (1 + F.exp(-odds)))
    return scored.select("doc_id", "evidence", "host_quality", "path_quality", "quality", (F.col("quality") >= threshold).alias("kept"))
