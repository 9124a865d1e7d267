"""Pairs of states that live together, counted: against pairs that are made, and where there are too many to make."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from invarium.operators.relations import overlaps, variables
from invarium.operators.relations.overlaps import count_pairs

STATES = "trace_id string, process_id long, var_name string, var_type string, attr string, state_no long, value_json string, start_ns long, end_ns long"


def brute(a, b=None):
    pairs = [(x, y) for i, x in enumerate(a) for y in a[:i]] if b is None else [(x, y) for x in a for y in b]
    return sum(100 * (min(e, f) - max(s, t)) > max(e, f) - min(s, t) for (s, e), (t, f) in pairs)


@pytest.mark.parametrize("scale", [1, 10**17])
def test_count_pairs_like_brute_force(scale):
    rng = random.Random(3)
    for n, m in ((1, 1), (2, 1), (40, 70), (150, 90)):
        made = []
        for k in (n, m):
            s = [rng.randrange(300) for _ in range(k)]
            made.append([(x * scale, (x + rng.choice((1, 2, 5, 100, 400))) * scale) for x in s])
        arrays = [tuple(np.array(c, object if scale > 10**15 else np.int64) for c in zip(*rows)) for rows in made]
        assert count_pairs(arrays[0]) == brute(made[0])
        assert count_pairs(*arrays) == brute(*made)


@pytest.mark.parametrize("inference, chunk", [(True, 1 << 19), (False, 40)])
def test_counts_like_pairs(spark, monkeypatch, chunk, inference):
    monkeypatch.setattr(overlaps, "CHUNK", chunk)
    rng, rows = random.Random(4), []
    values = ["1", "2", "true", '"x"', "0.5", "0.500000001", "0.500000002", "0.7", "null", None]
    for t in "tu":
        for k in range(12):
            at, kind, name = rng.randrange(50), ["A", "B", "torch.Tensor"][k // 5], f"v{k % 5}"
            for no in range(1, rng.randrange(2, 7)):
                end = at + rng.choice((1, 3, 40, 500))
                rows.append((t, 0, name, kind, "y" if k % 4 == 0 else "x", no, rng.choice(values), at, end))
                at = end
    states = spark.createDataFrame(rows, STATES)
    got = variables.typed(variables.pair_counts(states, ["trace_id"], inference)).collect()
    want = variables.consistency(variables.state_pairs(states, ["trace_id"], inference)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want


def test_counts_without_pairs(spark):
    n = 200_000
    states = spark.range(n).select(
        F.lit("t").alias("trace_id"), F.lit(0).cast("long").alias("process_id"), F.col("id").cast("string").alias("var_name"), F.lit("A").alias("var_type"), F.lit("x").alias("attr"),
        F.lit(1).cast("long").alias("state_no"), (F.col("id") % 2).cast("string").alias("value_json"), F.col("id").alias("start_ns"), (F.col("id") + 10 * n).alias("end_ns"),
    )
    r = variables.pair_counts(states, ["trace_id"]).first()
    assert r.n_positive + r.n_negative == n * (n - 1) // 2 and r.n_positive == 2 * (n // 2 * (n // 2 - 1) // 2)
