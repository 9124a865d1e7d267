"""Comparisons of clause sets: against brute force, and with many conjunctions of few sets."""

import random

from pyspark.sql import functions as F

from invarium.operators import preconditions as P

SETS = "hyp_id long, conj_id long, clauses array<string>"


def some_sets(rng, n):
    return [(rng.randrange(2), i, [rng.choice("abcd") for _ in range(rng.randrange(4))]) for i in range(n)]


def test_implied_like_brute_force(spark):
    rows = some_sets(random.Random(5), 60)
    want = {(h, i) for h, i, c in rows for g, j, d in rows if g == h and j != i and (set(d) < set(c) or (set(d) == set(c) and j < i))}
    got = [tuple(r) for r in P.implied(spark.createDataFrame(rows, SETS)).collect()]
    assert sorted(got) == sorted(want)
    # a name may stand for several sets; its own ones do not make it needless
    assert P.implied(spark.createDataFrame([(0, 1, ["a"]), (0, 1, ["a", "b"])], SETS)).count() == 0


def test_implied_compares_sets_not_conjunctions(spark):
    n = 60_000
    many = spark.range(n).select(F.lit(0).cast("long").alias("hyp_id"), F.col("id").alias("conj_id"), F.array(F.lit("a"), F.concat(F.lit("b"), (F.col("id") % 2).cast("string"))).alias("clauses"))
    assert P.implied(many).count() == n - 2


def test_unsafe_like_brute_force(spark):
    rng = random.Random(6)
    rows = some_sets(rng, 60)
    tested = [(h, e, e % 3 == 0, c, rng.random() < 0.5) for h in range(2) for e in range(20) for c in "abcd"]
    held = {}
    for h, e, positive, c, holds in tested:
        if not positive:
            held.setdefault((h, e), set()).update({c} if holds else ())
    want = {(h, i, e) for h, i, c in rows for (g, e), own in held.items() if g == h and set(c) <= own}
    got = [tuple(r) for r in P.unsafe(spark.createDataFrame(tested, "hyp_id long, example_id long, positive boolean, clause_id string, holds boolean"), spark.createDataFrame(rows, SETS)).collect()]
    assert sorted(got) == sorted(want)
