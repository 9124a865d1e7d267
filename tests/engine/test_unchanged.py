"""Variables that no change within a call touches: against brute force, and with many calls and changes at once."""

import random

from pyspark.sql import functions as F

from invarium.operators import events as E

CAUSAL = "trace_id string, process_id long, func_call_id string, function string, start_ns long, end_ns long, var_name string, var_type string"


def test_unchanged_like_brute_force(spark):
    rng = random.Random(8)
    causal = [("t", k % 2, str(k), "f", s := rng.randrange(10**6), None if k % 9 == 0 else s + rng.choice((0, 1, 900, 70_000)), f"v{k % 3}", "P") for k in range(300)]
    changes = [("t", rng.randrange(2), f"v{rng.randrange(4)}", rng.randrange(10**6)) for _ in range(60)] + [("t", r[1], r[6], r[4]) for r in causal[:20]]
    end = lambda r: r[4] + E.GRACE_NS if r[5] is None else r[5]
    want = {r[2] for r in causal if not any(c[1] == r[1] and c[2] == r[6] and r[4] <= c[3] <= end(r) for c in changes)}
    c = spark.createDataFrame(causal, CAUSAL)
    got = E.unchanged_vars(c, c, spark.createDataFrame(changes, "trace_id string, process_id long, var_name string, change_ns long"))
    assert got.columns == c.columns and sorted(r.func_call_id for r in got.collect()) == sorted(want)


def test_changes_of_others_are_not_paired(spark):
    n = 100_000  # every call holds every change, of other variables
    c = spark.range(n).select(F.lit("t").alias("trace_id"), F.lit(0).cast("long").alias("process_id"), F.col("id").cast("string").alias("func_call_id"), F.lit("f").alias("function"), F.col("id").alias("start_ns"), (F.col("id") + 10 * n).alias("end_ns"), F.lit("v").alias("var_name"), F.lit("P").alias("var_type"))
    moved = spark.range(n).select(F.lit("t").alias("trace_id"), F.lit(0).cast("long").alias("process_id"), F.concat(F.lit("w"), "id").alias("var_name"), (F.col("id") + 2 * n).alias("change_ns"))
    assert E.unchanged_vars(c, c, moved).count() == n
