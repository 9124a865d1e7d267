"""Order of calls: A covers B, A leads to B.

Both read one ordered pass over the pivot's calls and the other function's
calls, for all pairs of functions at once: ``pairs`` is a small table of names
(``first``, ``second``), joined by function name, and windows run by pair and
thread.  No call is compared with every other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from invarium.schema import PT

_CALL = ("func_call_id", "step", "stage", "start_ns", "end_ns")


def _sides(calls: DataFrame, pairs: DataFrame, pivot: str, keys: tuple[str, ...], allowed: DataFrame | None):
    """Calls of the pivot and whole calls of the other function, by pair.

    ``allowed`` (first, second, func_call_id): pivots whose precondition holds;
    only they count, also as the previous or next one.
    """
    other = "first" if pivot == "second" else "second"
    rows = calls.select(*keys, "function", *_CALL)
    ours = rows.join(pairs, rows.function == pairs[pivot]).select(*keys, "first", "second", *_CALL)
    if allowed is not None:
        ours = ours.join(allowed.select("first", "second", "func_call_id"), ["first", "second", "func_call_id"], "left_semi").select(*keys, "first", "second", *_CALL)
    theirs = rows.filter("end_ns IS NOT NULL").join(pairs, rows.function == pairs[other]).select(*keys, "first", "second", "start_ns", "end_ns")
    return ours, theirs


def _blank(df: DataFrame, like: DataFrame, columns: list[str]):
    kinds = dict(like.dtypes)
    return [F.lit(None).cast(kinds[c]).alias(c) for c in columns]


def cover_examples(calls: DataFrame, pairs: DataFrame, keys: tuple[str, ...] = PT, allowed: DataFrame | None = None) -> DataFrame:
    """Each call of ``second``: did a whole call of ``first`` run since the previous one.

    The latest start among the ``first`` calls that end by the pivot's start
    lies behind the previous pivot's end.
    """
    group = [*keys, "first", "second"]
    b, a = _sides(calls, pairs, "second", keys, allowed)
    b = b.withColumn("previous_end", F.lag("end_ns").over(Window.partitionBy(*group).orderBy("start_ns", "func_call_id")))
    own = [*_CALL, "previous_end"]
    marks = b.select(*group, F.col("start_ns").alias("at"), F.lit(1).alias("pivot"), F.lit(None).cast("long").alias("a_start"), *own)
    ends = a.select(*group, F.col("end_ns").alias("at"), F.lit(0).alias("pivot"), F.col("start_ns").alias("a_start"), *_blank(a, b, own))
    line = Window.partitionBy(*group).orderBy("at", "pivot").rowsBetween(Window.unboundedPreceding, 0)
    seen = marks.unionByName(ends).withColumn("latest", F.max("a_start").over(line)).filter("pivot = 1")
    positive = F.when(F.col("previous_end").isNull(), F.col("latest").isNotNull()).otherwise(F.coalesce(F.col("latest") > F.col("previous_end"), F.lit(False)))
    return seen.select(*group, *_CALL, "previous_end", positive.alias("positive"))


def lead_examples(calls: DataFrame, pairs: DataFrame, keys: tuple[str, ...] = PT, allowed: DataFrame | None = None) -> DataFrame:
    """Each call of ``first`` but a thread's last: did a whole call of ``second`` run before the next one.

    A thread's only call is positive if some ``second`` ends no earlier than it does.
    """
    group = [*keys, "first", "second"]
    a, b = _sides(calls, pairs, "first", keys, allowed)
    w = Window.partitionBy(*group)
    a = a.withColumn("next_start", F.lead("start_ns").over(w.orderBy("start_ns", "func_call_id"))).withColumn("n", F.count("*").over(w))
    own = [*_CALL, "next_start", "n"]
    marks = a.select(*group, F.col("end_ns").alias("at"), F.lit(1).alias("pivot"), F.lit(None).cast("long").alias("b_end"), *own)
    starts = b.select(*group, F.col("start_ns").alias("at"), F.lit(0).alias("pivot"), F.col("end_ns").alias("b_end"), *_blank(b, a, own))
    # Backwards in time; a start at the pivot's own end comes after it and does not count.
    line = Window.partitionBy(*group).orderBy(F.desc("at"), F.desc("pivot")).rowsBetween(Window.unboundedPreceding, 0)
    seen = marks.unionByName(starts).withColumn("earliest", F.min("b_end").over(line)).filter("pivot = 1")
    last = b.groupBy(*group).agg(F.max("end_ns").alias("last_b"))
    seen = seen.join(last, group, "left").filter("n = 1 OR next_start IS NOT NULL")
    positive = F.when(F.col("n") == 1, F.col("last_b") >= F.col("end_ns")).otherwise(F.col("earliest") <= F.col("next_start"))
    return seen.select(*group, *_CALL, "next_start", F.coalesce(positive, F.lit(False)).alias("positive"))


def same_level_pairs(levels: DataFrame, pool: DataFrame) -> DataFrame:
    """(first, second) of pool functions that are on one level in some thread."""
    a, b = pool.select(F.col("function").alias("func_a")), pool.select(F.col("function").alias("func_b"))
    found = levels.filter("same_level").select("func_a", "func_b").distinct()
    return found.join(a, "func_a", "left_semi").join(b, "func_b", "left_semi").select(F.col("func_a").alias("first"), F.col("func_b").alias("second"))


def merged_chains(edges: list[tuple[str, str]]) -> list[list[str]]:
    """Chains of an order relation over function names, each name related to every later one.

    ``edges`` are names of functions, not calls.  A chain starts at a name that
    nothing leads to, a name joins it if every name of the chain has an edge to
    it, and it counts if its last name leads nowhere.
    """
    after: dict[str, set[str]] = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    entered = {b for own in after.values() for b in own}
    chains: list[list[str]] = []
    work = [([a], after[a]) for a in sorted(after, reverse=True) if a not in entered]
    while work:
        chain, common = work.pop()
        if chain[-1] not in after:
            chains.append(chain)
        work += [([*chain, b], common & after.get(b, set())) for b in sorted(common, reverse=True) if b not in chain]
    return chains
