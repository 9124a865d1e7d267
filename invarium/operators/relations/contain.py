"""Containment: every call of the parent holds a call of the child, or a change of a variable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invarium.operators.events import changes_in_calls, contained_calls


def call_examples(calls: DataFrame, parent: str | None = None, child: str | None = None) -> DataFrame:
    """(parent, child, func_call_id, n_matches, positive) for pairs of functions that occur contained at all.

    With both names given, one row for each call of the parent, also where no
    call ever holds the child.
    """
    parents = calls if parent is None else calls.filter(F.col("function") == parent)
    children = calls if child is None else calls.filter(F.col("function") == child)
    held = contained_calls(parents, children).groupBy("trace_id", F.col("parent_id").alias("func_call_id"), "child").count()
    if child is not None:
        pairs = parents.withColumn("child", F.lit(child))
    else:
        seen = contained_calls(parents, children).select("parent", "child").distinct()
        pairs = parents.join(seen, parents.function == seen.parent).drop("parent")
    out = pairs.join(held, ["trace_id", "func_call_id", "child"], "left")
    n = F.coalesce("count", F.lit(0))
    return out.select("trace_id", F.col("function").alias("parent"), "child", "func_call_id", "step", "stage", "start_ns", n.alias("n_matches"), (n > 0).alias("positive"))


def call_violations(calls: DataFrame, parent: str, child: str) -> DataFrame:
    return call_examples(calls, parent, child).filter("NOT positive")


def change_examples(calls: DataFrame, changes: DataFrame) -> DataFrame:
    """(parent, var_type, attr, old_json, new_json, func_call_id, positive): which kinds of change each call holds."""
    held = changes_in_calls(calls, changes)
    kind = ["var_type", "attr", "old_json", "new_json"]
    matched = held.groupBy("trace_id", "func_call_id", *kind).count()
    seen = held.select("function", *kind).distinct()
    pairs = calls.select("trace_id", "func_call_id", "function", "step", "stage").join(seen, "function")
    out = pairs.join(matched, ["trace_id", "func_call_id", *kind], "left")
    return out.select("trace_id", F.col("function").alias("parent"), *kind, "func_call_id", "step", "stage", F.coalesce("count", F.lit(0)).alias("n_matches"), F.col("count").isNotNull().alias("positive"))


def unchanged_examples(calls: DataFrame, causal: DataFrame, unchanged: DataFrame) -> DataFrame:
    """Functions whose every call has at least one related variable that it leaves alone, and those variables."""
    n_calls = calls.groupBy("function").agg(F.count_distinct("func_call_id").alias("n"))
    with_some = unchanged.groupBy("function").agg(F.count_distinct("func_call_id").alias("m"))
    always = n_calls.join(with_some, "function").filter("n = m").select("function")
    return unchanged.join(always, "function", "left_semi")
