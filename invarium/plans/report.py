"""Reports over check results.

``results(trace_id, inv_id, label, relation, passed, triggered, steps ARRAY<BIGINT>)``
has a row for each checked invariant and trace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def status() -> Column:
    return F.when(~F.col("passed"), "failed").when(F.col("triggered"), "passed").otherwise("not_triggered")


def status_counts(results: DataFrame) -> DataFrame:
    """Totals: a failed invariant that was not triggered counts in both."""
    failed, idle, good = F.count_if(~F.col("passed")), F.count_if(~F.col("triggered")), F.count_if(F.col("passed") & F.col("triggered"))
    return results.agg((failed + idle + good).alias("total"), failed.alias("failed"), good.alias("passed"), idle.alias("not_triggered"), (failed + good).alias("triggered"))


def by_relation(results: DataFrame) -> DataFrame:
    s = status()
    return results.groupBy("relation").agg(*[F.count_if(s == k).alias(k) for k in ("failed", "passed", "not_triggered")])


def violation_steps(results: DataFrame) -> DataFrame:
    """Distinct violated invariants at each step."""
    return results.filter("NOT passed").select("label", F.explode("steps").alias("step")).filter("step IS NOT NULL").groupBy("step").agg(F.count_distinct("label").alias("n_invariants"))


def top_violations(results: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` labels that fail most often, with their first and last step."""
    failed = results.filter("NOT passed")
    out = failed.groupBy("label", "relation").agg(F.count("*").alias("count"), F.min(F.array_min("steps")).alias("first_step"), F.max(F.array_max("steps")).alias("last_step"))
    return out.orderBy(F.desc("count"), "label", "relation").limit(n)


def summary(results: DataFrame) -> DataFrame:
    """One row for each violation: label, relation, first and last step, occurrences (1 without records)."""
    failed = results.filter("NOT passed")
    known = F.filter("steps", lambda x: x.isNotNull())
    listed = F.size("steps").cast("long")
    n = F.coalesce("n_violations", listed) if "n_violations" in results.columns else listed
    occurrences = F.when(F.coalesce(listed, F.lit(0)) > 0, n).otherwise(1)
    return failed.select("trace_id", "inv_id", F.col("label").alias("display_name"), F.col("relation").alias("relation_type"), F.array_min(known).alias("first_step"), F.array_max(known).alias("last_step"), occurrences.cast("long").alias("occurrences"))


def overview(results: DataFrame) -> DataFrame:
    return results.filter("NOT passed").agg(F.min(F.array_min("steps")).alias("first_violation_step"), F.count("*").alias("distinct_invariants_violated"))


def rolled_up(results: DataFrame) -> DataFrame:
    """Counts by trace and relation, by trace, and overall (NULL: all)."""
    s = status()
    return results.rollup("trace_id", "relation").agg(*[F.count_if(s == k).alias(k) for k in ("failed", "passed", "not_triggered")])


def online(violations: DataFrame, n_invariants: int, n: int = 20) -> DataFrame:
    """Live report: the ``n`` invariants that failed first, with counts and the share of all invariants."""
    seen = violations.groupBy("inv_id", "label", "relation").agg(F.count("*").alias("count"), F.min("step").alias("first_step"), F.max("step").alias("last_step"))
    return seen.withColumn("share", F.lit(1.0 / n_invariants if n_invariants else 0.0)).orderBy(F.col("first_step").asc_nulls_last(), F.desc("count"), "inv_id").limit(n)


def checked_steps(last_step: Column, interval: Column, warm_up: Column) -> Column:
    """Steps up to ``last_step`` that a sampling policy looks at."""
    after = F.greatest(last_step - warm_up, F.lit(0))
    return F.least(last_step, warm_up) + F.floor(after / interval)


def sample_trace(records: DataFrame, keys: list[str]) -> DataFrame:
    """The first record of each violation, cut to what a reader needs."""
    w = Window.partitionBy(*keys).orderBy("time_ns", "line_no")
    return records.withColumn("__n", F.row_number().over(w)).filter("__n = 1").select(*keys, "time_ns", "type", "function", "var_name", "step", "stage")


def per_relation(invariants: DataFrame) -> DataFrame:
    return invariants.groupBy("relation").agg(F.count("*").alias("n"))


def detection(records: DataFrame, bounds: DataFrame) -> DataFrame:
    """Detection time of each violation: its latest record, absolute and as a share of the trace."""
    latest = records.groupBy("trace_id", "inv_id").agg(F.max("time_ns").alias("detected_ns"))
    return latest.join(bounds, "trace_id").select("trace_id", "inv_id", "detected_ns", F.try_divide(F.col("detected_ns") - F.col("start_ns"), F.col("end_ns") - F.col("start_ns")).alias("detected_pct"))
