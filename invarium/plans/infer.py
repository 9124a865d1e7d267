"""From traces to invariants: hypotheses, examples, preconditions.

One plan per relation labels the examples of all its hypotheses; hypotheses of
all traces merge by name, so that a trace that did not propose one still gives
its examples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invarium.functions.values import likelihood
from invarium.operators import metadata as M
from invarium.operators import preconditions as P
from invarium.plans.relations import COLUMNS, POOL, Trace, chosen, display, params, texts
from invarium.sources.scratch import staged

def examples(trace: Trace, relations: tuple[str, ...] | None = None) -> DataFrame:
    """(hyp_id, relation, first, second, trace_id, example_id, step, at_ns, positive, records) of all relations that are switched on."""
    out = None
    for r in chosen(trace, relations):
        own = r.examples(trace, None).select(F.lit(r.name).alias("relation"), *COLUMNS)
        out = own if out is None else out.unionByName(own)
    return named(out)


def named(examples_: DataFrame) -> DataFrame:
    out = examples_.withColumn("hyp_id", F.concat_ws("|", "relation", "first", "second")).withColumn("example_id", F.concat_ws("|", "trace_id", "example"))
    return out.drop("example")


def merged(examples_: DataFrame) -> DataFrame:
    """Counts and likelihood of each hypothesis over all traces."""
    out = examples_.groupBy("hyp_id", "relation", "first", "second").agg(F.count_if("positive").alias("n_positive"), F.count_if(~F.col("positive")).alias("n_negative"))
    return out.withColumn("likelihood", likelihood(F.col("n_positive"), F.col("n_negative")))


def hypotheses(trace: Trace, relations: tuple[str, ...] | None) -> DataFrame:
    """``merged`` of the ``examples``; relations that can count theirs make none."""
    out = None
    for r in chosen(trace, relations):
        if r.counts is None:
            own = merged(examples(trace, (r.name,)))
        else:
            n = r.counts(trace, None).groupBy("first", "second").agg(F.sum("n_positive").alias("n_positive"), F.sum("n_negative").alias("n_negative"))
            n = n.select(F.concat_ws("|", F.lit(r.name), "first", "second").alias("hyp_id"), F.lit(r.name).alias("relation"), "first", "second", "n_positive", "n_negative")
            own = n.withColumn("likelihood", likelihood(F.col("n_positive"), F.col("n_negative")))
        out = own if out is None else out.unionByName(own)
    return out


def pruned(hypotheses: DataFrame, least: int = 2) -> DataFrame:
    return hypotheses.filter(F.col("n_positive") >= least)


def still_to_collect(proposed: DataFrame, traces: DataFrame) -> DataFrame:
    """(hyp_id, trace_id) where a trace has not proposed a hypothesis of another: ``traces`` is a table of trace names."""
    hyps = proposed.select("hyp_id").distinct()
    return hyps.join(traces.select("trace_id").distinct(), F.lit(True)).join(proposed.select("hyp_id", "trace_id"), ["hyp_id", "trace_id"], "left_anti")


def common_arguments(events: DataFrame) -> DataFrame:
    """(hyp_id, name, value_json): arguments that all events of a hypothesis have with one value."""
    n = events.groupBy("hyp_id").agg(F.count_distinct("event_id").alias("n_events"))
    own = events.groupBy("hyp_id", "name").agg(F.count_distinct("event_id").alias("n_with"), F.min("value_json").alias("value_json"), F.max("value_json").alias("other"))
    return own.join(n, "hyp_id").filter("n_with = n_events AND value_json = other").select("hyp_id", "name", "value_json")


def argument_violations(required: DataFrame, given: DataFrame) -> DataFrame:
    """(hyp_id, event_id) where a required argument is missing or different: both (…, name, value_json)."""
    asked = given.select("hyp_id", "event_id").distinct().join(required, "hyp_id")
    return asked.join(given, ["hyp_id", "event_id", "name", "value_json"], "left_anti").select("hyp_id", "event_id").distinct()


def fields(examples_: DataFrame) -> DataFrame:
    """Record fields of the examples, one row each."""
    records = examples_.select("hyp_id", "example_id", "positive", F.posexplode("records").alias("record_pos", "record"))
    rows = records.select("hyp_id", "example_id", "positive", "record_pos", F.explode("record").alias("field", "value_json"))
    return rows.filter("value_json IS NOT NULL")


def identity(relation, first, second):
    """Invariants are the same if relation and parameters are, whatever their text, counts or precondition."""
    return F.sha2(F.to_json(F.struct(relation.alias("relation"), first.alias("first"), second.alias("second"))).cast("binary"), 256)


def infer(calls: DataFrame, relations: tuple[str, ...] | None = None, run_limit: int = M.RUN_LIMIT_ORDER, records: DataFrame | None = None) -> DataFrame:
    """Invariants with preconditions; hypotheses for which none is found have status ``failed``.

    ``relations``: names of ``plans.relations.POOL``, by default all that
    ``calls`` (and ``records``, for variables) have the columns for.
    """
    ex = staged(examples(Trace(calls, records, run_limit), relations), "examples")
    kept = pruned(merged(ex))
    few = staged(P.capped(ex.join(kept.select("hyp_id"), "hyp_id", "left_semi")), "capped")
    f = P.usable(fields(few), skip={r.name: r.skip for r in POOL.values()})
    clauses = P.merged_clauses(P.local_clauses(f))
    tested = staged(P.evaluated(fields(few), clauses), "tested")
    conditions = P.learned(tested)
    bare = kept.join(conditions, "hyp_id", "left")
    status = F.coalesce("status", F.when(F.col("n_negative") == 0, "unconditional").otherwise("failed"))
    found = bare.select(
        identity(F.col("relation"), F.col("first"), F.col("second")).alias("inv_id"), "hyp_id", display(F.col("relation"), F.col("first"), F.col("second")).alias("text_description"), "relation", "first", "second",
        "n_positive", "n_negative", "likelihood", status.alias("status"), F.coalesce("inverted", F.lit(False)).alias("inverted"), F.coalesce("precondition", F.when(status == "unconditional", F.lit('"Unconditional"'))).alias("precondition"),
    )
    return staged(found, "invariants")


def as_invariants(found: DataFrame) -> DataFrame:
    """Rows in the exchange model of invariant files, preconditions as text."""
    return found.filter("status <> 'failed'").select(
        "text_description", "relation", params(F.col("relation"), F.col("first"), F.col("second")).alias("params"), F.to_json(F.struct(F.col("inverted"), F.col("precondition").alias("preconditions"))).alias("precondition"),
        F.col("n_positive").alias("num_positive_examples"), F.col("n_negative").alias("num_negative_examples"),
    )


def from_invariants(saved: DataFrame) -> DataFrame:
    """The inverse of ``as_invariants``."""
    p = F.from_json("precondition", "inverted boolean, preconditions string")
    first, second = texts(F.col("relation"), F.col("params"))
    return saved.select(
        identity(F.col("relation"), first, second).alias("inv_id"), F.concat_ws("|", "relation", first, second).alias("hyp_id"), "text_description", "relation", first.alias("first"), second.alias("second"),
        F.col("num_positive_examples").alias("n_positive"), F.col("num_negative_examples").alias("n_negative"), p["inverted"].alias("inverted"), p["preconditions"].alias("precondition"),
    )
