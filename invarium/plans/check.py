"""From invariants and a trace to check results: one plan per relation over all its invariants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invarium.operators import preconditions as P
from invarium.operators.events import contained_calls
from invarium.operators.relations.order import cover_examples, lead_examples
from invarium.plans.infer import fields, named
from invarium.plans.relations import POOL, Relation, Trace, call_record, chosen
from invarium.sources.scratch import staged


def parsed_clauses(invariants: DataFrame) -> DataFrame:
    """Clauses named in the preconditions: (hyp_id, clause_id, clause, field, values)."""
    ids = F.explode(F.array_distinct(F.flatten(F.from_json("precondition", "array<array<string>>"))))
    c = invariants.select("hyp_id", ids.alias("clause_id"))
    part = F.split("clause_id", r"\|", 3)
    values = F.when(part[0] == "constant", F.split(part[2], ",")).otherwise(F.array().cast("array<string>"))
    return c.select("hyp_id", "clause_id", part[0].alias("clause"), part[1].alias("field"), values.alias("values"))


def pivots(trace: Trace, invariants: DataFrame) -> DataFrame:
    """The calls that a pivoted invariant speaks of: the parent, or the pivot of an order; as examples without a label."""
    pivot = F.when(F.col("relation") == "cover", F.col("second")).otherwise(F.col("first"))
    wanted = invariants.select("relation", "first", "second", pivot.alias("function")).distinct()
    c = trace.calls.withColumn("records", F.array(call_record(trace.calls)))
    out = c.join(wanted, "function").select("relation", "trace_id", "first", "second", F.col("func_call_id").alias("example"), "step", F.col("start_ns").alias("at_ns"), F.lit(None).cast("boolean").alias("positive"), "records")
    return named(out.withColumn("func_call_id", F.col("example")))


def allowed(examples: DataFrame, invariants: DataFrame) -> DataFrame:
    """Examples that meet their invariant's precondition."""
    tested = P.evaluated(fields(examples.withColumn("positive", F.lit(True))), parsed_clauses(invariants))
    met = P.satisfied(tested, invariants.select("hyp_id", "inverted", "precondition")).filter("satisfied").select("hyp_id", "example_id")
    bare = invariants.filter(F.from_json("precondition", "array<array<string>>").isNull()).select("hyp_id")
    return examples.join(met, ["hyp_id", "example_id"], "left_semi").unionByName(examples.join(bare, "hyp_id", "left_semi"))


def judged(calls: DataFrame, invariants: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """Each example that meets its invariant's precondition: ``positive`` where the relation holds.

    Pivots that do not meet it are out before an order looks at neighbours.  A
    thread's last pivot of a lead has no verdict (``positive`` NULL).  The
    relations that occur among the invariants (nine at most) decide what runs.
    """
    present = {r[0] for r in invariants.select("relation").distinct().collect()}
    trace = Trace(calls, records, checking=True)
    relations = chosen(trace, tuple(n for n in POOL if n in present)) if present else []
    unknown = present - set(POOL)
    if unknown:
        raise ValueError(f"no relation {sorted(unknown)}")
    columns = ["hyp_id", "example_id", "trace_id", "relation", "step", "at_ns", "positive"]
    out = None
    for part in _pivoted(trace, invariants, [r.name for r in relations if r.pivoted]), *(_labelled(trace, invariants, r) for r in relations if not r.pivoted):
        if part is not None:
            out = part.select(*columns) if out is None else out.unionByName(part.select(*columns))
    if out is None:
        out = _pivoted(trace, invariants, ["contain"]).select(*columns)
    return out.join(invariants.select("hyp_id", "inv_id", F.col("text_description").alias("label")), "hyp_id")


def _labelled(trace: Trace, invariants: DataFrame, relation: Relation) -> DataFrame:
    own = invariants.filter(F.col("relation") == relation.name)
    ex = named(relation.examples(trace, own.select("first", "second")).withColumn("relation", F.lit(relation.name)))
    return allowed(staged(ex, "occurrences"), own)


def _pivoted(trace: Trace, invariants: DataFrame, names: list[str]) -> DataFrame | None:
    if not names:
        return None
    calls = trace.calls
    ours = invariants.filter(F.col("relation").isin(*names))
    kept = staged(allowed(staged(pivots(trace, ours), "pivots"), ours).drop("positive"), "allowed")
    key = ["trace_id", "first", "second", "func_call_id"]
    contain = kept.filter("relation = 'contain'")
    parents = calls.join(contain.select("trace_id", "func_call_id").distinct(), ["trace_id", "func_call_id"], "left_semi")
    children = calls.join(contain.select(F.col("second").alias("function")).distinct(), "function", "left_semi")
    held = contained_calls(parents, children).select("trace_id", F.col("parent").alias("first"), F.col("child").alias("second"), F.col("parent_id").alias("func_call_id")).distinct().withColumn("positive", F.lit(True))
    out = contain.join(held, key, "left").withColumn("positive", F.coalesce("positive", F.lit(False)))
    for name, make in (("cover", cover_examples), ("lead", lead_examples)):
        if name in names:
            own = kept.filter(F.col("relation") == name)
            labels = make(calls, own.select("first", "second").distinct(), allowed=own).select(*key, "positive")
            out = out.unionByName(own.join(labels, key, "left").select(*out.columns))
    return out


def violations(calls: DataFrame, invariants: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """All violations, not the first alone."""
    return judged(calls, invariants, records).filter("NOT positive").select("trace_id", "inv_id", "label", "relation", F.col("example_id"), "step", F.col("at_ns").alias("time_ns"))


#: Steps of violations that a result lists; the first and the last are always among them, ``n_violations`` counts all.
MOST_STEPS = 10_000


def check(calls: DataFrame, invariants: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """Result of every invariant in every trace: passed, triggered, the distinct steps of its violations and their number.

    There is a row for each invariant and trace.
    """
    broken = F.col("positive").isNotNull() & ~F.col("positive")
    bare = F.from_json("precondition", "array<array<string>>").isNull()
    able = {name: r.counts for name, r in POOL.items() if r.counts}
    # of relations that can count their examples, those without a precondition need no more than that
    of_counts = F.col("relation").isin(*able) & bare
    counted = {r[0] for r in invariants.filter(of_counts).select("relation").distinct().collect()}
    rest = invariants.filter(~of_counts) if counted else invariants
    parts = []
    if not counted or not rest.isEmpty():
        marked = judged(calls, rest, records).withColumn("broken", broken)
        parts.append(marked.groupBy("trace_id", "inv_id", F.when(F.col("broken"), F.col("step")).alias("step")).agg(F.count_if("broken").alias("n")))
    trace = Trace(calls, records, checking=True)
    for r in chosen(trace, tuple(n for n in able if n in counted)) if counted else []:
        own = invariants.filter(of_counts & (F.col("relation") == r.name)).select("first", "second", "inv_id")
        n = r.counts(trace, own.select("first", "second"))
        parts.append(n.join(own, ["first", "second"]).select("trace_id", "inv_id", F.lit(None).cast("long").alias("step"), F.col("n_negative").alias("n")))
    by_step = reduce(DataFrame.unionByName, parts)
    found = by_step.groupBy("trace_id", "inv_id").agg(F.lit(True).alias("triggered"), F.sum("n").alias("n_violations"), F.sort_array(F.collect_list(F.when(F.col("n") > 0, F.col("step")))).alias("steps"))
    steps = F.when(F.size("steps") > MOST_STEPS, F.concat(F.slice("steps", 1, MOST_STEPS - 1), F.slice("steps", -1, 1))).otherwise(F.col("steps"))
    every = invariants.select("inv_id", F.col("text_description").alias("label"), "relation").join(calls.select("trace_id").distinct(), F.lit(True))
    out = every.join(found.withColumn("steps", steps), ["trace_id", "inv_id"], "left")
    n = F.coalesce("n_violations", F.lit(0))
    return out.select("trace_id", "inv_id", "label", "relation", (n == 0).alias("passed"), F.coalesce("triggered", F.lit(False)).alias("triggered"), F.coalesce("steps", F.array().cast("array<bigint>")).alias("steps"), n.alias("n_violations"))
