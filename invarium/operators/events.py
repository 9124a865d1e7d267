"""High-level events: calls, variable states and changes, containment, contexts, causality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from invarium.operators.temporal import islands, next_where, point_in_interval, without_point
from invarium.schema import EXCEPTION, POST, PRE, PT, STATE, VAR
from invarium.sources.scratch import staged

#: Threads other than the outermost call's may end this long before the trace does without their last call.
GRACE_NS = 1_000_000
#: Attributes of the producer's own bookkeeping, and derived properties.
INTERNAL_ATTRIBUTES, PROPERTY_ATTRIBUTES = "^_", "^(is_|has_|can_)"


def calls(records: DataFrame) -> DataFrame:
    """One row a call: entry and exit records paired in one aggregation; outcome ok, exception or incomplete."""
    pre, post = F.col("type") == PRE, F.col("type").isin(POST, EXCEPTION)
    at = lambda column, when: F.max(F.when(when, F.col(column))).alias(column)
    found = records.filter(F.col("func_call_id").isNotNull()).groupBy("trace_id", "func_call_id").agg(
        at("function", pre), at("process_id", pre), at("thread_id", pre), F.max(F.when(pre, F.col("time_ns"))).alias("start_ns"), F.max(F.when(post, F.col("time_ns"))).alias("end_ns"),
        F.max(F.col("type") == EXCEPTION).alias("raised"), F.count_if(post).alias("n_post"), F.count_if(pre).alias("n_pre"), at("step", pre), at("stage", pre), at("obj_id", pre),
        at("is_bound_method", pre), at("args_json", pre), at("kwargs_json", pre), at("return_json", post), at("exception", post), F.max_by("proxy_obj_names", F.when(pre, 1)).alias("proxy_obj_names"),
        F.max_by("meta_vars", F.when(pre, 1)).alias("meta_vars"),
    )
    outcome = F.when(F.col("n_post") == 0, "incomplete").when(F.col("raised"), "exception").otherwise("ok")
    return found.withColumn("outcome", outcome).drop("raised")


def malformed_calls(records: DataFrame) -> DataFrame:
    """Calls with other than one entry and at most one exit."""
    return calls(records).filter("n_pre <> 1 OR n_post > 1").select("trace_id", "func_call_id", "n_pre", "n_post")


def incomplete_calls(records: DataFrame) -> DataFrame:
    """Calls without an exit, and what becomes of them.

    The outermost call of the trace's main thread (the one that starts first)
    stays; a call of another thread that started within a millisecond of the
    thread's last record is dropped; anything else truncates its thread.
    """
    open_calls = calls(records).filter("outcome = 'incomplete'")
    first = calls(records).groupBy("trace_id").agg(F.min_by("func_call_id", F.struct("start_ns", "func_call_id")).alias("outermost"))
    last = records.groupBy(*PT).agg(F.max("time_ns").alias("last_ns"))
    fate = F.when(F.col("func_call_id") == F.col("outermost"), "kept").when(F.col("last_ns") - F.col("start_ns") <= GRACE_NS, "dropped").otherwise("truncated")
    return open_calls.join(first, "trace_id").join(last, list(PT)).select("trace_id", "process_id", "thread_id", "func_call_id", "function", "start_ns", fate.alias("fate"))


def complete_records(records: DataFrame) -> DataFrame:
    """Records without dropped calls and without what follows a truncating call in its thread."""
    fates = incomplete_calls(records)
    dropped = fates.filter("fate = 'dropped'").select("trace_id", "func_call_id")
    cut = fates.filter("fate = 'truncated'").groupBy(*PT).agg(F.min("start_ns").alias("__cut"))
    left = records.join(cut, list(PT), "left").filter("__cut IS NULL OR time_ns < __cut").drop("__cut")
    return left.join(dropped, ["trace_id", "func_call_id"], "left_anti").select(*records.columns)


def contained_calls(parents: DataFrame, children: DataFrame | None = None, inclusive: bool = False) -> DataFrame:
    """(parent, child) calls of one thread where the child runs wholly inside the parent; bounds are exclusive."""
    kids = children if children is not None else parents
    p = parents.select(*PT, F.col("func_call_id").alias("parent_id"), F.col("function").alias("parent"), F.col("start_ns").alias("p_start"), F.col("end_ns").alias("p_end"), F.col("step").alias("p_step"))
    k = kids.select(*PT, F.col("func_call_id").alias("child_id"), F.col("function").alias("child"), F.col("start_ns").alias("c_start"), F.col("end_ns").alias("c_end")).filter("c_end IS NOT NULL")
    p = p.filter("p_end IS NOT NULL")
    inside = "c_start >= p_start AND c_end <= p_end AND child_id <> parent_id" if inclusive else "c_start > p_start AND c_end < p_end"
    return point_in_interval(k, p, PT, "c_start", "p_start", "p_end").filter(inside)


def attributes(records: DataFrame, keep_properties: bool = False) -> DataFrame:
    """Unpivot of variable states: (trace_id, process_id, var_name, var_type, attr, value_json, time_ns, record_no)."""
    states = records.filter(F.col("type") == STATE)
    rows = states.select(*VAR, F.col("time_ns"), F.col("line_no").alias("record_no"), F.explode("attributes").alias("attr", "value_json"))
    rows = rows.filter(~F.col("attr").rlike(INTERNAL_ATTRIBUTES))
    return rows if keep_properties else rows.filter(~F.col("attr").rlike(PROPERTY_ATTRIBUTES))


def attr_states(values: DataFrame, trace_end: DataFrame | None = None) -> DataFrame:
    """Maximal runs of equal values of each attribute: state_no, value_json, start_ns, end_ns, n_records.

    A state ends where the next begins, the last one at the trace's end.
    """
    key = [*VAR, "attr"]
    runs = islands(values, key, ["time_ns", "record_no"], F.col("value_json"))
    states = runs.groupBy(*key, "state_no").agg(
        F.first("value_json").alias("value_json"), F.min("time_ns").alias("start_ns"), F.count("*").alias("n_records"), F.min("record_no").alias("first_record"), F.max("record_no").alias("last_record")
    )
    end = trace_end if trace_end is not None else values.groupBy("trace_id").agg(F.max("time_ns").alias("trace_end_ns"))
    w = Window.partitionBy(*key).orderBy("state_no")
    states = states.withColumn("__next", F.lead("start_ns").over(w))
    # a row a trace: a join by trace alone would send all states of one to one task
    return states.join(F.broadcast(end), "trace_id").withColumn("end_ns", F.coalesce("__next", F.col("trace_end_ns"))).drop("trace_end_ns", "__next")


def var_changes(states: DataFrame) -> DataFrame:
    """Adjacent states of an attribute: change_ns, old_json, new_json."""
    w = Window.partitionBy(*VAR, "attr").orderBy("state_no")
    out = states.withColumn("old_json", F.lag("value_json").over(w)).filter("state_no > 1")
    return out.select(*VAR, "attr", "state_no", F.col("start_ns").alias("change_ns"), "old_json", F.col("value_json").alias("new_json"))


def changes_in_calls(of_calls: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes within each call's closed interval, any thread of its process; an open call ends a millisecond after it starts."""
    c = of_calls.select("trace_id", "process_id", "func_call_id", "function", "start_ns", F.coalesce(F.col("end_ns"), F.col("start_ns") + GRACE_NS).alias("end_ns"))
    return point_in_interval(changes, c, ["trace_id", "process_id"], "change_ns", "start_ns", "end_ns")


def high_level_events(of_calls: DataFrame, changes: DataFrame) -> DataFrame:
    """Everything inside each call: (func_call_id, event_kind, what, at_ns)."""
    inner = contained_calls(of_calls).select("trace_id", F.col("parent_id").alias("func_call_id"), F.lit("call").alias("event_kind"), F.col("child").alias("what"), F.col("c_start").alias("at_ns"))
    moved = changes_in_calls(of_calls, changes).select("trace_id", "func_call_id", F.lit("change").alias("event_kind"), F.concat_ws(".", "var_type", "attr").alias("what"), F.col("change_ns").alias("at_ns"))
    return inner.unionByName(moved)


def contexts(events: DataFrame, keys: list[str], order: list[str], init: str, enter: str, leave: str) -> DataFrame:
    """Context intervals: from the first ``enter`` after each ``init`` to the first ``leave`` after that ``enter``.

    ``init``, ``enter``, ``leave`` are SQL conditions.  Without a later exit the
    interval is open (end NULL).
    """
    me = F.struct(F.col("time_ns"), *[F.col(c) for c in order if c != "time_ns"])
    marked = events.withColumn("__leave", next_where(keys, order, F.expr(leave), F.col("time_ns")))
    marked = marked.withColumn("__enter", next_where(keys, order, F.expr(enter), F.struct(me.alias("at"), F.col("__leave").alias("end"))))
    found = marked.filter(F.expr(init) & F.col("__enter").isNotNull())
    return found.withColumn("start_ns", F.col("__enter.at.time_ns")).withColumn("end_ns", F.col("__enter.end")).drop("__leave", "__enter")


def active_contexts(points: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Context intervals that hold each point (closed); open intervals last to the end."""
    closed = intervals.withColumn("end_ns", F.coalesce("end_ns", F.lit((1 << 62) - 1)))
    return point_in_interval(points, closed, keys, "time_ns", "start_ns", "end_ns")


def context_meta(active: DataFrame, keys: list[str]) -> DataFrame:
    """Map ``context_managers.<name>`` to bound arguments for each point."""
    entry = F.struct(F.concat(F.lit("context_managers."), F.col("name")).alias("k"), F.col("bound_args").alias("v"))
    return active.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_set(entry))).alias("meta"))


def bind_arguments(of_calls: DataFrame, signatures: DataFrame) -> DataFrame:
    """(func_call_id, name, value_json): positional arguments by name, then keywords, then defaults.

    ``signatures(function, pos, name, default_json)`` stands for what the traced
    library would say of itself; its size is that of the library, not of the trace.
    """
    given = of_calls.select("func_call_id", "function", F.from_json("args_json", "map<string,string>").alias("a"), F.from_json("kwargs_json", "map<string,string>").alias("k"))
    bound = given.join(signatures, "function")
    value = F.coalesce(F.try_element_at("k", F.col("name")), F.try_element_at("a", F.col("pos").cast("string")), F.col("default_json"))
    return bound.select("func_call_id", "function", "name", value.alias("value_json")).filter("value_json IS NOT NULL")


def causal_vars(of_calls: DataFrame) -> DataFrame:
    """(func_call_id, var_name, var_type): variables that earlier calls on the same object have seen."""
    asked = of_calls.filter("obj_id IS NOT NULL")
    seen = asked.select("trace_id", "obj_id", F.col("start_ns").alias("seen_ns"), F.explode("proxy_obj_names").alias("p")).select("trace_id", "obj_id", F.col("p")[0].alias("var_name"), F.col("p")[1].alias("var_type"), "seen_ns")
    first = seen.groupBy("trace_id", "obj_id", "var_name", "var_type").agg(F.min("seen_ns").alias("first_ns"))
    return asked.join(first, ["trace_id", "obj_id"]).filter("first_ns < start_ns").select("trace_id", "process_id", "func_call_id", "function", "start_ns", "end_ns", "var_name", "var_type")


def unchanged_vars(of_calls: DataFrame, causal: DataFrame, changes: DataFrame) -> DataFrame:
    """Causally related variables that do not change within the call.

    A change is looked for by its variable and time, in one join that makes no
    pair of a call and a change.
    """
    names = causal.select("trace_id", "process_id", "var_name").distinct()
    moved = changes.select("trace_id", "process_id", "var_name", "change_ns").distinct().join(names, ["trace_id", "process_id", "var_name"], "left_semi")
    return without_point(causal, staged(moved, "moved"), ["trace_id", "process_id", "var_name"], "change_ns", "start_ns", F.coalesce(F.col("end_ns"), F.col("start_ns") + GRACE_NS))


def states_before(values: DataFrame, points: DataFrame) -> DataFrame:
    """Raw records of each variable before each point (``before_ns``), in the point's process where it names one."""
    keys = ["trace_id", "var_name", *(["process_id"] if "process_id" in points.columns else [])]
    return values.join(points, keys).filter("time_ns < before_ns")


def same_level(of_calls: DataFrame, keys: list[str]) -> DataFrame:
    """For each pair of functions of a group: is some call of one disjoint from some call of the other.

    Two sets of intervals hold a disjoint pair exactly where the latest start
    of one lies behind the earliest end of the other.
    """
    bounds = of_calls.groupBy(*keys, "function").agg(F.max("start_ns").alias("s"), F.min("end_ns").alias("e"))
    a = bounds.select(*keys, F.col("function").alias("func_a"), F.col("s").alias("a_s"), F.col("e").alias("a_e"))
    b = bounds.select(*keys, F.col("function").alias("func_b"), F.col("s").alias("b_s"), F.col("e").alias("b_e"))
    level = (F.col("a_s") > F.col("b_e")) | (F.col("b_s") > F.col("a_e"))
    return a.join(b, keys).filter("func_a <> func_b").select(*keys, "func_a", "func_b", level.alias("same_level"))
