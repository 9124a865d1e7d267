"""The relations behind one protocol, for inference and checks.

A relation speaks of two things, ``first`` and ``second``, which are text.  Its
``examples(trace, wanted)`` are labelled occurrences, in one plan for all of its
hypotheses, or for those that ``wanted(first, second)`` names:

    (trace_id, first, second, example, step, at_ns, positive, records)

``records`` are the fields of the one or two records that a precondition sees.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from invarium.functions.values import short_name
from invarium.operators import events as E
from invarium.operators import metadata as M
from invarium.operators.relations import arguments as A
from invarium.operators.relations import variables as V
from invarium.operators.relations.contain import call_examples
from invarium.operators.relations.order import cover_examples, lead_examples, same_level_pairs
from invarium.schema import PT

COLUMNS = ("trace_id", "first", "second", "example", "step", "at_ns", "positive", "records")


@dataclass
class Trace:
    """Calls, and the records that they come from where variables matter; ``checking`` compares states exactly, all of them."""

    calls: DataFrame
    records: DataFrame | None = None
    run_limit: int = M.RUN_LIMIT_ORDER
    checking: bool = False

    def has(self, *columns: str) -> bool:
        return all(self.records is not None if c == "records" else c in self.calls.columns for c in columns)

    @cached_property
    def states(self) -> DataFrame:
        return E.attr_states(E.attributes(self.records))

    @cached_property
    def usable_calls(self) -> DataFrame:
        return self.calls.filter(~M.skipped(F.col("function")))


def call_record(calls: DataFrame) -> Column:
    """Fields of a call's entry record: meta variables, active contexts (``context_meta``), the function, an exception."""
    text = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    own = {"meta_vars.step": F.col("step").cast("string"), "meta_vars.stage": text("stage"), "function": text("function")}
    if "exception" in calls.columns:
        own["exception"] = text("exception")
    maps = [F.create_map(*[x for k, v in own.items() for x in (F.lit(k), v)])]
    if "meta_vars" in calls.columns:
        named = F.transform_keys(F.map_filter("meta_vars", lambda k, _: ~k.isin("step", "stage")), lambda k, _: F.concat(F.lit("meta_vars."), k))
        maps.append(F.coalesce(named, F.create_map().cast("map<string,string>")))
    if "context_meta" in calls.columns:
        maps.append(F.coalesce("context_meta", F.create_map().cast("map<string,string>")))
    return F.map_filter(F.map_concat(*maps), lambda _, v: v.isNotNull())


def with_active_contexts(calls: DataFrame, intervals: DataFrame) -> DataFrame:
    """``calls`` with ``context_meta``: ``context_managers.<name>`` of the contexts (PT, name, bound_args, start_ns, end_ns) active at their start."""
    points = calls.select(*PT, "func_call_id", F.col("start_ns").alias("time_ns"))
    meta = E.context_meta(E.active_contexts(points, intervals, list(PT)), ["trace_id", "func_call_id"])
    return calls.join(meta.withColumnRenamed("meta", "context_meta"), ["trace_id", "func_call_id"], "left")


def _of_calls(trace: Trace, labels: DataFrame) -> DataFrame:
    """Labels (trace_id, first, second, func_call_id, positive) as examples with their calls' fields."""
    c = trace.calls.select("trace_id", "func_call_id", "step", F.col("start_ns").alias("at_ns"), F.array(call_record(trace.calls)).alias("records"))
    return labels.select("trace_id", "first", "second", "func_call_id", "positive").join(c, ["trace_id", "func_call_id"]).withColumnRenamed("func_call_id", "example").select(*COLUMNS)


def _asked(labels: DataFrame, wanted: DataFrame | None) -> DataFrame:
    return labels if wanted is None else labels.join(wanted.select("first", "second").distinct(), ["first", "second"], "left_semi")


def _contain(trace: Trace, wanted: DataFrame | None) -> DataFrame:
    labels = call_examples(trace.usable_calls).select("trace_id", F.col("parent").alias("first"), F.col("child").alias("second"), "func_call_id", "positive")
    return _of_calls(trace, _asked(labels, wanted))


def _order(make):
    def examples(trace: Trace, wanted: DataFrame | None) -> DataFrame:
        if wanted is None:
            pool = M.function_pool(trace.calls, ["start_ns", "func_call_id"], trace.run_limit)
            wanted = same_level_pairs(E.same_level(trace.calls, list(PT)), pool)
        return _of_calls(trace, make(trace.calls, wanted.select("first", "second").distinct()))

    return examples


def _change(trace: Trace, wanted: DataFrame | None) -> DataFrame:
    """Does a call hold a change of a kind of variable: every call of a function that ever holds one, or of those wanted."""
    what = F.concat_ws(".", "var_type", "attr").alias("second")
    held = E.changes_in_calls(trace.usable_calls, E.var_changes(trace.states)).select("trace_id", F.col("function").alias("first"), what, "func_call_id").distinct()
    pairs = held.select("first", "second").distinct() if wanted is None else wanted.select("first", "second").distinct()
    every = trace.usable_calls.select("trace_id", F.col("function").alias("first"), "func_call_id").join(pairs, "first")
    labels = every.join(held.withColumn("positive", F.lit(True)), ["trace_id", "first", "second", "func_call_id"], "left")
    return _of_calls(trace, labels.withColumn("positive", F.coalesce("positive", F.lit(False))))


def _consistent(trace: Trace, wanted: DataFrame | None) -> DataFrame:
    """Pairs of states that live together: (type, attribute) against (type, attribute), the lesser first."""
    side = lambda x: F.concat_ws(".", f"{x}_type", f"{x}_attr")
    record = lambda x: F.create_map(F.lit("var_type"), F.concat(F.lit('"'), f"{x}_type", F.lit('"')), F.lit("var_name"), F.concat(F.lit('"'), F.substring_index(F.substring_index(f"{x}_var", "|", 2), "|", -1), F.lit('"')))
    pairs = V.state_pairs(trace.states, ["trace_id"], inference=not trace.checking)
    out = pairs.select(
        "trace_id", F.least(side("a"), side("b")).alias("first"), F.greatest(side("a"), side("b")).alias("second"), F.concat_ws("|", "a_var", "a_start", "b_var", "b_start").alias("example"),
        F.lit(None).cast("long").alias("step"), F.greatest("a_start", "b_start").alias("at_ns"), "positive", F.array(record("a"), record("b")).alias("records"),
    )
    return _asked(out, wanted)


def _consistent_counts(trace: Trace, wanted: DataFrame | None) -> DataFrame:
    """The examples of ``_consistent``, counted without being made."""
    side = lambda x: F.concat_ws(".", f"type_{x}", f"attr_{x}")
    n = V.pair_counts(trace.states, ["trace_id"], inference=not trace.checking)
    out = n.select("trace_id", F.least(side(1), side(2)).alias("first"), F.greatest(side(1), side(2)).alias("second"), "n_positive", "n_negative")
    return _asked(out.groupBy("trace_id", "first", "second").agg(F.sum("n_positive").alias("n_positive"), F.sum("n_negative").alias("n_negative")), wanted)


def _constant(trace: Trace, wanted: DataFrame | None) -> DataFrame:
    """Do all tensors that a call returns share a property's value: ``second`` is ``property=value``.

    Inference looks at values that two calls or more of a function share, and
    only at functions that always return a tensor; a check takes a call without
    one as a violation.
    """
    c = trace.calls.withColumn("__key", F.struct("trace_id", "func_call_id"))
    shared = A.tensor_properties(c, "return_json", "__key").groupBy("__key", F.col("function").alias("first"), "prop").agg(F.min("value_json").alias("lo"), F.max("value_json").alias("hi"))
    held = shared.filter("lo = hi").select("__key", "first", F.concat_ws("=", "prop", "lo").alias("second"))
    if wanted is None:
        n = trace.calls.groupBy(F.col("function").alias("first")).agg(F.count("*").alias("n"))
        always = shared.groupBy("first").agg(F.count_distinct("__key").alias("m")).join(n, "first").filter("n = m").select("first")
        wanted = held.groupBy("first", "second").agg(F.count("*").alias("n")).filter("n >= 2").join(always, "first", "left_semi")
    every = c.select("__key", F.col("function").alias("first")).join(wanted.select("first", "second").distinct(), "first")
    labels = every.join(held.withColumn("positive", F.lit(True)), ["__key", "first", "second"], "left")
    return _of_calls(trace, labels.select("first", "second", "__key.*", F.coalesce("positive", F.lit(False)).alias("positive")))


def _input_output(trace: Trace, wanted: DataFrame | None) -> DataFrame:
    """Is an argument's value the result's: ``first`` is ``function:path in the arguments``, ``second`` the path in the result."""
    c = trace.calls.withColumn("func_call_id", F.concat_ws("\x1f", "trace_id", "func_call_id"))
    i = A.value_paths(c, "args_json", "in").select("func_call_id", F.concat_ws(":", "function", "path").alias("first"), F.col("value_json").alias("i"))
    o = A.value_paths(c, "return_json", "out").select("func_call_id", F.col("path").alias("second"), F.col("value_json").alias("o"))
    if wanted is None:
        tail = lambda x: F.regexp_replace(x, r"^[^.]*\.", "")
        hits = i.join(o, (i.func_call_id == o.func_call_id) & (i.i == o.o)).filter(~F.col("i").isin("true", "false") | (tail(F.substring_index("first", ":", -1)) == tail("second")))
        wanted = hits.select("first", "second").distinct()
    both = i.join(wanted.select("first", "second").distinct(), "first").join(o, ["func_call_id", "second"])
    parts = F.split("func_call_id", "\x1f", 2)
    return _of_calls(trace, both.select("first", "second", parts[0].alias("trace_id"), parts[1].alias("func_call_id"), (F.col("i") == F.col("o")).alias("positive")))


def _distinct(trace: Trace, wanted: DataFrame | None) -> DataFrame:
    """Has no other call of the function in the same step the same arguments: calls that are not alone in their step."""
    pool = M.function_pool(trace.calls, ["start_ns", "func_call_id"], max(trace.run_limit, M.RUN_LIMIT_ARGUMENT)).select("function")
    c = trace.calls.filter("step IS NOT NULL AND args_json IS NOT NULL").withColumn("second", F.lit("step"))
    c = c.join(pool, "function", "left_semi") if wanted is None else c.join(wanted.select(F.col("first").alias("function"), "second").distinct(), ["function", "second"], "left_semi")
    same = c.groupBy("trace_id", "function", "step", "args_json").agg(F.count("*").alias("n"))
    size = same.groupBy("trace_id", "function", "step").agg(F.sum("n").alias("all")).filter("all > 1")
    labels = c.join(same, ["trace_id", "function", "step", "args_json"]).join(size, ["trace_id", "function", "step"])
    return _of_calls(trace, labels.select("trace_id", F.col("function").alias("first"), "second", "func_call_id", (F.col("n") == 1).alias("positive")))


def _threshold(trace: Trace, wanted: DataFrame | None) -> DataFrame:
    """Does a result respect the argument named ``min`` or ``max``: ``first`` is ``function:argument``.

    A result is a number or the least (greatest) ``min`` (``max``) of its
    tensors.  Inference looks at arguments that some result comes close to.
    """
    c = trace.calls.withColumn("__id", F.struct("trace_id", "func_call_id"))
    named = c.select("__id", "function", F.explode(F.from_json("kwargs_json", "map<string,string>")).alias("name", "value"))
    bare = F.coalesce(F.col("value").try_cast("double"), F.try_element_at(F.map_values(F.from_json("value", "map<string,string>")), F.lit(1)).try_cast("double"))
    arguments = named.select(F.col("__id").alias("func_call_id"), F.concat_ws(":", "function", "name").alias("first"), "name", bare.cast("string").alias("value_json"))
    single = c.select("__id", F.coalesce(F.col("return_json").try_cast("double"), F.try_element_at(F.map_values(F.from_json("return_json", "map<string,string>")), F.lit(1)).try_cast("double")).alias("result")).filter("result IS NOT NULL")
    tensors = A.tensor_properties(c, "return_json", "__id").withColumn("result", F.col("value_json").try_cast("double"))
    out = None
    for kind, best in (("min", F.min), ("max", F.max)):
        results = tensors.filter(F.col("prop") == kind).groupBy("__id").agg(best("result").alias("result")).unionByName(single)
        own = A.threshold_examples(arguments, results.withColumnRenamed("__id", "func_call_id"), kind).withColumn("second", F.lit(kind))
        out = own if out is None else out.unionByName(own)
    # threshold_examples names its own columns; the function comes back with the call
    labels = out.select("func_call_id.*", "name", "second", "positive", "close").join(trace.calls.select("trace_id", "func_call_id", "function"), ["trace_id", "func_call_id"]).withColumn("first", F.concat_ws(":", "function", "name"))
    if wanted is None:
        wanted = labels.filter("close").select("first", "second").distinct()
    return _of_calls(trace, _asked(labels, wanted))


@dataclass(frozen=True)
class Relation:
    """``text`` displays an invariant; ``kinds`` are the parameters in the exchange model; ``pivoted`` ones look at the pivots that a precondition allows.

    ``counts``: (trace_id, first, second, n_positive, n_negative) where examples
    are too many to be made; their examples have no step.
    """

    name: str
    text: str
    examples: Callable[[Trace, DataFrame | None], DataFrame]
    needs: tuple[str, ...] = ()
    kinds: tuple[str, str] = ("api", "api")
    pivoted: bool = False
    skip: tuple[str, ...] = ("function",)
    counts: Callable[[Trace, DataFrame | None], DataFrame] | None = None


POOL: dict[str, Relation] = {
    r.name: r
    for r in (
        Relation("contain", "%s contains %s", _contain, pivoted=True),
        Relation("contain_change", "%s contains a change of %s", _change, ("records",), ("api", "var")),
        Relation("cover", "%s covers %s", _order(cover_examples), pivoted=True),
        Relation("lead", "%s leads to %s", _order(lead_examples), pivoted=True),
        Relation("consistent", "%s is consistent with %s", _consistent, ("records",), ("var", "var"), skip=("var_type",), counts=_consistent_counts),
        Relation("constant_output", "%s always returns %s", _constant, ("return_json",), ("api", "const")),
        Relation("input_output", "%s is returned as %s", _input_output, ("args_json", "return_json"), ("input", "output")),
        Relation("distinct_argument", "%s has distinct arguments in each %s", _distinct, ("args_json",), ("api", "scope")),
        Relation("threshold", "%s is the %s of the result", _threshold, ("kwargs_json", "return_json"), ("input", "bound")),
    )
}


def chosen(trace: Trace, relations: tuple[str, ...] | None) -> list[Relation]:
    """The relations asked for, or all that the trace has the columns for."""
    if relations is None:
        return [r for r in POOL.values() if trace.has(*r.needs)]
    unknown = [n for n in relations if n not in POOL]
    if unknown or not relations:
        raise ValueError(f"no relation {unknown} among {sorted(POOL)}")
    blind = [n for n in relations if not trace.has(*POOL[n].needs)]
    if blind:
        raise ValueError(f"the trace lacks what {blind} need")
    return [POOL[n] for n in relations]


_PARAM = {
    "param_type": "string", "api_full_name": "string", "exception": "string", "arguments": "string", "var_type": "string", "var_name": "string", "attr_name": "string", "pre_value": "string", "post_value": "string",
    "const_value": "string", "name": "string", "index": "bigint", "type": "string", "additional_path": "string", "api_name": "string", "is_input": "boolean",
}


def _param(kind: str, text: Column) -> Column:
    before, after = (lambda by: F.substring_index(text, by, 1)), (lambda by: F.substr(text, F.instr(text, F.lit(by)) + F.lit(1)))
    last = F.substring_index(text, ".", -1)
    head = F.substr(text, F.lit(1), F.length(text) - F.length(last) - F.lit(1))
    set_ = {
        "api": {"param_type": F.lit("APIParam"), "api_full_name": text},
        "var": {"param_type": F.lit("VarTypeParam"), "var_type": head, "attr_name": last},
        "const": {"param_type": F.lit("VarTypeParam"), "var_type": F.lit("torch.Tensor"), "attr_name": before("="), "const_value": after("=")},
        "input": {"param_type": F.lit("InputOutputParam"), "api_name": before(":"), "additional_path": after(":"), "is_input": F.lit(True)},
        "output": {"param_type": F.lit("InputOutputParam"), "additional_path": text, "is_input": F.lit(False)},
        "scope": {"param_type": F.lit("ScopeParam"), "name": text},
        "bound": {"param_type": F.lit("InputOutputParam"), "name": text, "is_input": F.lit(False)},
    }[kind]
    return F.struct(*[set_.get(c, F.lit(None)).cast(t).alias(c) for c, t in _PARAM.items()])


def _text(kind: str, p: Column) -> Column:
    return {
        "api": p["api_full_name"], "var": F.concat_ws(".", p["var_type"], p["attr_name"]), "const": F.concat_ws("=", p["attr_name"], p["const_value"]), "input": F.concat_ws(":", p["api_name"], p["additional_path"]),
        "output": p["additional_path"], "scope": p["name"], "bound": p["name"],
    }[kind]


def _by_relation(relation: Column, value: Callable[[Relation], Column]) -> Column:
    out = F.lit(None)
    for r in POOL.values():
        out = F.when(relation == r.name, value(r)).otherwise(out)
    return out


def params(relation: Column, first: Column, second: Column) -> Column:
    """Both parameters in the exchange model."""
    return _by_relation(relation, lambda r: F.array(_param(r.kinds[0], first), _param(r.kinds[1], second)))


def texts(relation: Column, params_: Column) -> tuple[Column, Column]:
    """The inverse of ``params``."""
    return _by_relation(relation, lambda r: _text(r.kinds[0], params_[0])), _by_relation(relation, lambda r: _text(r.kinds[1], params_[1]))


def display(relation: Column, first: Column, second: Column) -> Column:
    shown = lambda kind, text: short_name(text) if kind == "api" else text
    return _by_relation(relation, lambda r: F.format_string(r.text, shown(r.kinds[0], first), shown(r.kinds[1], second)))
