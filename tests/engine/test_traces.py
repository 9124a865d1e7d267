"""Hand-written traces: reading, pairing, containment, states, contexts."""

import json

import pytest
from pyspark.sql import functions as F

from invarium.functions import values as V
from invarium.operators import events as E
from invarium.operators import metadata as M
from invarium.schema import EXCEPTION, POST, PRE, kind_of
from invarium.sources import traces as T

F1 = [
    {"time": 10, "type": "state_change", "process_id": 1, "thread_id": 1, "meta_vars": {"step": 0, "stage": "training"}, "var_name": "m.w", "var_type": "torch.nn.Parameter", "mode": "new", "attributes": {"grad": 7, "dtype": "torch.float32", "is_leaf": True}},
    {"time": 20, "type": PRE, "process_id": 1, "thread_id": 1, "meta_vars": {"step": 1, "stage": "training"}, "func_call_id": "c1", "function": "pkg.Opt.zero_grad", "is_bound_method": True, "obj_id": 99, "args": {"0": {"pkg.Opt": {}}}, "kwargs": {}, "proxy_obj_names": [["m.w", "Parameter"]]},
    {"time": 25, "type": PRE, "process_id": 1, "thread_id": 1, "meta_vars": {"step": 1, "stage": "training"}, "func_call_id": "c2", "function": "pkg.fill", "is_bound_method": False, "args": {"0": {"float": 0.5}}, "kwargs": {"max_v": {"float": 1.0}}},
    {"time": 26, "type": POST, "process_id": 1, "thread_id": 1, "meta_vars": {"step": 1, "stage": "training"}, "func_call_id": "c2", "function": "pkg.fill", "return_values": {"torch.FloatTensor": {"shape": [2, 3], "dtype": "torch.float32", "max": 0.9}}},
    {"time": 30, "type": "state_change", "process_id": 1, "thread_id": 1, "meta_vars": {"step": 1, "stage": "training"}, "var_name": "m.w", "var_type": "torch.nn.Parameter", "mode": "update", "attributes": {"grad": None, "dtype": "torch.float32", "is_leaf": True}},
    {"time": 40, "type": POST, "process_id": 1, "thread_id": 1, "meta_vars": {"step": 1, "stage": "training"}, "func_call_id": "c1", "function": "pkg.Opt.zero_grad", "return_values": {"NoneType": None}},
]


def write(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" if isinstance(r, dict) else r + "\n" for r in rows))


@pytest.fixture
def f1(spark, tmp_path):
    write(tmp_path / "trace_API_1_1.log", F1[1:4] + F1[5:])
    write(tmp_path / "trace_VAR_1_1.log", [F1[0], F1[4]])
    write(tmp_path / "notes.txt", ["not a trace"])
    return T.read_folder(spark, str(tmp_path), "t")


def test_reads_a_folder(f1):
    rows = f1.collect()
    assert len(rows) == 6 and {r.trace_id for r in rows} == {"t"} and {r.stage for r in rows} == {"training"}
    post = next(r for r in rows if r.func_call_id == "c2" and r.type == POST)
    assert json.loads(post.return_json)["torch.FloatTensor"]["shape"] == [2, 3]
    assert next(r for r in rows if r.time_ns == 30).attributes == {"grad": "null", "dtype": '"torch.float32"', "is_leaf": "true"}


def test_bad_lines(spark, tmp_path):
    write(tmp_path / "trace_1.json", [F1[1], "{broken", F1[5]])
    path = str(tmp_path / "trace_1.json")
    with pytest.raises(Exception):
        T.read_records(spark, path).collect()
    assert T.read_records(spark, path, strict=False).count() == 2


def test_calls_and_containment(f1):
    calls = {r.func_call_id: r for r in E.calls(f1).collect()}
    assert (calls["c1"].start_ns, calls["c1"].end_ns, calls["c1"].outcome) == (20, 40, "ok")
    assert [(r.parent_id, r.child_id) for r in E.contained_calls(E.calls(f1)).collect()] == [("c1", "c2")]


def test_states_and_changes(f1):
    end = f1.groupBy("trace_id").agg(F.max("time_ns").alias("trace_end_ns"))
    states = E.attr_states(E.attributes(f1), end)
    got = sorted((r.attr, r.state_no, r.value_json, r.start_ns, r.end_ns) for r in states.collect())
    assert got == [("dtype", 1, '"torch.float32"', 10, 40), ("grad", 1, "7", 10, 30), ("grad", 2, "null", 30, 40)]
    changes = E.var_changes(states)
    assert [(r.attr, r.change_ns, r.old_json, r.new_json) for r in changes.collect()] == [("grad", 30, "7", "null")]
    assert [r.func_call_id for r in E.changes_in_calls(E.calls(f1), changes).collect()] == ["c1"]


def test_exception_and_incomplete(spark, tmp_path):
    base = {"process_id": 1, "thread_id": 1}
    rows = [{"time": 0, "type": PRE, "func_call_id": "main", "function": "main", **base}, {"time": 5, "type": PRE, "func_call_id": "e", "function": "f", **base}, {"time": 9, "type": EXCEPTION, "func_call_id": "e", "function": "f", "exception": "ValueError", **base}]
    other = {"process_id": 1, "thread_id": 2}
    rows += [{"time": 10, "type": PRE, "func_call_id": "cut", "function": "g", **other}, {"time": 5_000_000, "type": PRE, "func_call_id": "late", "function": "g", **other}]
    write(tmp_path / "trace_1.json", rows)
    records = T.read_records(spark, str(tmp_path / "trace_1.json"), "t")
    assert {r.func_call_id: r.outcome for r in E.calls(records).collect()} == {"main": "incomplete", "e": "exception", "cut": "incomplete", "late": "incomplete"}
    assert {r.func_call_id: r.fate for r in E.incomplete_calls(records).collect()} == {"main": "kept", "cut": "truncated", "late": "dropped"}
    assert sorted(r.time_ns for r in E.complete_records(records).collect()) == [0, 5, 9]
    assert E.malformed_calls(records).count() == 0


def test_contexts_reenter(spark):
    names = ["init", "enter", "exit", "init", "enter"]
    rows = [(i, n) for i, n in enumerate(names)]
    events = spark.createDataFrame([(1, t, n) for t, n in rows], "obj_id int, time_ns long, kind string").withColumn("no", F.col("time_ns"))
    got = sorted((r.no, r.start_ns, r.end_ns) for r in E.contexts(events, ["obj_id"], ["time_ns", "no"], "kind = 'init'", "kind = 'enter'", "kind = 'exit'").collect())
    assert got == [(0, 1, 2), (3, 4, None)]


def test_context_meta(spark):
    active = spark.createDataFrame([("c", "no_grad", "{}"), ("c", "amp", '{"on":true}')], "func_call_id string, name string, bound_args string")
    assert E.context_meta(active, ["func_call_id"]).first().meta == {"context_managers.amp": '{"on":true}', "context_managers.no_grad": "{}"}


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert value(V.short_name(F.lit("torch.optim.Optimizer.zero_grad"))) == "Optimizer.zero_grad"
    assert value(V.short_name(F.lit("torch.nn.functional.dropout"))) == "functional.dropout"
    assert value(V.short_name(F.lit("solo"))) == "solo"
    assert value(V.display_attribute(F.lit("_TOOL_grad_ID"))) == "grad_ID" and value(V.display_attribute(F.lit("dtype"))) == "dtype"
    assert value(V.same_value(F.lit("1.0"), F.lit("1.000000001"))) and not value(V.same_value(F.lit("1"), F.lit("1.0")))
    assert value(V.close(F.lit(float("nan")), F.lit(float("nan"))))
    assert value(V.same_argument(F.lit("[1,2]"), F.lit("[2,3]"))) and not value(V.same_argument(F.lit("[1]"), F.lit("[2]")))
    assert value(V.all_close(F.array(F.lit(1.0)), F.array(F.lit(1.0 + 1e-10))))
    assert value(V.hypothesis_value(F.lit("[1,-2]"))) == "3.0000000"
    assert value(V.value_stats(F.array(F.lit(1.0), F.lit(3.0)))).std == 1.0
    assert [value(kind_of(F.lit(x))) for x in ("null", "true", "1", "-2", "1.5", "1e5", '"a"', "[]", "{}")] == ["null", "bool", "int", "int", "float", "float", "str", "array", "object"]


def test_flatten(spark):
    rows = V.flatten_json(spark.createDataFrame([(1, '{"a":{"b":1,"c":{}},"d":[1,{"x":2}],"e":null}')], "id int, j string"), ["id"], "j")
    assert {r.path: r.value_json for r in rows.collect()} == {"a.b": "1", "a.c": "{}", "d": '[1,{"x":2}]', "e": "null"}


def test_metadata(spark, f1):
    assert M.is_called(f1, "pkg.fill") and not M.is_called(f1, "pkg.fill", "init")
    assert [r.stage for r in M.stages(f1).collect()] == ["training"]
    flags = M.flags(f1).first()
    assert flags.stage_annotated and flags.proxied
    seq = spark.createDataFrame([("t", 1, 1, i, f) for i, f in enumerate(["a", "a", None, "a", "b", "b", "b", "m._p"])], "trace_id string, process_id int, thread_id int, no int, function string")
    assert {r.function: r.longest_run for r in M.run_lengths(seq, ["no"]).collect()} == {"a": 2, "b": 3, "m._p": 1}
    assert {r.function for r in M.function_pool(seq, ["no"], 2).collect()} == {"a"}


def test_other_readers(spark, tmp_path):
    (tmp_path / "results.log").write_text('{\n  "a": 1,\n  "b": {\n    "c": 2\n  }\n}\n{\n  "a": 3\n}\n')
    assert [r.a for r in T.read_check_results(spark, str(tmp_path / "results.log"), "a int, b struct<c int>").collect()] == [1, 3]
    (tmp_path / "env.txt").write_text("policy: {'interval': 10, 'warm_up': 5}\n")
    assert tuple(T.read_sampling_config(spark, str(tmp_path / "env.txt")).first()) == (10, 5)
    (tmp_path / "d.diff").write_text("++ x1\n-- y\n+ z\n- w\n same\n")
    assert [r.side for r in T.read_diff(spark, str(tmp_path / "d.diff")).collect()] == ["added_only", "removed_only", "added", "removed"]
    (tmp_path / "depth.log").write_text("<Node function:a.b> - 3\nnoise\n")
    assert [tuple(r) for r in T.read_call_depths(spark, str(tmp_path / "depth.log")).collect()] == [("a.b", 3)]
