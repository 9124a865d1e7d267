"""The relations' protocol: real precondition fields, exchange model, every relation through inference and checks."""

import json

import pytest
from pyspark.sql import functions as F

from invarium.plans import check as C
from invarium.plans import infer as I
from invarium.plans.relations import POOL, Trace, chosen, params, texts, with_active_contexts
from invarium.schema import RECORDS

CALL = "trace_id string, process_id long, thread_id long, func_call_id string, function string, start_ns long, end_ns long, step long, stage string, args_json string, kwargs_json string, return_json string, meta_vars map<string,string>"


def calls(spark, rows):
    """rows: (function, start, end, args, kwargs, returned, meta)."""
    return spark.createDataFrame([("t", 1, 1, str(i), f, s, e, s // 100, None, a, k, r, m) for i, (f, s, e, a, k, r, m) in enumerate(rows)], CALL)


def tensor(**props):
    return json.dumps({"torch.FloatTensor": props})


def test_preconditions_name_meta_variables_and_contexts(spark):
    rows = []
    for k in range(40):
        fast, quiet = k % 2 == 0, k % 3 != 0
        rows.append(("lib.f", 100 * k, 100 * k + 50, None, None, None, {"mode": '"fast"' if fast else '"slow"', "step": str(k)}))
        if fast:
            rows.append(("lib.g", 100 * k + 10, 100 * k + 20, None, None, None, None))
        if not quiet:
            rows.append(("lib.h", 100 * k + 30, 100 * k + 40, None, None, None, None))
    c = calls(spark, rows)
    spans = [("t", 1, 1, "no_grad", "{}", 100 * k - 5, 100 * k + 60) for k in range(40) if k % 3 == 0]
    contexts = spark.createDataFrame(spans, "trace_id string, process_id long, thread_id long, name string, bound_args string, start_ns long, end_ns long")
    c = with_active_contexts(c, contexts)
    found = {r.hyp_id: r for r in I.infer(c, ("contain",)).collect()}
    assert {h: r.status for h, r in found.items()} == {"contain|lib.f|lib.g": "conditional", "contain|lib.f|lib.h": "conditional"}
    assert json.loads(found["contain|lib.f|lib.g"].precondition) == [['constant|meta_vars.mode|"fast"']]
    assert json.loads(found["contain|lib.f|lib.h"].precondition) == [["exist|context_managers.no_grad|"]]
    saved = I.from_invariants(I.as_invariants(spark.createDataFrame(list(found.values()))))
    assert C.check(c, saved).filter("NOT passed OR NOT triggered").count() == 0
    broken = c.filter("NOT (function = 'lib.g' AND step = 4)")
    assert [(r.label, r.steps, r.n_violations) for r in C.check(broken, saved).filter("NOT passed").collect()] == [("lib.f contains lib.g", [4], 1)]


def test_every_relation_round_trips(spark):
    texts_of = {"api": "a.b.c", "var": "torch.nn.Parameter.grad", "const": 'dtype="x=y"', "input": "a.f:in.0.x:y", "output": "out.0.q", "scope": "step", "bound": "min"}
    rows = [(r.name, texts_of[r.kinds[0]], texts_of[r.kinds[1]]) for r in POOL.values()]
    df = spark.createDataFrame(rows, "relation string, first string, second string")
    p = df.withColumn("p", params(F.col("relation"), F.col("first"), F.col("second")))
    first, second = texts(F.col("relation"), F.col("p"))
    assert sorted(tuple(r) for r in p.select("relation", first.alias("first"), second.alias("second")).collect()) == sorted(rows)


def arguments_trace(spark, broken=False):
    rows = []
    for k in range(12):
        t = 100 * k
        rows.append(("lib.clip", t, t + 5, json.dumps({"0": {"int": k}}), json.dumps({"max_norm": {"float": 10.0}}), tensor(max=9.5 if not (broken and k == 7) else 12.0, dtype="f32"), None))
        rows.append(("lib.same", t + 10, t + 15, json.dumps({"0": {"deep": {"er": [{"x": {"id": 1000 + k}}]}}}), None, json.dumps({"got": {"id": 1000 + k if not (broken and k == 3) else 1}}), None))
        for i in range(3):
            rows.append(("lib.seed", t + 20 + 2 * i, t + 21 + 2 * i, json.dumps({"0": {"int": 7 * k + i if not (broken and k == 5) else 1}}), None, None, None))
        rows.append(("lib.cast", t + 40, t + 41, None, None, tensor(dtype="f16", shape=k) if not (broken and k == 9) else None, None))
    return calls(spark, rows)


def test_arguments_and_results(spark):
    good = arguments_trace(spark)
    names = ("constant_output", "input_output", "distinct_argument", "threshold")
    found = I.infer(good, names, run_limit=10)
    sound = found.filter("status = 'unconditional'")
    got = {r.hyp_id for r in sound.collect()}
    wanted = {"constant_output|lib.cast|dtype=\"f16\"", "constant_output|lib.clip|dtype=\"f32\"", "input_output|lib.same:in.0.deep.er.0.x.id|out.got.id", "distinct_argument|lib.seed|step", "threshold|lib.clip:max_norm|max"}
    assert wanted <= got
    saved = I.from_invariants(I.as_invariants(sound))
    assert C.check(good, saved).filter("NOT passed").count() == 0
    bad = {r.label: (r.steps, r.n_violations) for r in C.check(arguments_trace(spark, broken=True), saved).filter("NOT passed").collect()}
    assert bad["lib.seed has distinct arguments in each step"] == ([5], 3)
    assert bad["lib.clip:max_norm is the max of the result"] == ([7], 1)
    assert bad["lib.same:in.0.deep.er.0.x.id is returned as out.got.id"] == ([3], 1)
    assert bad['lib.cast always returns dtype="f16"'] == ([9], 1)  # no result is a violation


def test_variables(spark):
    rows = []

    def state(t, name, **attrs):
        rows.append(("t", "f", t, t, "state_change", 1, 1, t // 100, None, *[None] * 10, name, "Weight", None, None, {}, {k: json.dumps(v) for k, v in attrs.items()}))

    for k in range(10):
        state(100 * k + 10, "a", value=k)
        state(100 * k + 11, "b", value=k)
    records = spark.createDataFrame([r[:9] + r[9:] for r in rows], RECORDS)
    c = calls(spark, [("lib.step", 100 * k + 5, 100 * k + 20, None, None, None, None) for k in range(10)])
    found = {r.hyp_id: r for r in I.infer(c, ("contain_change", "consistent"), records=records).collect()}
    assert found["contain_change|lib.step|Weight.value"].n_positive == 9 and found["contain_change|lib.step|Weight.value"].n_negative == 1
    assert found["consistent|Weight.value|Weight.value"].n_positive == 9  # the last states end with the trace
    sound = I.from_invariants(I.as_invariants(spark.createDataFrame([r for r in found.values() if r.status == "unconditional"])))
    assert C.check(c, sound, records).filter("NOT passed OR NOT triggered").count() == 0
    moved = records.withColumn("attributes", F.when((F.col("var_name") == "b") & (F.col("step") == 4), F.create_map(F.lit("value"), F.lit("99"))).otherwise(F.col("attributes")))
    assert [(r.relation, r.n_violations) for r in C.check(c, sound, moved).filter("NOT passed").collect()] == [("consistent", 1)]


def test_what_a_trace_lacks(spark):
    c = calls(spark, [("lib.f", 0, 1, None, None, None, None)]).drop("return_json")
    assert [r.name for r in chosen(Trace(c), None)] == ["contain", "cover", "lead", "distinct_argument"]
    with pytest.raises(ValueError, match="lacks"):
        I.infer(c, ("threshold",))
    with pytest.raises(ValueError, match="no relation"):
        I.infer(c, ("nonsense",))
    empty = c.limit(0)
    assert I.infer(empty).count() == 0
