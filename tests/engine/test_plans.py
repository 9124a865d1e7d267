"""Preconditions, infer and check round trip, reports, sinks, differences."""

import glob
import itertools
import json
import random

import pandas as pd
from pyspark.sql import functions as F

from invarium.operators import diff as D
from invarium.operators import preconditions as P
from invarium.operators.relations.order import cover_examples, lead_examples, merged_chains
from invarium.plans import check as C
from invarium.plans import infer as I
from invarium.plans import report as R
from invarium.sources import sinks
from invarium.sources.traces import read_invariants

CALL = "trace_id string, process_id long, thread_id long, func_call_id string, function string, start_ns long, end_ns long, step long, stage string"


def calls(spark, rows):
    return spark.createDataFrame([("t", 1, 1, str(i), f, s, e, s // 100, "training" if (s // 100) % 2 else "init") for i, (f, s, e) in enumerate(rows)], CALL)


def test_order_closed_forms_on_random_calls(spark):
    rng = random.Random(4)
    rows, want_cover, want_lead = [], {}, {}
    for thread in range(40):
        t, own = 0, []
        for k in range(rng.randint(1, 14)):
            t += rng.randint(1, 5)
            own.append((rng.choice("AB"), t, t + rng.randint(1, 12), f"{thread}-{k}"))
        rows += [("t", 1, thread, i, f, s, e, 0, None) for f, s, e, i in own]
        a, b = [c for c in own if c[0] == "A"], [c for c in own if c[0] == "B"]
        for k, c in enumerate(b):
            before = b[k - 1][2] if k else None
            want_cover[c[3]] = any(x[2] <= c[1] and (before is None or x[1] > before) for x in a)
        for c, after in zip(a, a[1:]):
            want_lead[c[3]] = any(c[2] < x[1] and x[2] <= after[1] for x in b)
        if len(a) == 1:
            want_lead[a[0][3]] = bool(b) and a[0][2] <= max(x[2] for x in b)
    table, pair = spark.createDataFrame(rows, CALL), spark.createDataFrame([("A", "B")], "first string, second string")
    assert {r.func_call_id: r.positive for r in cover_examples(table, pair).collect()} == want_cover
    assert {r.func_call_id: r.positive for r in lead_examples(table, pair).collect()} == want_lead


def test_search():
    def table(rows):
        index = pd.MultiIndex.from_tuples([(p, i) for i, (p, _) in enumerate(rows)])
        return pd.DataFrame([c for _, c in rows], index=index).fillna(False).astype(bool)

    assert P.search(table([(True, {"x": True, "y": True}), (True, {"x": True, "y": False}), (False, {"x": False, "y": True})])) == [["x"]]
    either = P.search(table([(True, {"x": True, "y": False}), (True, {"x": False, "y": True}), (False, {"x": False, "y": False})]))
    assert sorted(either) == [["x"], ["y"]]
    assert P.search(table([(True, {"x": True}), (False, {"x": True})])) is None
    assert P.search(table([(True, {"x": True})])) == []


def fields(spark, rows):
    return spark.createDataFrame(rows, "hyp_id string, example_id string, positive boolean, record_pos int, field string, value_json string")


def test_clauses(spark):
    rows = []
    for i in range(6):
        for pos in (0, 1):
            rows += [("h", f"p{i}", True, pos, "meta_vars.step", str(i)), ("h", f"p{i}", True, pos, "attributes.a", '"same"'), ("h", f"p{i}", True, pos, "var_name", f'"v{pos}"'), ("h", f"p{i}", True, pos, "time", "1")]
            rows += [("h", f"n{i}", False, pos, "meta_vars.step", str(i + pos)), ("h", f"n{i}", False, pos, "attributes.a", '"same"')]
        rows.append(("h", f"p{i}", True, 0, "attributes.partial", "1"))
    f = fields(spark, rows)
    merged = P.merged_clauses(P.local_clauses(P.usable(f)))
    assert {r.clause_id for r in merged.collect()} == {"consistent|meta_vars.step|", 'constant|attributes.a|"same"', "unequal|var_name|"}
    tested = P.evaluated(f, merged)
    assert P.verdicts(tested).first().verdict == "conjunction"
    found = P.learned(tested).first()
    assert found.status == "conditional" and json.loads(found.precondition) in ([["consistent|meta_vars.step|"]], [["unequal|var_name|"]])
    met = P.satisfied(tested, P.learned(tested)).collect()
    assert all(r.satisfied == r.positive for r in met)
    swapped = P.learned(tested.withColumn("positive", ~F.col("positive"))).first()
    assert swapped.inverted and swapped.status == "conditional"


def test_contexts_and_stages_join_preconditions(spark):
    f = fields(spark, [("h", "e", True, 0, "function", '"f"')])
    active = spark.createDataFrame([("e", "context_managers.no_grad", "{}")], "example_id string, field string, value_json string")
    assert {r.clause for r in P.local_clauses(P.usable(P.with_contexts(f, active))).collect()} == {"constant", "exist"}
    conditions = spark.createDataFrame([("h", '[["a"]]'), ("g", '"Unconditional"')], "hyp_id string, precondition string")
    stages = spark.createDataFrame([("h", ['"x"']), ("g", ['"x"'])], "hyp_id string, stages array<string>")
    got = {r.hyp_id: json.loads(r.precondition) for r in P.with_stages(conditions, stages).collect()}
    assert got == {"h": [["a", 'constant|meta_vars.stage|"x"']], "g": [['constant|meta_vars.stage|"x"']]}


def trace(spark, broken=False):
    rows, t = [], 0
    for k in range(40):
        t = k * 100
        rows += [("m.Opt.zero", t, t + 10), ("m.Net.run", t + 20, t + 60), ("m.helper", t + 30, t + 40)]
        if (k % 2) or (broken and k == 30):  # steps of the stage training alone, where it is sound
            rows.append(("m.Opt.step", t + 70, t + 80))
        if broken and k == 35:
            rows.pop()
    return calls(spark, rows)


def test_infer_then_check(spark, tmp_path):
    good, bad = trace(spark), trace(spark, broken=True)
    found = I.infer(good, run_limit=6)
    names = {r.text_description: r for r in found.collect()}
    assert names["Net.run contains m.helper"].status == "unconditional"
    lead = names["Opt.zero leads to Opt.step"]
    assert lead.status == "conditional" and "training" in lead.precondition
    sinks.save_invariants(I.as_invariants(found), str(tmp_path / "inv"))
    sinks.save_failed(found.filter("status = 'failed'"), str(tmp_path / "inv"))
    saved = I.from_invariants(read_invariants(spark, str(tmp_path / "inv")))
    assert {r.inv_id for r in saved.collect()} == {r.inv_id for r in found.filter("status <> 'failed'").collect()}
    assert C.check(good, saved).filter("NOT passed").count() == 0
    results = C.check(bad, saved)
    failed = {r.label for r in results.filter("NOT passed").collect()}
    assert "Opt.zero leads to Opt.step" in failed and "Net.run contains m.helper" not in failed
    assert C.violations(bad, saved).filter("relation = 'lead'").count() >= 1
    sinks.save_results(results, str(tmp_path / "out"))
    assert glob.glob(str(tmp_path / "out" / "status=failed" / "*.json"))
    out = sinks.save_summary(results, f"file://{tmp_path}/violations_summary.json")
    assert json.loads((tmp_path / "violations_summary.json").read_text()) == out and out["distinct_invariants_violated"] == len(failed)
    sinks.save_html(results, f"file://{tmp_path}/report.html")
    assert "leads to" in (tmp_path / "report.html").read_text()
    assert {r.side for r in D.match_invariants(saved, saved).collect()} == {"both"}


def results(spark, rows):
    return spark.createDataFrame(rows, "trace_id string, inv_id string, label string, relation string, passed boolean, triggered boolean, steps array<bigint>")


def test_summary_of_steps(spark):
    rows = results(spark, [("t", "1", "a", "R", False, True, [1, 5, 3]), ("t", "2", "b", "R", False, True, []), ("t", "3", "c", "S", True, True, []), ("t", "4", "d", "S", True, False, []), ("t", "5", "a", "R", False, True, [None, 2])])
    s = {r.inv_id: (r.first_step, r.last_step, r.occurrences) for r in R.summary(rows).collect()}
    assert s == {"1": (1, 5, 3), "2": (None, None, 1), "5": (2, 2, 2)}
    assert tuple(R.overview(rows).first()) == (1, 3)
    assert tuple(R.status_counts(rows).first()) == (5, 3, 1, 1, 4)
    assert {r.step: r.n_invariants for r in R.violation_steps(rows).collect()} == {1: 1, 2: 1, 3: 1, 5: 1}
    assert tuple(R.overview(rows.filter("passed")).first()) == (None, 0)


def test_emitter():
    now, sent = [0.0], []
    e = sinks.Emitter(sent.append, 10, lambda: now[0])
    assert e.offer({"a": 1}) and not e.offer({"a": 1}) and e.offer({"a": 2})
    now[0] = 11
    assert e.offer({"a": 2}) and len(sent) == 3


def test_chains():
    assert merged_chains([("a", "b"), ("b", "c"), ("a", "d")]) == [["a", "d"]]
    assert merged_chains([("a", "b"), ("b", "c"), ("a", "c"), ("a", "d")]) == [["a", "b", "c"], ["a", "c"], ["a", "d"]]
    assert merged_chains([("a", "b"), ("b", "a")]) == merged_chains([]) == []


def test_chains_like_brute_force():
    """Every ordered selection from a source to a sink in which each name leads to all later ones."""
    rng = random.Random(3)
    for _ in range(200):
        names = "abcdef"[: rng.randint(2, 6)]
        edges = [(a, b) for a in names for b in names if a < b and rng.random() < 0.5] + [("z", "y"), ("y", "z")]
        sources, sinks_ = {a for a, _ in edges} - {b for _, b in edges}, {b for _, b in edges} - {a for a, _ in edges}
        fits = lambda p: all((p[i], p[j]) in edges for i in range(len(p)) for j in range(i + 1, len(p)))
        want = [list(p) for n in range(2, len(names) + 1) for p in itertools.permutations(names, n) if p[0] in sources and p[-1] in sinks_ and fits(p)]
        assert sorted(merged_chains(edges)) == sorted(want)


def test_greedy_match_like_brute_force():
    rng = random.Random(8)

    def row():
        return {k: str(rng.randrange(3)) for k in ("a", "b", "c", "type") if rng.random() < 0.7} | {"my_id": str(rng.randrange(9))}

    for _ in range(60):
        left, right = [(i, row()) for i in range(rng.randrange(25))], [(i, row()) for i in range(rng.randrange(25))]
        used, want = set(), []
        for i, x in left:
            best = None
            for j, y in right:
                if j < i or j in used or ("type" in x and "type" in y and x["type"] != y["type"]):
                    continue
                n = sum(x.get(k) != y.get(k) for k in {*x, *y} if k != "my_id")
                if best is None or n < best[1]:
                    best = (j, n)
            if best:
                used.add(best[0])
                want.append((i, *best))
        assert D.greedy_match(left, right) == want


def test_diff(spark):
    side = lambda rows: spark.createDataFrame([("x", n, f) for n, f in rows], "k string, no long, fields map<string,string>")
    left, right = side([(1, {"a": "1", "my_id": "9"}), (2, {"a": "2"}), (3, {"z": "1", "y": "2"})]), side([(1, {"a": "2"}), (2, {"a": "1", "my_id": "7"}), (3, {"q": "1"})])
    m = {(r.left_no, r.right_no, r.n_diff) for r in D.best_matches(left, right, ["k"]).collect()}
    assert m == {(1, 2, 0), (2, 3, 2)}
    e = {(r.no, r.kind) for r in D.edits(D.best_matches(left, right, ["k"]), left, right, ["k"], 1).collect()}
    assert e == {(2, "delete"), (3, "delete"), (1, "insert"), (3, "insert")}
    assert spark.range(1).select(D.without_common(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("a"), F.lit(1))).alias("m")).first().m == {"b": 2}
