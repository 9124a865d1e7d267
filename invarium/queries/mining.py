"""Queries over the relations' protocol: hypotheses mined and the same invariants checked."""

from __future__ import annotations

from pyspark.sql import functions as F

from invarium.plans import infer as I
from invarium.plans.check import check
from invarium.plans.relations import POOL, Trace, display
from invarium.queries.registry import CALLS, LEVELS, query
from invarium.queries.relations import LINES, _in_out, _returns
from invarium.sources.scratch import staged
from invarium.sources.tables import event_calls, event_records, load

def _placed(calls):
    """Calls of a table without a time: one thread, in the order of their ids."""
    at = F.col("func_call_id").cast("long")
    return calls.select("*", F.lit("t").alias("trace_id"), F.lit(0).cast("long").alias("step"), F.lit("training").alias("stage"), F.lit(0).cast("long").alias("process_id"), F.lit(0).cast("long").alias("thread_id"), at.alias("start_ns"), (at + 1).alias("end_ns"))


def _limits(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    number = lambda name, x: F.concat(F.lit(f'"{name}":{{"int":'), x.cast("string"), F.lit("}"))
    args = F.concat(F.lit("{"), number("min_val", F.col("o_orderkey") % 8 * 7), F.lit(","), number("max_val", F.col("o_orderkey") % 5 * 9 + 20), F.lit(","), number("other", F.col("o_orderkey")), F.lit("}"))
    return o.select(F.col("o_orderkey").cast("string").alias("func_call_id"), F.concat(F.lit("lib.f"), F.col("o_orderstatus")).alias("function"), args.alias("kwargs_json"), F.concat(F.lit('{"float":'), (F.col("o_custkey") % 50).cast("string"), F.lit(".0}")).alias("return_json"))


def _traces(spark, sf_dir, relation: str, checking: bool = False) -> Trace:
    if relation == "constant_output":
        return Trace(_placed(_returns(spark, sf_dir)), checking=checking)
    if relation == "input_output":
        return Trace(_placed(_in_out(spark, sf_dir)), checking=checking)
    if relation == "threshold":
        return Trace(_placed(_limits(spark, sf_dir)), checking=checking)
    return Trace(event_calls(spark, sf_dir), event_records(spark, sf_dir), run_limit=1_000_000, checking=checking)


_SQL = {
    "contain_change": f"""WITH {CALLS}, {LEVELS}, x AS (SELECT DISTINCT c.func_call_id FROM calls c JOIN changes h ON h.process_id = c.process_id AND h.change_ns >= c.start_ns AND h.change_ns <= c.end_ns)
SELECT function AS first, 'User.level' AS second, count(x.func_call_id)::BIGINT AS n_positive, count(*) FILTER (WHERE x.func_call_id IS NULL)::BIGINT AS n_negative FROM calls LEFT JOIN x USING (func_call_id) GROUP BY 1 HAVING count(x.func_call_id) > 0""",
    "consistent": f"""WITH {LEVELS}, p AS (SELECT a.value_json = b.value_json AS positive FROM states a JOIN states b ON a.process_id || '|' || a.var_name || '|level' < b.process_id || '|' || b.var_name || '|level'
  AND a.start_ns <= b.end_ns AND b.start_ns <= a.end_ns
  WHERE least(a.end_ns, b.end_ns) > greatest(a.start_ns, b.start_ns) AND (least(a.end_ns, b.end_ns) - greatest(a.start_ns, b.start_ns))::DOUBLE / (greatest(a.end_ns, b.end_ns) - least(a.start_ns, b.start_ns)) > 0.01)
SELECT 'User.level' AS first, 'User.level' AS second, count(*) FILTER (WHERE positive)::BIGINT AS n_positive, count(*) FILTER (WHERE NOT positive)::BIGINT AS n_negative FROM p""",
    "constant_output": f"""WITH {LINES}, p AS (SELECT function, func_call_id, 'flag' AS prop, '"' || l_returnflag || '"' AS v FROM t UNION ALL SELECT function, func_call_id, 'status', '"' || l_linestatus || '"' FROM t UNION ALL SELECT function, func_call_id, 'dtype', '"float32"' FROM t),
c AS (SELECT function, func_call_id, prop, min(v) AS value_json FROM p GROUP BY 1, 2, 3 HAVING min(v) = max(v)), n AS (SELECT function, count(DISTINCT func_call_id) AS n FROM t GROUP BY 1)
SELECT function AS first, prop || '=' || value_json AS second, count(*)::BIGINT AS n_positive, (any_value(n.n) - count(*))::BIGINT AS n_negative FROM c JOIN n USING (function) GROUP BY 1, 2 HAVING count(*) >= 2""",
    "input_output": """WITH o AS (SELECT o_orderstatus AS function, o_custkey % 50 AS a, o_orderkey % 7 AS b, o_custkey % 7 AS r FROM orders), n AS (SELECT function, count(*) AS n FROM o GROUP BY 1),
p AS (SELECT function, 'in.0.int' AS in_path, count(*) AS k FROM o WHERE a = r GROUP BY 1 UNION ALL SELECT function, 'in.1.int', count(*) FROM o WHERE b = r GROUP BY 1)
SELECT function || ':' || in_path AS first, 'out.int' AS second, k::BIGINT AS n_positive, (n - k)::BIGINT AS n_negative FROM p JOIN n USING (function)""",
    "distinct_argument": f"""WITH {CALLS}, v AS (SELECT function, step, args_json, count(*) AS n FROM calls GROUP BY ALL), s AS (SELECT function, step FROM v GROUP BY ALL HAVING sum(n) > 1)
SELECT function AS first, 'step' AS second, coalesce(sum(n) FILTER (WHERE n = 1), 0)::BIGINT AS n_positive, coalesce(sum(n) FILTER (WHERE n > 1), 0)::BIGINT AS n_negative FROM v JOIN s USING (function, step) GROUP BY 1""",
    "threshold": """WITH v AS (SELECT 'lib.f' || o_orderstatus AS function, (o_orderkey % 8 * 7)::DOUBLE AS lo, (o_orderkey % 5 * 9 + 20)::DOUBLE AS hi, (o_custkey % 50)::DOUBLE AS r FROM orders),
w AS (SELECT function || ':min_val' AS first, 'min' AS second, r >= lo AS good, lo <> 0 AND abs(r - lo) / lo <= 0.2 AS near FROM v UNION ALL SELECT function || ':max_val', 'max', r <= hi, abs(r - hi) / hi <= 0.2 FROM v)
SELECT first, second, count(*) FILTER (WHERE good)::BIGINT AS n_positive, count(*) FILTER (WHERE NOT good)::BIGINT AS n_negative FROM w GROUP BY 1, 2 HAVING bool_or(near)""",
}


def _register(relation: str, sql: str) -> None:
    def mine(spark, sf_dir):
        found = I.hypotheses(_traces(spark, sf_dir, relation), (relation,))
        return found.select("first", "second", "n_positive", "n_negative")

    def checked(spark, sf_dir):
        """Every hypothesis mined is checked as if it held without a condition: its negatives are the violations."""
        trace = _traces(spark, sf_dir, relation)
        found = staged(I.hypotheses(trace, (relation,)), "hypotheses")
        invariants = found.select("hyp_id", F.col("hyp_id").alias("inv_id"), "relation", "first", "second", display(F.col("relation"), F.col("first"), F.col("second")).alias("text_description"), F.lit(False).alias("inverted"), F.lit('"Unconditional"').alias("precondition"))
        return check(trace.calls, invariants, trace.records).select(F.col("inv_id"), "passed", "triggered", "n_violations")

    query(sql, f"mine_{relation}")(mine)
    query(f"SELECT '{relation}|' || first || '|' || second AS inv_id, n_negative = 0 AS passed, true AS triggered, n_negative AS n_violations FROM ({sql})", f"check_{relation}")(checked)


for _name, _text in _SQL.items():
    assert _name in POOL
    _register(_name, _text)
