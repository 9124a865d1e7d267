"""Queries over relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from invarium.operators import events as E
from invarium.operators.relations import arguments as A
from invarium.operators.relations import contain, hypotheses, order, variables
from invarium.queries.events import _changes, _record_calls
from invarium.queries.registry import CALLS, LEVELS, query
from invarium.sources.tables import event_calls, load, order_states


def _pairs(spark, *names):
    return spark.createDataFrame(list(names), "first string, second string")


@query(
    f"""WITH {CALLS} SELECT func_call_id, step FROM calls p WHERE function = 'purchase' AND NOT EXISTS (
  SELECT 1 FROM calls k WHERE k.function = 'click' AND k.process_id = p.process_id AND k.thread_id = p.thread_id AND k.start_ns > p.start_ns AND k.end_ns < p.end_ns)"""
)
def contain_api(spark, sf_dir):
    return contain.call_violations(event_calls(spark, sf_dir), "purchase", "click").select("func_call_id", "step")


@query(
    f"""WITH {CALLS}, m AS (SELECT p.func_call_id, p.function AS parent, k.function AS child, count(*) AS n FROM calls p JOIN calls k ON p.process_id = k.process_id AND p.thread_id = k.thread_id AND k.start_ns > p.start_ns AND k.end_ns < p.end_ns GROUP BY ALL),
s AS (SELECT DISTINCT parent, child FROM m)
SELECT s.parent, s.child, count(m.n)::BIGINT AS n_positive, (count(*) - count(m.n))::BIGINT AS n_negative FROM calls c JOIN s ON c.function = s.parent LEFT JOIN m ON m.func_call_id = c.func_call_id AND m.child = s.child GROUP BY ALL"""
)
def contain_hypotheses(spark, sf_dir):
    return hypotheses(contain.call_examples(event_calls(spark, sf_dir)), ["parent", "child"])


@query(
    f"""WITH {CALLS}, {LEVELS}, h AS (SELECT c.func_call_id, c.function, v.attr, v.old_json, v.new_json FROM calls c JOIN changes v ON c.process_id = v.process_id AND v.change_ns BETWEEN c.start_ns AND c.end_ns),
m AS (SELECT DISTINCT * FROM h), s AS (SELECT DISTINCT function, attr, old_json, new_json FROM h)
SELECT s.function AS parent, s.attr, s.old_json, s.new_json, count(m.func_call_id)::BIGINT AS n_positive, (count(*) - count(m.func_call_id))::BIGINT AS n_negative
FROM calls c JOIN s ON c.function = s.function LEFT JOIN m ON m.func_call_id = c.func_call_id AND m.attr = s.attr AND m.old_json = s.old_json AND m.new_json = s.new_json GROUP BY ALL"""
)
def contain_var(spark, sf_dir):
    return hypotheses(contain.change_examples(event_calls(spark, sf_dir), _changes(spark, sf_dir)), ["parent", "attr", "old_json", "new_json"])


@query(
    f"""WITH {CALLS}, {LEVELS}, seen AS (SELECT obj_id, (json_extract(args_json, '$.k')::BIGINT % 10)::VARCHAR AS var_name, min(start_ns) AS first_ns FROM calls GROUP BY ALL),
u AS (SELECT c.func_call_id, c.function FROM calls c JOIN seen s ON c.obj_id = s.obj_id AND s.first_ns < c.start_ns WHERE NOT EXISTS (
  SELECT 1 FROM calls d JOIN changes v ON d.process_id = v.process_id AND v.change_ns BETWEEN d.start_ns AND d.end_ns WHERE d.func_call_id = c.func_call_id AND v.var_name = s.var_name))
SELECT function, count(*)::BIGINT AS n FROM u WHERE function IN (SELECT a.function FROM (SELECT c.function, count(DISTINCT c.func_call_id) AS n FROM calls c JOIN seen s ON c.obj_id = s.obj_id AND s.first_ns < c.start_ns GROUP BY 1) a JOIN (SELECT function, count(DISTINCT func_call_id) AS n FROM u GROUP BY 1) b ON a.function = b.function AND a.n = b.n) GROUP BY 1"""
)
def contain_unchanged(spark, sf_dir):
    c = _record_calls(spark, sf_dir)
    causal = E.causal_vars(c)
    related = c.join(causal.select("func_call_id").distinct(), "func_call_id", "left_semi")
    return contain.unchanged_examples(related, causal, E.unchanged_vars(c, causal, _changes(spark, sf_dir))).groupBy("function").agg(F.count("*").alias("n"))


@query(
    f"""WITH {LEVELS}, p AS (SELECT a.value_json = b.value_json AS positive FROM states a JOIN states b ON a.process_id || '|' || a.var_name || '|level' < b.process_id || '|' || b.var_name || '|level'
  AND a.start_ns <= b.end_ns AND b.start_ns <= a.end_ns
  WHERE least(a.end_ns, b.end_ns) > greatest(a.start_ns, b.start_ns) AND (least(a.end_ns, b.end_ns) - greatest(a.start_ns, b.start_ns))::DOUBLE / (greatest(a.end_ns, b.end_ns) - least(a.start_ns, b.start_ns)) > 0.01)
SELECT 'User' AS type_1, 'level' AS attr_1, 'User' AS type_2, 'level' AS attr_2, count(*) FILTER (WHERE positive)::BIGINT AS n_positive, count(*) FILTER (WHERE NOT positive)::BIGINT AS n_negative FROM p"""
)
def consistency(spark, sf_dir):
    states = E.attr_states(E.attributes(_records(spark, sf_dir)))
    return variables.typed(variables.pair_counts(states, ["trace_id"]))


def _records(spark, sf_dir):
    from invarium.sources.tables import event_records

    return event_records(spark, sf_dir)


LINES = """
t AS (SELECT l_orderkey::VARCHAR AS func_call_id, CASE WHEN l_orderkey % 2 = 0 THEN 'pack' ELSE 'ship' END AS function, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_linestatus)) - 1 AS idx, l_returnflag, l_linestatus FROM lineitem)"""


def _returns(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    item = F.struct("l_linenumber", F.concat(F.lit('{"torch.FloatTensor":{"flag":"'), "l_returnflag", F.lit('","status":"'), "l_linestatus", F.lit('","dtype":"float32"}}')).alias("j"))
    grouped = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("items"))
    return grouped.select(F.col("l_orderkey").cast("string").alias("func_call_id"), F.when(F.col("l_orderkey") % 2 == 0, "pack").otherwise("ship").alias("function"), F.concat(F.lit("["), F.array_join("items.j", ","), F.lit("]")).alias("return_json"))


@query(
    f"""WITH {LINES}, p AS (SELECT function, func_call_id, 'flag' AS prop, '"' || l_returnflag || '"' AS v FROM t UNION ALL SELECT function, func_call_id, 'status', '"' || l_linestatus || '"' FROM t UNION ALL SELECT function, func_call_id, 'dtype', '"float32"' FROM t),
c AS (SELECT function, func_call_id, prop, min(v) AS value_json FROM p GROUP BY 1, 2, 3 HAVING min(v) = max(v)), n AS (SELECT function, count(DISTINCT func_call_id) AS n FROM t GROUP BY 1)
SELECT c.function, prop, value_json, count(*)::BIGINT AS n_positive, (any_value(n.n) - count(*))::BIGINT AS n_negative FROM c JOIN n USING (function) GROUP BY 1, 2, 3"""
)
def const_output(spark, sf_dir):
    c = _returns(spark, sf_dir)
    return A.constant_outputs(c, A.tensor_properties(c, "return_json"))


@query(f"WITH {LINES} SELECT func_call_id, idx::INTEGER AS idx, 'flag' AS prop, '\"' || l_returnflag || '\"' AS value_json FROM t")
def tensor_props(spark, sf_dir):
    return A.tensor_properties(_returns(spark, sf_dir), "return_json").filter("prop = 'flag'").select("func_call_id", "idx", "prop", "value_json")


def _in_out(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    return o.select(
        k.alias("func_call_id"), F.col("o_orderstatus").alias("function"),
        F.concat(F.lit('{"0":{"int":'), (F.col("o_custkey") % 50).cast("string"), F.lit('},"1":{"int":'), (F.col("o_orderkey") % 7).cast("string"), F.lit("}}")).alias("args_json"),
        F.concat(F.lit('{"int":'), (F.col("o_custkey") % 7).cast("string"), F.lit("}")).alias("return_json"), c.alias("c"),
    )


@query(
    """WITH o AS (SELECT o_orderstatus AS function, o_custkey % 50 AS a, o_orderkey % 7 AS b, o_custkey % 7 AS r FROM orders), n AS (SELECT function, count(*) AS n FROM o GROUP BY 1),
p AS (SELECT function, 'in.0.int' AS in_path, count(*) AS k FROM o WHERE a = r GROUP BY 1 UNION ALL SELECT function, 'in.1.int', count(*) FROM o WHERE b = r GROUP BY 1)
SELECT function, in_path, 'out.int' AS out_path, k::BIGINT AS n_positive, (n - k)::BIGINT AS n_negative FROM p JOIN n USING (function)"""
)
def in_out(spark, sf_dir):
    c = _in_out(spark, sf_dir)
    return A.input_output(A.value_paths(c, "args_json", "in"), A.value_paths(c, "return_json", "out"))


def _order_sql(labels: str) -> str:
    return f"WITH {CALLS}, {labels}"


COVER = """
b AS (SELECT *, lag(end_ns) OVER (PARTITION BY process_id, thread_id ORDER BY start_ns, func_call_id) AS prev FROM calls WHERE function = 'view')
SELECT func_call_id, EXISTS (SELECT 1 FROM calls a WHERE a.function = 'click' AND a.process_id = b.process_id AND a.thread_id = b.thread_id AND a.end_ns <= b.start_ns AND (b.prev IS NULL OR a.start_ns > b.prev)) AS positive FROM b"""


@query(_order_sql(COVER))
def cover(spark, sf_dir):
    return order.cover_examples(event_calls(spark, sf_dir), _pairs(spark, ("click", "view"))).select("func_call_id", "positive")


LEAD = """
a AS (SELECT *, lead(start_ns) OVER (PARTITION BY process_id, thread_id ORDER BY start_ns, func_call_id) AS nxt, count(*) OVER (PARTITION BY process_id, thread_id) AS n FROM calls WHERE function = 'view')
SELECT func_call_id, CASE WHEN n = 1 THEN coalesce((SELECT max(b.end_ns) FROM calls b WHERE b.function = 'click' AND b.process_id = a.process_id AND b.thread_id = a.thread_id) >= a.end_ns, false)
  ELSE EXISTS (SELECT 1 FROM calls b WHERE b.function = 'click' AND b.process_id = a.process_id AND b.thread_id = a.thread_id AND b.start_ns > a.end_ns AND b.end_ns <= a.nxt) END AS positive
FROM a WHERE n = 1 OR nxt IS NOT NULL"""


@query(_order_sql(LEAD))
def lead(spark, sf_dir):
    return order.lead_examples(event_calls(spark, sf_dir), _pairs(spark, ("view", "click"))).select("func_call_id", "positive")


@query(
    f"""WITH {CALLS}, v AS (SELECT function, step, args_json, count(*) AS n FROM calls GROUP BY ALL)
SELECT function, step, (sum(n) * (sum(n) - 1) / 2)::BIGINT AS n_pairs, sum((n * (n - 1) / 2)::BIGINT)::BIGINT AS n_same FROM v GROUP BY 1, 2"""
)
def distinct_arg(spark, sf_dir):
    return A.distinct_arguments(event_calls(spark, sf_dir), ["function", "step"])


def _lists(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    text = F.concat(F.lit("["), (k % 9).cast("string"), F.lit(","), (k % 11 + 100).cast("string"), F.lit(","), (k % 5 + 200).cast("string"), F.lit("]"))
    return o.select(F.lit("f").alias("function"), (F.col("o_custkey") % 40).alias("step"), k.cast("string").alias("func_call_id"), text.alias("args_json"))


@query(
    """WITH v AS (SELECT o_custkey % 40 AS step, [o_orderkey % 9, o_orderkey % 11 + 100, o_orderkey % 5 + 200] AS l, '[' || o_orderkey % 9 || ',' || (o_orderkey % 11 + 100) || ',' || (o_orderkey % 5 + 200) || ']' AS t, count(*) AS n FROM orders GROUP BY ALL)
SELECT a.step, count(*)::BIGINT AS n_similar, sum(a.n * b.n)::BIGINT AS n_calls FROM v a JOIN v b ON a.step = b.step AND a.t < b.t
WHERE len(list_intersect(a.l, b.l))::DOUBLE / len(list_distinct(list_concat(a.l, b.l))) >= 0.1 GROUP BY 1"""
)
def similar_arg(spark, sf_dir):
    pairs = A.similar_arguments(_lists(spark, sf_dir), ["function", "step"])
    return pairs.groupBy("step").agg(F.count("*").alias("n_similar"), F.sum(F.col("a_calls") * F.col("b_calls")).alias("n_calls"))


def _threshold(spark, sf_dir, kind):
    o = load(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string").alias("func_call_id")
    args = o.select(key, F.lit(f"{kind}_val").alias("name"), (F.col("o_orderkey") % 8 * 7).cast("string").alias("value_json"))
    results = o.select(key, (F.col("o_custkey") % 50).cast("double").alias("result"))
    out = A.threshold_examples(args, results, kind)
    return out.groupBy("threshold").agg(F.count_if("positive").alias("n_positive"), F.count_if(~F.col("positive")).alias("n_negative"), F.count_if("close").alias("n_close"))


def _threshold_sql(op: str) -> str:
    return f"""WITH v AS (SELECT (o_orderkey % 8 * 7)::DOUBLE AS threshold, (o_custkey % 50)::DOUBLE AS result FROM orders)
SELECT threshold, count(*) FILTER (WHERE result {op} threshold)::BIGINT AS n_positive, count(*) FILTER (WHERE NOT result {op} threshold)::BIGINT AS n_negative,
count(*) FILTER (WHERE threshold <> 0 AND abs(result - threshold) / threshold <= 0.2)::BIGINT AS n_close FROM v GROUP BY 1"""


@query(_threshold_sql(">="))
def threshold_min(spark, sf_dir):
    return _threshold(spark, sf_dir, "min")


@query(_threshold_sql("<="))
def threshold_max(spark, sf_dir):
    return _threshold(spark, sf_dir, "max")


@query(
    """WITH w AS (
  SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus, CASE WHEN lag(o_orderstatus) OVER v IS DISTINCT FROM o_orderstatus OR row_number() OVER v = 1 THEN 1 ELSE 0 END AS c
  FROM orders WINDOW v AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
), i AS (SELECT *, sum(c) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS n FROM w), s AS (SELECT o_custkey, n, '"' || min(o_orderstatus) || '"' AS value FROM i GROUP BY 1, 2)
SELECT o_custkey::VARCHAR AS var_name, value, count(*)::BIGINT AS times FROM s GROUP BY 1, 2 HAVING count(*) > 2"""
)
def periodic(spark, sf_dir):
    return variables.periodic(E.attr_states(order_states(spark, sf_dir)), least=2).select("var_name", "value", "times")
