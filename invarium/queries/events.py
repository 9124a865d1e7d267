"""Queries over scans, metadata and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from invarium.functions.values import flatten_json
from invarium.operators import events as E
from invarium.operators import metadata as M
from invarium.operators.temporal import overlap_share
from invarium.queries.registry import CALLS, LEVELS, query
from invarium.schema import POST, PRE, STATE
from invarium.sources.tables import event_calls, event_records, load, order_states


def levels(spark, sf_dir) -> DataFrame:
    return E.attributes(event_records(spark, sf_dir))


def level_states(spark, sf_dir) -> DataFrame:
    return E.attr_states(levels(spark, sf_dir))


def level_changes(spark, sf_dir) -> DataFrame:
    return E.var_changes(level_states(spark, sf_dir))


RECORDS = f"""
records AS (
  SELECT event_id * 4 AS line_no, start_ns AS time_ns, '{PRE}' AS type, process_id, thread_id, step, stage, func_call_id, function FROM calls
  UNION ALL SELECT event_id * 4 + 1, start_ns, '{STATE}', process_id, thread_id, step, stage, NULL, NULL FROM calls
  UNION ALL SELECT event_id * 4 + 2, end_ns, '{POST}', process_id, thread_id, step, stage, func_call_id, function FROM calls
)"""


@query(f"WITH {CALLS}, {RECORDS} SELECT line_no, time_ns, type, process_id, thread_id, step, stage, func_call_id, function FROM records")
def scan_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_records(spark, sf_dir).select("line_no", "time_ns", "type", "process_id", "thread_id", "step", "stage", "func_call_id", "function")


@query("SELECT event_id, unnest(json_keys(props)) AS path, json_extract(props, '$.' || unnest(json_keys(props)))::VARCHAR AS value_json FROM events")
def flatten_props(spark, sf_dir):
    return flatten_json(load(spark, sf_dir, "events"), ["event_id"], "props")


@query(
    """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'missing' WHEN 1 THEN 'null' ELSE 'value' END AS kind,
       CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'null' ELSE json_extract(props, '$.k')::VARCHAR END AS value_json
FROM events"""
)
def null_vs_missing(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    text = F.when(F.col("event_id") % 3 == 0, "{}").when(F.col("event_id") % 3 == 1, '{"k":null}').otherwise(F.concat(F.lit('{"k":'), k, F.lit("}")))
    v = F.variant_get(F.try_parse_json(text), "$.k", "variant")
    value = F.to_json(v)
    kind = F.when(v.isNull(), "missing").when(F.is_variant_null(v), "null").otherwise("value")
    return load(spark, sf_dir, "events").select("event_id", kind.alias("kind"), value.alias("value_json"))


@query(
    """
SELECT event_id, attr, value_json FROM (
  SELECT event_id, 'k' AS attr, json_extract(props, '$.k')::VARCHAR AS value_json FROM events
  UNION ALL SELECT event_id, 'value', (value * 100)::BIGINT::VARCHAR FROM events)"""
)
def attr_filter(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    text = lambda c: c.cast("string")
    made = F.create_map(
        F.lit("k"), F.get_json_object("props", "$.k"), F.lit("value"), text(F.round(F.col("value") * 100).cast("long")), F.lit("is_click"), text(F.col("event_type") == "click"),
        F.lit("has_user"), F.lit("true"), F.lit("can_buy"), F.lit("false"), F.lit("_X_ID"), text(F.col("event_id")),
    )
    records = e.select(F.lit("t").alias("trace_id"), F.lit(0).alias("process_id"), F.lit("v").alias("var_name"), F.lit("T").alias("var_type"), F.lit(0).alias("time_ns"), F.col("event_id").alias("line_no"), F.lit(STATE).alias("type"), made.alias("attributes"))
    return E.attributes(records).select(F.col("record_no").alias("event_id"), "attr", "value_json")


@query("SELECT 'k' AS field, 'int' AS kind UNION ALL SELECT 'type', 'str' UNION ALL SELECT 'value', 'float'")
def column_kind(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    fields = e.select(F.col("event_id").alias("position"), F.explode(F.create_map(F.lit("k"), F.when(F.col("event_id") % 2 == 0, "null").otherwise(F.get_json_object("props", "$.k")), F.lit("type"), F.concat(F.lit('"'), "event_type", F.lit('"')), F.lit("value"), F.col("value").cast("string"))).alias("field", "value_json"))
    return M.column_kinds(fields)


@query(f"WITH {CALLS} SELECT event_id, CASE WHEN stage = 'evaluation' THEN 'init' ELSE stage END AS stage FROM calls")
def stage_fill(spark, sf_dir):
    gaps = event_calls(spark, sf_dir).withColumn("stage", F.when(F.col("stage") != "evaluation", F.col("stage")))
    return M.fill_stage(gaps).select(F.col("func_call_id").cast("long").alias("event_id"), "stage")


@query(
    f"WITH {CALLS}, {RECORDS} SELECT 'events' AS trace_id, process_id, thread_id, min(time_ns) AS start_ns, max(time_ns) AS end_ns, count(*)::BIGINT AS n_records FROM records GROUP BY ROLLUP (process_id, thread_id)"
)
def time_bounds(spark, sf_dir):
    return M.time_bounds(event_records(spark, sf_dir))


@query(
    f"""WITH {CALLS} SELECT DISTINCT 'process' AS kind, process_id::VARCHAR AS value FROM calls UNION SELECT 'thread', thread_id::VARCHAR FROM calls
UNION SELECT 'function', function FROM calls UNION SELECT 'stage', stage FROM calls"""
)
def distinct_ids(spark, sf_dir):
    return M.distinct_ids(event_records(spark, sf_dir))


@query(f"WITH {CALLS} SELECT count(*) > 0 AS stage_annotated, false AS proxied FROM calls")
def trace_flags(spark, sf_dir):
    return M.flags(event_records(spark, sf_dir)).select("stage_annotated", F.coalesce("proxied", F.lit(False)).alias("proxied"))


@query(f"WITH {CALLS} SELECT 'events' AS trace_id, function, func_call_id, row_number() OVER (PARTITION BY function ORDER BY start_ns, event_id) AS position FROM calls")
def call_ids(spark, sf_dir):
    return M.call_ids(event_records(spark, sf_dir)).withColumn("position", F.col("position").cast("long"))


@query(
    """WITH b AS (SELECT event_type AS function, CASE event_type WHEN 'click' THEN false WHEN 'view' THEN user_id % 4 % 2 = 0 ELSE true END AS bound FROM events)
SELECT function, bool_and(bound) AS is_bound, count(DISTINCT bound) = 1 AS consistent FROM b GROUP BY 1"""
)
def bound_flag(spark, sf_dir):
    r = event_records(spark, sf_dir).filter(F.col("type") == PRE)
    bound = F.when(F.col("function") == "click", False).when(F.col("function") == "view", F.col("process_id") % 2 == 0).otherwise(True)
    return M.bound_methods(r.withColumn("is_bound_method", bound))


RUNS = f"""
{CALLS}, r AS (
  SELECT *, CASE WHEN lag(function) OVER w IS NOT DISTINCT FROM function AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS brk
  FROM calls WINDOW w AS (PARTITION BY process_id, thread_id ORDER BY event_id)
), g AS (
  SELECT *, sum(brk) OVER (PARTITION BY process_id, thread_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM r
), runs AS (
  SELECT function, max(n)::BIGINT AS longest_run FROM (SELECT function, count(*) AS n FROM g GROUP BY process_id, thread_id, function, run) GROUP BY function
)"""


@query(f"WITH {RUNS} SELECT * FROM runs")
def run_length(spark, sf_dir):
    c = event_calls(spark, sf_dir).withColumn("event_id", F.col("func_call_id").cast("long"))
    return M.run_lengths(c, ["event_id"])


@query(f"WITH {RUNS} SELECT * FROM runs WHERE longest_run <= 5")
def pool_filter(spark, sf_dir):
    c = event_calls(spark, sf_dir).withColumn("event_id", F.col("func_call_id").cast("long"))
    return M.function_pool(c, ["event_id"], limit=5, drop_private=True)


@query(f"WITH {CALLS}, b AS (SELECT min(start_ns) AS lo, max(start_ns) AS hi FROM calls) SELECT func_call_id, round((start_ns - lo)::DOUBLE / (hi - lo), 6) AS time_pct FROM calls, b")
def time_pct(spark, sf_dir):
    out = M.time_percentage(event_calls(spark, sf_dir), "start_ns")
    return out.select("func_call_id", F.round("time_pct", 6).alias("time_pct"))


@query(f"WITH {CALLS} SELECT func_call_id, function, process_id, thread_id, start_ns, end_ns, 'ok' AS outcome, step, stage, args_json FROM calls")
def calls(spark, sf_dir):
    return E.calls(event_records(spark, sf_dir).filter(F.col("type") != STATE)).select("func_call_id", "function", "process_id", "thread_id", "start_ns", "end_ns", "outcome", "step", "stage", "args_json")


@query(
    f"""WITH {CALLS}, o AS (SELECT *, end_ns IS NOT NULL AND event_id % 500 <> 0 AS done FROM calls), rec AS (
  SELECT process_id, thread_id, start_ns AS t FROM o UNION ALL SELECT process_id, thread_id, end_ns FROM o WHERE done
), l AS (SELECT process_id, thread_id, max(t) AS last_ns FROM rec GROUP BY ALL), f AS (SELECT func_call_id AS outermost FROM calls ORDER BY start_ns, func_call_id LIMIT 1)
SELECT func_call_id, function, CASE WHEN func_call_id = outermost THEN 'kept' WHEN last_ns - start_ns <= 1000000 THEN 'dropped' ELSE 'truncated' END AS fate
FROM o JOIN l USING (process_id, thread_id), f WHERE NOT done"""
)
def incomplete_calls(spark, sf_dir):
    r = event_records(spark, sf_dir).filter((F.col("type") != POST) | (F.col("func_call_id").cast("long") % 500 != 0))
    return E.incomplete_calls(r).select("func_call_id", "function", "fate")


CONTAINED = """SELECT p.func_call_id AS parent_id, p.function AS parent, k.func_call_id AS child_id, k.function AS child
FROM calls p JOIN calls k ON p.process_id = k.process_id AND p.thread_id = k.thread_id AND k.start_ns > p.start_ns AND k.end_ns < p.end_ns"""


@query(f"WITH {CALLS} {CONTAINED}")
def contained_calls(spark, sf_dir):
    return E.contained_calls(event_calls(spark, sf_dir)).select("parent_id", "parent", "child_id", "child")


@query(f"WITH {LEVELS} SELECT process_id, var_name, attr, state_no, value_json, start_ns, end_ns, n_records FROM states")
def attr_states(spark, sf_dir):
    return level_states(spark, sf_dir).select("process_id", "var_name", "attr", "state_no", "value_json", "start_ns", "end_ns", "n_records")


@query(
    """WITH w AS (
  SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus, CASE WHEN lag(o_orderstatus) OVER v IS DISTINCT FROM o_orderstatus OR row_number() OVER v = 1 THEN 1 ELSE 0 END AS c
  FROM orders WINDOW v AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
), i AS (SELECT *, sum(c) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS state_no FROM w)
SELECT o_custkey::VARCHAR AS var_name, state_no, '"' || min(o_orderstatus) || '"' AS value_json, epoch_us(min(o_orderdate)) * 1000 AS start_ns, count(*)::BIGINT AS n_records FROM i GROUP BY o_custkey, state_no"""
)
def order_status_states(spark, sf_dir):
    return E.attr_states(order_states(spark, sf_dir)).select("var_name", "state_no", "value_json", "start_ns", "n_records")


@query(f"WITH {LEVELS} SELECT process_id, var_name, attr, state_no, change_ns, old_json, new_json FROM changes")
def var_changes(spark, sf_dir):
    return level_changes(spark, sf_dir).select("process_id", "var_name", "attr", "state_no", "change_ns", "old_json", "new_json")


CHANGES_IN_CALLS = "SELECT c.func_call_id, c.function, v.var_name, v.attr, v.change_ns FROM calls c JOIN changes v ON c.process_id = v.process_id AND v.change_ns BETWEEN c.start_ns AND c.end_ns"


@query(f"WITH {CALLS}, {LEVELS} {CHANGES_IN_CALLS}")
def changes_in_call(spark, sf_dir):
    return E.changes_in_calls(event_calls(spark, sf_dir), _changes(spark, sf_dir)).select("func_call_id", "function", "var_name", "attr", "change_ns")


def _changes(spark, sf_dir):
    return level_changes(spark, sf_dir)


@query(
    f"""WITH {CALLS}, {LEVELS}, a AS ({CONTAINED}), b AS ({CHANGES_IN_CALLS})
SELECT parent_id AS func_call_id, 'call' AS event_kind, child AS what, count(*)::BIGINT AS n FROM a GROUP BY ALL
UNION ALL SELECT func_call_id, 'change', 'User.' || attr, count(*)::BIGINT FROM b GROUP BY ALL"""
)
def high_level_events(spark, sf_dir):
    return E.high_level_events(event_calls(spark, sf_dir), _changes(spark, sf_dir)).groupBy("func_call_id", "event_kind", "what").agg(F.count("*").alias("n"))


CONTEXTS = """
ev AS (SELECT user_id, event_id, event_type, epoch_us(ts) * 1000 AS t FROM events),
nx AS (SELECT *, min(CASE WHEN event_type = 'purchase' THEN t END) OVER w AS nxt_exit FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
ne AS (SELECT *, first(CASE WHEN event_type = 'view' THEN {'s': t, 'e': nxt_exit} END IGNORE NULLS) OVER w AS enter FROM nx WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
ctx AS (SELECT user_id, event_id AS init_id, enter.s AS start_ns, enter.e AS end_ns FROM ne WHERE event_type = 'signup' AND enter IS NOT NULL)"""


def user_contexts(spark, sf_dir):
    c = event_calls(spark, sf_dir).withColumn("time_ns", F.col("start_ns")).withColumn("event_id", F.col("func_call_id").cast("long")).drop("start_ns", "end_ns")
    return E.contexts(c, ["obj_id"], ["time_ns", "event_id"], "function = 'signup'", "function = 'view'", "function = 'purchase'")


@query(f"WITH {CONTEXTS} SELECT user_id, init_id, start_ns, end_ns FROM ctx")
def ctx_intervals(spark, sf_dir):
    return user_contexts(spark, sf_dir).select(F.col("obj_id").alias("user_id"), F.col("event_id").alias("init_id"), "start_ns", "end_ns")


@query(
    f"""WITH {CONTEXTS}, {CALLS}
SELECT c.func_call_id, count(*)::BIGINT AS n_active, max(x.init_id) AS last_init FROM calls c JOIN ctx x ON c.obj_id = x.user_id AND c.start_ns >= x.start_ns AND (x.end_ns IS NULL OR c.start_ns <= x.end_ns)
GROUP BY c.func_call_id"""
)
def active_ctx(spark, sf_dir):
    points = event_calls(spark, sf_dir).select("func_call_id", "obj_id", F.col("start_ns").alias("time_ns"))
    held = user_contexts(spark, sf_dir).select("obj_id", F.col("event_id").alias("init_id"), "start_ns", "end_ns")
    return E.active_contexts(points, held, ["obj_id"]).groupBy("func_call_id").agg(F.count("*").alias("n_active"), F.max("init_id").alias("last_init"))


@query(
    f"""WITH {CALLS} SELECT func_call_id, function, 'k' AS name, json_extract_string(args_json, '$.k') AS value_json FROM calls
UNION ALL SELECT func_call_id, function, 'mode', '"fast"' FROM calls WHERE function IN ('click', 'view')
UNION ALL SELECT func_call_id, function, 'depth', CASE WHEN event_id % 2 = 0 THEN '7' ELSE '1' END FROM calls WHERE function = 'click'"""
)
def bind_args(spark, sf_dir):
    c = event_calls(spark, sf_dir)
    k = F.get_json_object("args_json", "$.k")
    c = c.withColumn("args_json", F.concat(F.lit('{"0":'), k, F.lit("}"))).withColumn("kwargs_json", F.when(F.col("func_call_id").cast("long") % 2 == 0, F.lit('{"depth":7}')).otherwise(F.lit("{}")))
    rows = [(f, 0, "k", None) for f in ("click", "error", "purchase", "signup", "view")] + [("click", 1, "mode", '"fast"'), ("view", 1, "mode", '"fast"'), ("click", 2, "depth", "1")]
    return E.bind_arguments(c, spark.createDataFrame(rows, "function string, pos int, name string, default_json string"))


CAUSAL = """
seen AS (SELECT obj_id, (json_extract(args_json, '$.k')::BIGINT % 10)::VARCHAR AS var_name, min(start_ns) AS first_ns FROM calls GROUP BY ALL),
causal AS (SELECT c.func_call_id, c.function, c.process_id, c.start_ns, c.end_ns, s.var_name FROM calls c JOIN seen s ON c.obj_id = s.obj_id AND s.first_ns < c.start_ns)"""


def _record_calls(spark, sf_dir):
    return E.calls(event_records(spark, sf_dir).filter(F.col("type") != STATE))


@query(f"WITH {CALLS}, {CAUSAL} SELECT func_call_id, function, var_name, 'Parameter' AS var_type FROM causal")
def causal_vars(spark, sf_dir):
    return E.causal_vars(_record_calls(spark, sf_dir)).select("func_call_id", "function", "var_name", "var_type")


@query(
    f"""WITH {CALLS}, {LEVELS}, {CAUSAL} SELECT func_call_id, var_name FROM causal a WHERE NOT EXISTS (
  SELECT 1 FROM calls c JOIN changes v ON c.process_id = v.process_id AND v.change_ns BETWEEN c.start_ns AND c.end_ns WHERE c.func_call_id = a.func_call_id AND v.var_name = a.var_name)"""
)
def unchanged_vars(spark, sf_dir):
    c = _record_calls(spark, sf_dir)
    return E.unchanged_vars(c, E.causal_vars(c), _changes(spark, sf_dir)).select("func_call_id", "var_name")


@query(
    f"""WITH {CALLS}, b AS (SELECT process_id, thread_id, step, function, max(start_ns) AS s, min(end_ns) AS e FROM calls GROUP BY ALL)
SELECT a.thread_id, a.step, a.function AS func_a, b.function AS func_b, a.s > b.e OR b.s > a.e AS same_level
FROM b a JOIN b ON a.thread_id = b.thread_id AND a.step = b.step AND a.function <> b.function"""
)
def same_level(spark, sf_dir):
    return E.same_level(event_calls(spark, sf_dir), ["thread_id", "step"]).select("thread_id", "step", "func_a", "func_b", "same_level")


@query(
    f"""WITH {CALLS}, n AS (SELECT func_call_id, start_ns, end_ns, lead(start_ns) OVER w AS s2, lead(end_ns) OVER w AS e2 FROM calls WINDOW w AS (PARTITION BY thread_id ORDER BY start_ns, func_call_id))
SELECT func_call_id, round(CASE WHEN least(end_ns, e2) - greatest(start_ns, s2) <= 0 THEN 0 ELSE (least(end_ns, e2) - greatest(start_ns, s2))::DOUBLE / (greatest(end_ns, e2) - least(start_ns, s2)) END, 6) AS overlap
FROM n WHERE s2 IS NOT NULL"""
)
def liveness_overlap(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("thread_id").orderBy("start_ns", "func_call_id")
    n = event_calls(spark, sf_dir).withColumn("s2", F.lead("start_ns").over(w)).withColumn("e2", F.lead("end_ns").over(w)).filter("s2 IS NOT NULL")
    return n.select("func_call_id", F.round(overlap_share(F.col("start_ns"), F.col("end_ns"), F.col("s2"), F.col("e2")), 6).alias("overlap"))


@query(
    f"""WITH {LEVELS}, p AS (SELECT var_name, max(time_ns) AS before_ns FROM lv GROUP BY 1) SELECT lv.var_name, count(*)::BIGINT AS n_before, max(time_ns) AS last_ns
FROM lv JOIN p USING (var_name) WHERE time_ns < before_ns GROUP BY 1"""
)
def states_before(spark, sf_dir):
    v = levels(spark, sf_dir)
    points = v.groupBy("trace_id", "var_name").agg(F.max("time_ns").alias("before_ns"))
    return E.states_before(v, points).groupBy("var_name").agg(F.count("*").alias("n_before"), F.max("time_ns").alias("last_ns"))


@query(f"WITH {CALLS} SELECT function, step, count(*)::BIGINT AS n FROM calls GROUP BY ALL")
def calls_by_step(spark, sf_dir):
    return event_calls(spark, sf_dir).groupBy("function", "step").agg(F.count("*").alias("n"))


