"""Queries over preconditions, lifecycle, reports, scalars and differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from invarium.functions import values as V
from invarium.operators import diff as D
from invarium.operators import preconditions as P
from invarium.operators.relations.order import cover_examples, merged_chains
from invarium.plans import infer as I
from invarium.plans import report as R
from invarium.plans.check import check
from invarium.queries.registry import CALLS, query
from invarium.queries.relations import COVER, LEAD, _pairs
from invarium.sources.tables import event_calls, load
from invarium.streaming.online import dedup_pairs, sampled

# -- preconditions: two-record examples out of orders, each order of a customer with the next one ------

FIELDS_SQL = """
o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders ),
nx AS (SELECT a.o_custkey, a.o_orderkey AS example_id, unnest([0, 1]) AS record_pos, a.rn FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND b.rn = a.rn + 1),
x AS (SELECT (nx.o_custkey % 300)::BIGINT AS hyp_id, nx.example_id, nx.o_custkey % 5 < 3 AS positive, nx.record_pos::BIGINT AS record_pos, o.o_orderstatus, o.o_orderpriority, o.o_orderkey, o.o_custkey FROM nx JOIN o ON o.o_custkey = nx.o_custkey AND o.rn = nx.rn + nx.record_pos),
f AS (
  SELECT hyp_id, example_id, positive, record_pos, 'attributes.status' AS field, '"' || o_orderstatus || '"' AS value_json FROM x
  UNION ALL SELECT hyp_id, example_id, positive, record_pos, 'meta_vars.prio', '"' || o_orderpriority || '"' FROM x
  UNION ALL SELECT hyp_id, example_id, positive, record_pos, 'meta_vars.odd', CASE WHEN o_orderkey % 2 = 1 THEN 'true' ELSE 'false' END FROM x
  UNION ALL SELECT hyp_id, example_id, positive, record_pos, 'attributes.key', o_orderkey::VARCHAR FROM x WHERE o_orderkey % 7 <> 0
)"""


def _fields(spark, sf_dir):
    from pyspark.sql import Window

    o = load(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    # an order is the first record of its own example and the second one of the order before it
    o = o.withColumn("before", F.lag("o_orderkey").over(w)).withColumn("after", F.lead("o_orderkey").over(w))
    first = F.when(F.col("after").isNotNull(), F.struct(F.col("o_orderkey").alias("example_id"), F.lit(0).cast("long").alias("record_pos")))
    second = F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("example_id"), F.lit(1).cast("long").alias("record_pos")))
    o = o.withColumn("as", F.explode(F.array_compact(F.array(first, second)))).select("*", "as.*")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    made = F.create_map(
        F.lit("attributes.status"), quoted("o_orderstatus"), F.lit("meta_vars.prio"), quoted("o_orderpriority"), F.lit("meta_vars.odd"), (F.col("o_orderkey") % 2 == 1).cast("string"),
        F.lit("attributes.key"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey").cast("string")),
    )
    rows = o.select((F.col("o_custkey") % 300).cast("long").alias("hyp_id"), "example_id", (F.col("o_custkey") % 5 < 3).alias("positive"), "record_pos", F.explode(made).alias("field", "value_json"))
    return rows.filter("value_json IS NOT NULL")


LOCAL_SQL = """
l AS (SELECT hyp_id, example_id, positive, field, CASE WHEN count(DISTINCT value_json) = 1 THEN 'constant' ELSE 'unequal' END AS clause, CASE WHEN count(DISTINCT value_json) = 1 THEN min(value_json) END AS value_json
  FROM f GROUP BY ALL HAVING count(DISTINCT record_pos) = 2)"""


@query(f"WITH {FIELDS_SQL}, {LOCAL_SQL} SELECT hyp_id, example_id, positive, field, clause, value_json FROM l")
def local_clauses(spark, sf_dir):
    return P.local_clauses(P.usable(_fields(spark, sf_dir))).select("hyp_id", "example_id", "positive", "field", "clause", "value_json")


MERGED_SQL = """
c AS (SELECT hyp_id, field, list_sort(list(DISTINCT value_json)) AS v, CASE WHEN field = 'meta_vars.odd' THEN 'bool' WHEN field = 'attributes.key' THEN 'int' ELSE 'str' END AS k FROM l WHERE positive AND clause = 'constant' GROUP BY 1, 2),
m AS (
  SELECT hyp_id, 'consistent' AS clause, field, []::VARCHAR[] AS vals FROM c WHERE k <> 'bool' AND len(v) > CASE k WHEN 'str' THEN 4 ELSE 1 END
  UNION ALL SELECT hyp_id, 'constant', field, [unnest(v)] FROM c WHERE k = 'bool' OR len(v) <= CASE k WHEN 'str' THEN 4 ELSE 1 END
  UNION ALL SELECT hyp_id, 'constant', field, v FROM c WHERE k <> 'bool' AND len(v) > 1 AND len(v) <= CASE k WHEN 'str' THEN 4 ELSE 1 END
  UNION ALL SELECT DISTINCT hyp_id, clause, field, []::VARCHAR[] FROM l WHERE positive AND clause = 'unequal'
), merged AS (SELECT hyp_id, clause || '|' || field || '|' || array_to_string(vals, ',') AS clause_id, clause, field, vals FROM m)"""


@query(f"WITH {FIELDS_SQL}, {LOCAL_SQL}, {MERGED_SQL} SELECT hyp_id, clause_id, clause, field FROM merged")
def merged_clauses(spark, sf_dir):
    return P.merged_clauses(P.local_clauses(P.usable(_fields(spark, sf_dir)))).select("hyp_id", "clause_id", "clause", "field")


EVAL_SQL = """
e AS (SELECT DISTINCT hyp_id, example_id, positive FROM f),
b AS (SELECT hyp_id, example_id, field, count(DISTINCT record_pos) AS n_with, list(DISTINCT value_json) AS own FROM f GROUP BY 1, 2, 3),
t AS (SELECT e.hyp_id, e.example_id, e.positive, m.clause_id, coalesce(CASE m.clause WHEN 'consistent' THEN n_with = 2 AND len(own) = 1 WHEN 'unequal' THEN n_with = 2 AND len(own) = 2
  ELSE n_with = 2 AND len(own) = 1 AND list_contains(m.vals, own[1]) END, false) AS holds FROM e JOIN merged m ON e.hyp_id = m.hyp_id LEFT JOIN b ON b.hyp_id = e.hyp_id AND b.example_id = e.example_id AND b.field = m.field)"""
CLAUSES_SQL = f"{FIELDS_SQL}, {LOCAL_SQL}, {MERGED_SQL}, {EVAL_SQL}"


def _tested(spark, sf_dir):
    f = _fields(spark, sf_dir)
    return P.evaluated(f, P.merged_clauses(P.local_clauses(P.usable(f))))


@query(f"WITH {CLAUSES_SQL} SELECT * FROM t")
def clause_eval(spark, sf_dir):
    return _tested(spark, sf_dir)


@query(f"WITH {CLAUSES_SQL} SELECT hyp_id, clause_id, count(*) FILTER (WHERE NOT positive AND NOT holds) > 0 AS useful FROM t GROUP BY 1, 2 HAVING bool_and(holds) FILTER (WHERE positive)")
def base_clauses(spark, sf_dir):
    return P.base_clauses(_tested(spark, sf_dir))


@query(
    f"""WITH {CLAUSES_SQL}, u AS (SELECT hyp_id, clause_id FROM t GROUP BY 1, 2 HAVING bool_and(holds) FILTER (WHERE positive) AND count(*) FILTER (WHERE NOT positive AND NOT holds) > 0),
p AS (SELECT t.hyp_id, example_id, bool_and(holds) AS passes FROM t JOIN u USING (hyp_id, clause_id) WHERE NOT positive GROUP BY 1, 2),
n AS (SELECT hyp_id, count(DISTINCT example_id) FILTER (WHERE NOT positive)::BIGINT AS n_negative FROM t GROUP BY 1), q AS (SELECT hyp_id, count(*) FILTER (WHERE passes)::BIGINT AS k FROM p GROUP BY 1)
SELECT n.hyp_id, n_negative, coalesce(k, n_negative) AS n_passing, CASE WHEN n_negative = 0 THEN 'unconditional' WHEN k = 0 THEN 'conjunction' ELSE 'search' END AS verdict FROM n LEFT JOIN q USING (hyp_id)"""
)
def precond_verdicts(spark, sf_dir):
    return P.verdicts(_tested(spark, sf_dir))


@query()
def precond_search(spark, sf_dir):
    return P.learned(_tested(spark, sf_dir))


@query(
    "WITH c AS (SELECT o_orderkey AS example_id, o_custkey % 3 AS hyp_id, o_orderstatus = 'F' AS positive FROM orders) SELECT hyp_id, positive, least(count(*), 300)::BIGINT AS n FROM c GROUP BY 1, 2"
)
def cap_examples(spark, sf_dir):
    ex = load(spark, sf_dir, "orders").select((F.col("o_custkey") % 3).alias("hyp_id"), F.col("o_orderkey").alias("example_id"), (F.col("o_orderstatus") == "F").alias("positive"))
    return P.capped(ex, 300).groupBy("hyp_id", "positive").agg(F.count("*").alias("n"))


SETS_SQL = """
s AS (SELECT c_custkey % 30 AS hyp_id, c_custkey AS conj_id, list_distinct(['a' || c_custkey % 2, 'b' || c_custkey % 3, CASE WHEN c_custkey % 5 = 0 THEN 'a' || c_custkey % 2 ELSE 'c' || c_custkey % 4 END]) AS clauses FROM customer)"""


def _sets(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    name = lambda p, n: F.concat(F.lit(p), (k % n).cast("string"))
    return c.select((k % 30).alias("hyp_id"), k.alias("conj_id"), F.array_distinct(F.array(name("a", 2), name("b", 3), F.when(k % 5 == 0, name("a", 2)).otherwise(name("c", 4)))).alias("clauses"))


@query(
    f"""WITH {SETS_SQL} SELECT DISTINCT a.hyp_id, a.conj_id FROM s a JOIN s b ON a.hyp_id = b.hyp_id AND a.conj_id <> b.conj_id
WHERE len(list_intersect(a.clauses, b.clauses)) = len(b.clauses) AND (len(b.clauses) < len(a.clauses) OR b.conj_id < a.conj_id)"""
)
def implied(spark, sf_dir):
    return P.implied(_sets(spark, sf_dir))


@query(
    f"""WITH {SETS_SQL}, t AS (SELECT (o_custkey % 30) AS hyp_id, o_orderkey AS example_id, ['a' || o_orderkey % 2, 'b' || o_orderkey % 3, 'c' || o_orderkey % 4] AS holds FROM orders WHERE o_orderstatus = 'P')
SELECT s.hyp_id, s.conj_id, t.example_id FROM s JOIN t ON s.hyp_id = t.hyp_id AND len(list_intersect(s.clauses, t.holds)) = len(s.clauses)"""
)
def unsafe_precond(spark, sf_dir):
    o = load(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    k = F.col("o_orderkey")
    name = lambda p, n: F.concat(F.lit(p), (k % n).cast("string"))
    tested = o.select((F.col("o_custkey") % 30).alias("hyp_id"), k.alias("example_id"), F.lit(False).alias("positive"), F.explode(F.array(name("a", 2), name("b", 3), name("c", 4))).alias("clause_id"), F.lit(True).alias("holds"))
    return P.unsafe(tested, _sets(spark, sf_dir))


# -- lifecycle ----------------------------------------------------------------------------------------

PAIRS = (("click", "view"), ("view", "purchase"), ("error", "signup"))


def _cover(spark, sf_dir):
    ex = cover_examples(event_calls(spark, sf_dir), _pairs(spark, *PAIRS))
    return ex.withColumn("relation", F.lit("cover")).withColumn("hyp_id", F.concat_ws("|", "relation", "first", "second")).withColumn("trace_id", F.concat(F.lit("t"), (F.col("step") % 2).cast("string")))


COVERS = " UNION ALL ".join(f"SELECT '{a}' AS first, '{b}' AS second, step, func_call_id, positive FROM (WITH {COVER.replace(chr(39) + 'view' + chr(39), chr(39) + b + chr(39)).replace(chr(39) + 'click' + chr(39), chr(39) + a + chr(39)).replace('SELECT func_call_id, EXISTS', 'SELECT func_call_id, step, EXISTS')})" for a, b in PAIRS)
HYPS = f"{CALLS}, ex AS ({COVERS}), h AS (SELECT first, second, count(*) FILTER (WHERE positive)::BIGINT AS n_positive, count(*) FILTER (WHERE NOT positive)::BIGINT AS n_negative FROM ex GROUP BY 1, 2)"


@query(f"WITH {HYPS} SELECT * FROM h")
def hyp_merge(spark, sf_dir):
    return I.merged(_cover(spark, sf_dir)).select("first", "second", "n_positive", "n_negative")


@query(f"WITH {HYPS} SELECT first, second FROM h WHERE n_positive >= 400")
def hyp_prune(spark, sf_dir):
    return I.pruned(I.merged(_cover(spark, sf_dir)), 400).select("first", "second")


@query(f"WITH {HYPS} SELECT first, second, round(1 / (1 + exp(-0.1 * (n_positive - n_negative))), 6) AS likelihood FROM h")
def likelihood(spark, sf_dir):
    return I.merged(_cover(spark, sf_dir)).select("first", "second", F.round("likelihood", 6).alias("likelihood"))


@query(
    """WITH p AS (SELECT DISTINCT o_custkey AS h, o_orderkey % 11 AS t FROM orders), h AS (SELECT DISTINCT h FROM p), t AS (SELECT DISTINCT o_orderkey % 11 AS t FROM orders)
SELECT h.h AS hyp_id, t.t AS trace_id FROM h, t WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.h = h.h AND p.t = t.t)"""
)
def cross_trace_todo(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("hyp_id"), (F.col("o_orderkey") % 11).alias("trace_id")).distinct()
    return I.still_to_collect(o, o.select("trace_id").distinct())


def _arguments(spark, sf_dir):
    k = F.col("l_orderkey")
    made = F.create_map(F.lit("flag"), F.col("l_returnflag"), F.lit("mod"), (k % 6).cast("string"), F.lit("sup"), F.when(k % 4 != 0, (F.col("l_suppkey") % 2).cast("string")))
    li = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_returnflag").alias("l_returnflag"), F.min("l_suppkey").alias("l_suppkey"))
    return li.select((k % 300).alias("hyp_id"), k.alias("event_id"), F.explode(made).alias("name", "value_json")).filter("value_json IS NOT NULL")


ARGS_SQL = """
li AS (SELECT l_orderkey, min(l_returnflag) AS f, min(l_suppkey) AS s FROM lineitem GROUP BY 1),
a AS (SELECT l_orderkey % 300 AS hyp_id, l_orderkey AS event_id, 'flag' AS name, f AS value_json FROM li UNION ALL SELECT l_orderkey % 300, l_orderkey, 'mod', (l_orderkey % 6)::VARCHAR FROM li
  UNION ALL SELECT l_orderkey % 300, l_orderkey, 'sup', (s % 2)::VARCHAR FROM li WHERE l_orderkey % 4 <> 0),
r AS (SELECT hyp_id, name, min(value_json) AS value_json FROM a GROUP BY 1, 2 HAVING min(value_json) = max(value_json) AND count(*) = (SELECT count(DISTINCT event_id) FROM a b WHERE b.hyp_id = a.hyp_id))"""


@query(f"WITH {ARGS_SQL} SELECT hyp_id, name, value_json FROM r")
def arg_intersection(spark, sf_dir):
    return I.common_arguments(_arguments(spark, sf_dir))


@query(
    """WITH li AS (SELECT l_orderkey, min(l_returnflag) AS f FROM lineitem GROUP BY 1) SELECT l_orderkey % 300 AS hyp_id, l_orderkey AS event_id FROM li WHERE f <> 'A'"""
)
def arg_violation(spark, sf_dir):
    required = spark.range(300).select(F.col("id").alias("hyp_id"), F.lit("flag").alias("name"), F.lit("A").alias("value_json"))
    return I.argument_violations(required, _arguments(spark, sf_dir))


@query()
def chains(spark, sf_dir):
    pairs = I.merged(_cover(spark, sf_dir)).filter("n_positive > 0").select("first", "second").collect()  # pairs of function names
    return spark.createDataFrame([(" > ".join(c), len(c)) for c in merged_chains([tuple(p) for p in pairs])], "chain string, length long")


@query(
    """SELECT relation, first, second, sha256('{"relation":"' || relation || '","first":"' || first || '","second":"' || second || '"}') AS inv_id
FROM (SELECT DISTINCT 'lead' AS relation, o_orderstatus AS first, o_orderpriority AS second FROM orders)"""
)
def inv_identity(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(F.lit("lead").alias("relation"), F.col("o_orderstatus").alias("first"), F.col("o_orderpriority").alias("second")).distinct()
    return o.withColumn("inv_id", I.identity(F.col("relation"), F.col("first"), F.col("second")))


@query()
def infer_invariants(spark, sf_dir):
    return I.infer(event_calls(spark, sf_dir), run_limit=20)


CHECKED = [
    ("contain", "purchase", "click", '"Unconditional"'), ("cover", "click", "view", '"Unconditional"'), ("lead", "view", "click", '"Unconditional"'),
    ("cover", "error", "signup", '[["constant|meta_vars.stage|\\"training\\""]]'), ("contain", "refund", "click", '"Unconditional"'),
]


def _invariants(spark):
    rows = spark.createDataFrame([(f"{r} {a} {b}", r, a, b, False, p) for r, a, b, p in CHECKED], "text_description string, relation string, first string, second string, inverted boolean, precondition string")
    return rows.withColumn("hyp_id", F.concat_ws("|", "relation", "first", "second")).withColumn("inv_id", I.identity(F.col("relation"), F.col("first"), F.col("second")))


def _verdicts(which: str, sql: str, where: str = "true") -> str:
    return f"SELECT '{which}' AS label, count(*) FILTER (WHERE NOT positive) = 0 AS passed, count(*) > 0 AS triggered, count(*) FILTER (WHERE NOT positive)::BIGINT AS n_violations FROM (WITH {sql}) WHERE {where}"


@query(
    f"WITH {CALLS} "
    + _verdicts("contain purchase click", "p AS (SELECT * FROM calls WHERE function = 'purchase') SELECT EXISTS (SELECT 1 FROM calls k WHERE k.function = 'click' AND k.process_id = p.process_id AND k.thread_id = p.thread_id AND k.start_ns > p.start_ns AND k.end_ns < p.end_ns) AS positive FROM p")
    + " UNION ALL " + _verdicts("cover click view", COVER) + " UNION ALL " + _verdicts("lead view click", LEAD)
    + " UNION ALL " + _verdicts("cover error signup", COVER.replace("function = 'view'", "function = 'signup' AND stage = 'training'").replace("'click'", "'error'"))
    + " UNION ALL SELECT 'contain refund click', true, false, 0"
)
def check_invariants(spark, sf_dir):
    out = check(event_calls(spark, sf_dir), _invariants(spark))
    return out.select("label", "passed", "triggered", "n_violations")


# -- reports: every customer's orders as one checked invariant ----------------------------------------

RESULTS_SQL = """
res AS (SELECT 't' || o_custkey % 3 AS trace_id, o_custkey AS inv_id, 'inv ' || o_custkey % 40 AS label, 'R' || o_custkey % 4 AS relation, bool_and(o_orderstatus <> 'P') AS passed, count(*) > 2 AS triggered,
  CASE WHEN o_custkey % 10 = 0 THEN []::BIGINT[] ELSE list_sort(list(CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey % 50 END)) END AS steps FROM orders GROUP BY o_custkey)"""


def _results(spark, sf_dir):
    k = F.col("o_custkey")
    g = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.bool_and(F.col("o_orderstatus") != "P").alias("passed"), (F.count("*") > 2).alias("triggered"), F.collect_list(F.struct(F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderkey") % 50).alias("s"))).alias("all"))
    steps = F.when(k % 10 == 0, F.array().cast("array<bigint>")).otherwise(F.col("all.s"))
    return g.select(F.concat(F.lit("t"), (k % 3).cast("string")).alias("trace_id"), k.alias("inv_id"), F.concat(F.lit("inv "), (k % 40).cast("string")).alias("label"), F.concat(F.lit("R"), (k % 4).cast("string")).alias("relation"), "passed", "triggered", steps.alias("steps"))


@query(
    f"""WITH {RESULTS_SQL} SELECT (count(*) FILTER (WHERE NOT passed) + count(*) FILTER (WHERE NOT triggered) + count(*) FILTER (WHERE passed AND triggered))::BIGINT AS total, count(*) FILTER (WHERE NOT passed)::BIGINT AS failed,
count(*) FILTER (WHERE passed AND triggered)::BIGINT AS passed, count(*) FILTER (WHERE NOT triggered)::BIGINT AS not_triggered, (count(*) FILTER (WHERE NOT passed) + count(*) FILTER (WHERE passed AND triggered))::BIGINT AS triggered FROM res"""
)
def status_counts(spark, sf_dir):
    return R.status_counts(_results(spark, sf_dir))


_BY = "count(*) FILTER (WHERE NOT passed)::BIGINT AS failed, count(*) FILTER (WHERE passed AND triggered)::BIGINT AS passed, count(*) FILTER (WHERE passed AND NOT triggered)::BIGINT AS not_triggered"


@query(f"WITH {RESULTS_SQL} SELECT relation, {_BY} FROM res GROUP BY 1")
def by_relation(spark, sf_dir):
    return R.by_relation(_results(spark, sf_dir))


@query(f"WITH {RESULTS_SQL} SELECT trace_id, relation, {_BY} FROM res GROUP BY ROLLUP (trace_id, relation)")
def rollup(spark, sf_dir):
    return R.rolled_up(_results(spark, sf_dir))


@query(
    f"""WITH {RESULTS_SQL} SELECT label, relation, count(*)::BIGINT AS count, min(list_min(steps)) AS first_step, max(list_max(steps)) AS last_step FROM res WHERE NOT passed GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10"""
)
def top_violations(spark, sf_dir):
    return R.top_violations(_results(spark, sf_dir))


@query(f"WITH {RESULTS_SQL}, s AS (SELECT label, unnest(steps) AS step FROM res WHERE NOT passed) SELECT step, count(DISTINCT label)::BIGINT AS n_invariants FROM s WHERE step IS NOT NULL GROUP BY 1")
def violation_steps(spark, sf_dir):
    return R.violation_steps(_results(spark, sf_dir))


@query(
    f"""WITH {RESULTS_SQL} SELECT trace_id, inv_id, label AS display_name, relation AS relation_type, list_min(steps) AS first_step, list_max(steps) AS last_step, greatest(len(steps), 1)::BIGINT AS occurrences FROM res WHERE NOT passed"""
)
def summary(spark, sf_dir):
    return R.summary(_results(spark, sf_dir))


@query(f"WITH {RESULTS_SQL} SELECT min(list_min(steps)) AS first_violation_step, count(*)::BIGINT AS distinct_invariants_violated FROM res WHERE NOT passed")
def violation_overview(spark, sf_dir):
    return R.overview(_results(spark, sf_dir))


@query("SELECT o_orderkey AS last_step, (least(o_orderkey, 10) + floor(greatest(o_orderkey - 10, 0) / 10.0))::BIGINT AS checked FROM orders")
def checked_steps(spark, sf_dir):
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("last_step"), R.checked_steps(F.col("o_orderkey"), F.lit(10), F.lit(10)).cast("long").alias("checked"))


@query(f"WITH {RESULTS_SQL} SELECT relation, count(*)::BIGINT AS n FROM res GROUP BY 1")
def invs_per_relation(spark, sf_dir):
    return R.per_relation(_results(spark, sf_dir))


@query(
    f"""WITH {CALLS}, b AS (SELECT min(start_ns) AS lo, max(end_ns) AS hi FROM calls) SELECT function AS inv_id, max(end_ns) AS detected_ns, round((max(end_ns) - any_value(lo))::DOUBLE / (any_value(hi) - any_value(lo)), 6) AS detected_pct FROM calls, b WHERE step < 5 GROUP BY 1"""
)
def detection_time(spark, sf_dir):
    c = event_calls(spark, sf_dir)
    bounds = c.groupBy("trace_id").agg(F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"))
    found = R.detection(c.filter("step < 5").select("trace_id", F.col("function").alias("inv_id"), F.col("end_ns").alias("time_ns")), bounds)
    return found.select("inv_id", "detected_ns", F.round("detected_pct", 6).alias("detected_pct"))


# -- streaming operators that also run in batch -------------------------------------------------------


@query("SELECT o_orderkey AS step, o_orderkey < 10 OR (o_orderkey - 10) % 7 = 0 AS looked_at FROM orders")
def sampling_policy(spark, sf_dir):
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("step"), sampled(F.col("o_orderkey"), 7, 10).alias("looked_at"))


@query("SELECT DISTINCT l_suppkey % 5 AS inv_id, least(l_partkey, l_orderkey) AS lo, greatest(l_partkey, l_orderkey) AS hi FROM lineitem")
def dedup_record_pairs(spark, sf_dir):
    v = load(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 5).alias("inv_id"), F.col("l_partkey").alias("a"), F.col("l_orderkey").alias("b"))
    return dedup_pairs(v, "a", "b").select("inv_id", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))


# -- scalars and differences --------------------------------------------------------------------------


@query(
    """WITH v AS (SELECT o_custkey % 60 AS g, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE (o_orderkey % 7 - o_custkey % 60 % 8) END AS n FROM orders)
SELECT g, count(DISTINCT coalesce(n::VARCHAR, 'null'))::BIGINT AS n_values, CASE WHEN min(n) > 0 THEN 'above_zero' WHEN min(n) >= 0 THEN 'non_negative' WHEN max(n) < 0 THEN 'below_zero' WHEN max(n) <= 0 THEN 'non_positive'
  WHEN count(*) FILTER (WHERE n = 0) = 0 THEN 'non_zero' WHEN count(*) FILTER (WHERE n IS NULL) = 0 THEN 'non_none' ELSE 'anything' END AS symbol FROM v GROUP BY 1"""
)
def generalize(spark, sf_dir):
    g = F.col("o_custkey") % 60
    value = F.when(F.col("o_orderkey") % 13 == 0, "null").otherwise((F.col("o_orderkey") % 7 - g % 8).cast("string"))
    return load(spark, sf_dir, "orders").select(g.alias("g"), value.alias("v")).groupBy("g").agg(*V.generalized(F.col("v")))


@query(
    """WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey % 7 - 3 END AS n FROM orders), s AS (SELECT unnest(['above_zero', 'below_zero', 'non_positive', 'non_negative', 'non_zero', 'non_none', 'anything']) AS symbol)
SELECT symbol, count(*) FILTER (WHERE CASE symbol WHEN 'above_zero' THEN coalesce(n > 0, false) WHEN 'below_zero' THEN coalesce(n < 0, false) WHEN 'non_positive' THEN coalesce(n <= 0, true) WHEN 'non_negative' THEN coalesce(n >= 0, true)
  WHEN 'non_zero' THEN coalesce(n <> 0, false) WHEN 'non_none' THEN n IS NOT NULL ELSE true END)::BIGINT AS n_matching FROM v, s GROUP BY 1"""
)
def symbolic_match(spark, sf_dir):
    value = F.when(F.col("o_orderkey") % 13 == 0, "null").otherwise((F.col("o_orderkey") % 7 - 3).cast("string"))
    rows = load(spark, sf_dir, "orders").select(value.alias("v"), F.explode(F.array(*[F.lit(c) for c in V.CLASSES])).alias("symbol"))
    return rows.groupBy("symbol").agg(F.count_if(V.matches(F.col("symbol"), F.col("v"))).alias("n_matching"))


@query("SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS n, count(*) FILTER (WHERE l_discount = l_tax)::BIGINT AS n_close FROM lineitem GROUP BY 1, 2")
def fp_close(spark, sf_dir):
    near = V.close(F.col("l_discount"), F.col("l_tax") + 1e-10)
    return load(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.count_if(near).alias("n_close"))


@query(
    "SELECT o_orderkey, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM (SELECT o_orderkey, [o_orderkey % 3, o_orderkey % 5, o_orderkey % 7] AS a, [o_custkey % 3, o_custkey % 5, o_custkey % 7] AS b FROM orders)"
)
def jaccard(spark, sf_dir):
    mods = lambda c: F.array(*[F.col(c) % m for m in (3, 5, 7)])
    return load(spark, sf_dir, "orders").select("o_orderkey", F.round(V.jaccard(mods("o_orderkey"), mods("o_custkey")), 6).alias("jaccard"))


@query(
    r"""WITH n AS (SELECT p_partkey, replace(p_name, ' ', '.') || CASE p_partkey % 3 WHEN 0 THEN '.Opt.step' WHEN 1 THEN '' ELSE '.nn.Module' END AS name FROM part)
SELECT p_partkey, CASE WHEN regexp_extract(name, '(?:^|\.)(\p{Lu}[^.]*(?:\..*)?)$', 1) <> '' THEN regexp_extract(name, '(?:^|\.)(\p{Lu}[^.]*(?:\..*)?)$', 1)
  WHEN len(string_split(name, '.')) >= 2 THEN array_to_string(string_split(name, '.')[-2:], '.') ELSE name END AS short, regexp_replace('_PART_' || name, '^_[A-Z]+_', '') AS attr FROM n"""
)
def short_name(spark, sf_dir):
    k = F.col("p_partkey") % 3
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit(".")), F.when(k == 0, ".Opt.step").when(k == 1, "").otherwise(".nn.Module"))
    return load(spark, sf_dir, "part").select("p_partkey", V.short_name(name).alias("short"), V.display_attribute(F.concat(F.lit("_PART_"), name)).alias("attr"))


@query("SELECT p_partkey, levenshtein(p_brand, p_type)::BIGINT AS distance FROM part")
def edit_distance(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", F.levenshtein("p_brand", "p_type").cast("long").alias("distance"))


DIFF_SQL = """
f AS (SELECT o_custkey % 200 AS g, o_orderkey, row_number() OVER (PARTITION BY o_custkey % 200 ORDER BY o_orderkey) AS rn, o_orderstatus AS status, o_orderpriority AS prio FROM orders),
p AS (SELECT a.g, a.rn AS no, a.status AS s1, b.status AS s2, a.prio AS p1, b.prio AS p2, b.o_orderkey::VARCHAR AS k2 FROM f a JOIN f b ON a.g = b.g AND b.rn = a.rn + 1)"""


@query(
    f"""WITH {DIFF_SQL} SELECT g, no, 'status' AS path, s1 AS left_json, s2 AS right_json, CASE WHEN s1 IS NULL THEN 'added' WHEN s2 IS NULL THEN 'removed' ELSE 'changed' END AS change FROM p WHERE s1 IS DISTINCT FROM s2
UNION ALL SELECT g, no, 'prio', p1, p2, CASE WHEN p1 IS NULL THEN 'added' WHEN p2 IS NULL THEN 'removed' ELSE 'changed' END FROM p WHERE p1 IS DISTINCT FROM p2
UNION ALL SELECT g, no, 'order_id', NULL, k2, 'added' FROM p WHERE k2 IS NOT NULL"""
)
def diff_dicts(spark, sf_dir):
    from pyspark.sql import Window

    o = load(spark, sf_dir, "orders").withColumn("g", F.col("o_custkey") % 200)
    w = Window.partitionBy("g").orderBy("o_orderkey")
    o = o.withColumn("rn", F.row_number().over(w).cast("long")).withColumn("more", F.lead("o_orderkey").over(w).isNotNull())
    made = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("prio"), F.col("o_orderpriority"), F.lit("order_id"), F.col("o_orderkey").cast("string"))
    left = o.filter("more").select("g", F.col("rn").alias("no"), F.explode(made).alias("path", "value_json"))
    right = o.filter("rn > 1").select("g", (F.col("rn") - 1).alias("no"), F.explode(made).alias("path", "value_json"))
    return D.diff_fields(left, right, ["g", "no"])


@query(f"WITH {DIFF_SQL} SELECT g, 3 * count(*)::BIGINT AS n_leaves FROM f GROUP BY 1")
def count_leaves(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    rows = o.select((F.col("o_custkey") % 200).alias("g"), F.explode(F.create_map(F.lit("a"), F.col("o_orderstatus"), F.lit("b"), F.col("o_orderpriority"), F.lit("c"), F.col("o_orderkey").cast("string"))).alias("path", "value_json"))
    return D.count_leaves(rows, ["g"])


def _sides(spark, sf_dir):
    from pyspark.sql import Window

    e = load(spark, sf_dir, "events").withColumn("g", F.col("event_type")).withColumn("odd", F.col("user_id") % 2)
    e = e.withColumn("no", F.row_number().over(Window.partitionBy("g", "odd").orderBy("event_id")).cast("long"))
    made = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("v"), F.floor(F.col("value") / 50).cast("string"), F.lit("event_id"), F.col("event_id").cast("string"))
    rows = e.select("g", "odd", "no", made.alias("fields"))
    return rows.filter("odd = 0").drop("odd"), rows.filter("odd = 1").drop("odd")


@query()
def best_match(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return D.best_matches(left, right, ["g"])


@query()
def trace_edits(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return D.edits(D.best_matches(left, right, ["g"]), left, right, ["g"], limit=1)


@query(
    r"""WITH l AS (SELECT o_orderkey % 2 AS side, o_orderpriority || ' at ' || o_orderkey % 100 || CASE WHEN o_orderkey % 302 = 1 THEN ' lost' ELSE '' END AS line FROM orders), n AS (SELECT side, regexp_replace(line, '\d+', '0', 'g') AS pattern FROM l)
SELECT pattern, count(*)::BIGINT AS n FROM n WHERE side = 1 AND pattern NOT IN (SELECT pattern FROM n WHERE side = 0) GROUP BY 1"""
)
def anomaly_set(spark, sf_dir):
    k = F.col("o_orderkey")
    lines = load(spark, sf_dir, "orders").select((k % 2).alias("side"), F.concat("o_orderpriority", F.lit(" at "), (k % 100).cast("string"), F.when(k % 302 == 1, " lost").otherwise("")).alias("line"))
    return D.anomalies(lines.filter("side = 0"), lines.filter("side = 1")).select("pattern", "n")
