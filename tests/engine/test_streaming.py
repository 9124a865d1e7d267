"""Online checks equal batch checks; growing files are followed."""

import json

from pyspark.sql import functions as F

from invarium.queries import QUERIES
from invarium.streaming import online as O

SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r.func_call_id for r in df.select("func_call_id").collect())


def test_online_equals_batch(spark):
    assert ids(QUERIES["online_contain"](spark, SF)) == ids(QUERIES["contain_api"](spark, SF))
    for name in ("cover", "lead"):
        assert ids(QUERIES[f"online_{name}"](spark, SF)) == ids(QUERIES[name](spark, SF).filter("NOT positive"))


def test_tail_follows_appends(spark, tmp_path):
    def line(t):
        return json.dumps({"time": t, "type": "function_call (pre)", "process_id": 1, "thread_id": 1, "func_call_id": str(t), "function": "f", "meta_vars": {"step": t}}) + "\n"

    (tmp_path / "live").mkdir()
    f = tmp_path / "live" / "trace_1"
    f.write_text(line(1) + line(2) + line(3)[:10])
    got = []
    q = O.tail_stream(spark, str(tmp_path / "live")).writeStream.foreachBatch(lambda df, _: got.extend(sorted((r.time_ns, r.step) for r in df.collect()))).option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        assert got == [(1, 1), (2, 2)]
        with f.open("a") as out:
            out.write(line(3)[10:] + line(4))
        (tmp_path / "live" / "trace_2").write_text(line(9))
        q.processAllAvailable()
        assert sorted(got) == [(1, 1), (2, 2), (3, 3), (4, 4), (9, 9)]
    finally:
        q.stop()


def test_file_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "trace_1.json").write_text('{"time":1,"type":"state_change","attributes":{"a":1},"meta_vars":{}}\n')
    got = []
    q = O.file_stream(spark, str(tmp_path / "in")).writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.attributes for r in got] == [{"a": "1"}]


def test_sampling_policy(spark):
    on = lambda step, interval, warm: spark.range(1).select(O.sampled(F.lit(step), interval, warm).alias("x")).first().x
    assert [s for s in range(1, 5) if on(s, 2, 0)] == [2, 4]
    assert [s for s in (0, 1, 2, 3, 12) if on(s, 10, 2)] == [0, 1, 2, 12]


def test_details_routes_and_pairs(spark):
    v = spark.createDataFrame([("i", "a", "b", 5, 1), ("i", "b", "a", 5, 2), ("i", "c", "d", 7, 0)], "inv_id string, func_call_id string, other string, step long, time_ns long")
    assert O.dedup_pairs(v, "func_call_id", "other").count() == 2
    d = O.detail(v, 1).first()
    assert (d.n, d.sample, d.steps) == (3, "c", [5])
    inv = spark.createDataFrame([("i", "cover", "a", "b"), ("j", "contain", "c", "d")], "inv_id string, relation string, first string, second string")
    assert {(r.function, r.trigger) for r in O.routes(inv).collect()} == {("b", "pre"), ("c", "post")}
    assert O.needed(spark.createDataFrame([("a",), ("z",)], "function string"), inv).count() == 1


def test_thread_state_survives_a_restart():
    rules = [("i", "lead", "A", "B")]
    rows = [[1, 1, "pre", "1", "A", 0], [2, 0, "post", "1", "A", 0], [3, 1, "pre", "2", "B", 0], [4, 0, "post", "2", "B", 0], [5, 1, "pre", "3", "A", 1], [6, 0, "post", "3", "A", 1], [7, 1, "pre", "4", "A", 2]]
    whole = O.Thread(rules)
    whole.add(rows[:])
    want = list(whole.advance(None))
    out, data = [], None
    for row in rows:
        t = O.Thread(rules, json.loads(json.dumps(data)) if data else None)
        t.add([row])
        out += list(t.advance(None))
        data = t.dump()
    assert out == want == [("i", "3", 1, 5)]
