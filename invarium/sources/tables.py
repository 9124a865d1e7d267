"""Traces from tables: events as calls, their values and orders as variable histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from invarium.schema import POST, PRE, STATE


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a time without zone, whatever the session's zone."""
    return F.expr(
        f"datediff({ts}, DATE '1970-01-01') * 86400000000L + hour({ts}) * 3600000000L + minute({ts}) * 60000000L + CAST(extract(SECOND FROM {ts}) * 1000000 AS BIGINT)"
    )


def day(ts: str) -> Column:
    return F.expr(f"CAST(datediff({ts}, DATE '2024-01-01') AS BIGINT)")


def stage_of(step: Column) -> Column:
    return F.when(step % 3 == 0, "init").when(step % 3 == 1, "training").otherwise("evaluation")


def event_calls(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """Calls in the model of ``operators.events.calls``, straight from events; ``more`` columns of them."""
    start = micros("ts") * 1000
    e = load(spark, sf_dir, "events").withColumn("step", day("ts"))
    return e.select(
        F.lit("events").alias("trace_id"), F.col("event_id").cast("string").alias("func_call_id"), F.col("event_type").alias("function"),
        (F.col("user_id") % 4).alias("process_id"), (F.col("user_id") % 16).alias("thread_id"), start.alias("start_ns"),
        (start + F.round(F.col("value") * 60).cast("long") * 1_000_000_000).alias("end_ns"), F.lit("ok").alias("outcome"), "step", stage_of(F.col("step")).alias("stage"),
        F.col("user_id").alias("obj_id"), F.col("props").alias("args_json"), *more,
    )


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre and post records of the same calls, and a state of the user's ``level`` at each event."""
    c = event_calls(spark, sf_dir, F.col("event_id"), F.floor(F.col("value") / 100).cast("long").cast("string").alias("level"))
    none = lambda kind: F.lit(None).cast(kind)

    def rows(kind: str, time: Column, order: int) -> DataFrame:
        call = kind != STATE
        own = lambda col, when: col if when else none("string")
        return c.select(
            "trace_id", F.lit("events").alias("source_file"), (F.col("event_id") * 4 + order).alias("line_no"), time.alias("time_ns"), F.lit(kind).alias("type"), "process_id", "thread_id", "step", "stage",
            own(F.col("func_call_id"), call).alias("func_call_id"), own(F.col("function"), call).alias("function"), (F.lit(True) if call else none("boolean")).alias("is_bound_method"),
            (F.col("obj_id") if call else none("bigint")).alias("obj_id"), own(F.col("args_json"), kind == PRE).alias("args_json"), none("string").alias("kwargs_json"), none("string").alias("return_json"),
            none("string").alias("exception"), none("string").alias("exception_msg"),
            (F.array(F.array((F.get_json_object("args_json", "$.k").cast("long") % 10).cast("string"), F.lit("Parameter"))) if kind == PRE else none("array<array<string>>")).alias("proxy_obj_names"),
            own(F.col("obj_id").cast("string"), not call).alias("var_name"), own(F.lit("User"), not call).alias("var_type"), none("string").alias("mode"), none("string").alias("dump_loc"),
            F.create_map(F.lit("step"), F.col("step").cast("string")).alias("meta_vars"),
            (F.create_map(F.lit("level"), F.col("level")) if not call else none("map<string,string>")).alias("attributes"),
        )

    return rows(PRE, F.col("start_ns"), 0).unionByName(rows(STATE, F.col("start_ns"), 1)).unionByName(rows(POST, F.col("end_ns"), 2))


def order_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trace_id, process_id, var_name, var_type, attr, value_json, time_ns, record_no): order status by customer."""
    o = load(spark, sf_dir, "orders")
    return o.select(
        F.lit("orders").alias("trace_id"), (F.col("o_custkey") % 4).alias("process_id"), F.col("o_custkey").cast("string").alias("var_name"), F.lit("Customer").alias("var_type"), F.lit("status").alias("attr"),
        F.concat(F.lit('"'), "o_orderstatus", F.lit('"')).alias("value_json"), (micros("o_orderdate") * 1000).alias("time_ns"), F.col("o_orderkey").alias("record_no"),
    )
