"""Streaming queries: the events as a stream of records, checked online; rows, not files, reach the caller."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invarium.queries.registry import query
from invarium.schema import PRE
from invarium.sources.scratch import scratch
from invarium.sources.tables import event_records
from invarium.streaming.online import check_stream, with_event_time


def stream_of(records: DataFrame, parts: int = 4) -> DataFrame:
    """A record table as a stream of file segments in order of time, with an end marker that moves the watermark on."""
    spark = records.sparkSession
    path = scratch(spark, "segments")
    rows = records.filter("func_call_id IS NOT NULL").drop("meta_vars", "attributes", "proxy_obj_names")
    cuts = rows.agg(F.percentile_approx("time_ns", [k / parts for k in range(1, parts)]).alias("c"), F.max("time_ns").alias("t")).first()
    end, cuts = cuts.t or 0, cuts.c or []
    lower = None
    for k, upper in enumerate([*cuts, None]):  # one after the other: the source takes files by age
        own = rows if lower is None else rows.filter(F.col("time_ns") > lower)
        own = own if upper is None else own.filter(F.col("time_ns") <= upper)
        own.coalesce(1).write.parquet(f"{path}/{k}")
        lower = upper
    mark = rows.limit(1).withColumn("thread_id", F.lit(-1).cast("long")).withColumn("func_call_id", F.lit("end")).withColumn("function", F.lit("end")).withColumn("type", F.lit(PRE))
    for k in (1, 2):
        mark.withColumn("time_ns", F.lit(end + (10 + k) * 86_400_000_000_000).cast("long")).coalesce(1).write.parquet(f"{path}/end{k}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def run_to_end(stream: DataFrame) -> DataFrame:
    """Run a stream until its source is exhausted; returns its rows as a table."""
    spark = stream.sparkSession
    path, checkpoint = scratch(spark, "online"), scratch(spark, "offsets")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").queryName(f"q{uuid.uuid4().hex}").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    return spark.read.schema(stream.schema).parquet(path)


def _online(spark, sf_dir, relation, first, second):
    # segments are in order of time but calls overlap: the longest call is a day
    records = with_event_time(stream_of(event_records(spark, sf_dir)), "2 days")
    return run_to_end(check_stream(records, [(relation, relation, first, second)])).filter("thread_id >= 0").select("func_call_id", "step", "time_ns")


@query()
def online_contain(spark, sf_dir):
    return _online(spark, sf_dir, "contain", "purchase", "click")


@query()
def online_cover(spark, sf_dir):
    return _online(spark, sf_dir, "cover", "click", "view")


@query()
def online_lead(spark, sf_dir):
    return _online(spark, sf_dir, "lead", "view", "click")


@query()
def aligned_stream(spark, sf_dir):
    """Records of each thread counted by the hour of event time, late ones within the watermark included."""
    records = with_event_time(stream_of(event_records(spark, sf_dir)), "2 days")
    hours = records.groupBy(F.window("event_time", "1 hour").alias("w"), "thread_id").agg(F.count("*").alias("n_records"))
    return run_to_end(hours.select(F.col("w.start").cast("long").alias("hour_start"), "thread_id", "n_records")).filter("thread_id >= 0")
