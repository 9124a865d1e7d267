"""Online checks: keyed state, records in order of time, violations as they happen."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from invarium.schema import EXCEPTION, POST, PRE, RAW
from invarium.sources.traces import canonical
from invarium.streaming.tail import TailSource


def file_stream(spark: SparkSession, folder: str, per_batch: int | None = None) -> DataFrame:
    """Records of trace files as whole files arrive (rotated segments)."""
    reader = spark.readStream.schema(RAW).option("pathGlobFilter", "trace_*")
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return canonical(reader.json(folder).select("*", F.col("_metadata.file_path").alias("source_file")))


def tail_stream(spark: SparkSession, folder: str, pattern: str = "trace_*") -> DataFrame:
    """Records of trace files that grow."""
    spark.dataSource.register(TailSource)
    lines = spark.readStream.format("tail").option("path", folder).option("pattern", pattern).load()
    raw = lines.select(F.from_json("value", RAW).alias("r"), F.col("path").alias("source_file")).filter("r.type IS NOT NULL")
    return canonical(raw.select("r.*", "source_file"))


def with_event_time(records: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Adds ``event_time`` with its watermark: how far a file may lag behind the others."""
    return records.withColumn("event_time", F.timestamp_micros(F.floor(F.col("time_ns") / 1000).cast("long"))).withWatermark("event_time", delay)


def needed(records: DataFrame, invariants: DataFrame) -> DataFrame:
    """Records of functions that an invariant names; their size decides how Spark joins them."""
    names = invariants.select(F.explode(F.array("first", "second")).alias("function")).distinct()
    return records.join(names, "function", "left_semi")


def routes(invariants: DataFrame) -> DataFrame:
    """(function, inv_id, relation, trigger): which record of which function wakes which invariant."""
    trigger = F.when(F.col("relation") == "contain", "post").otherwise("pre")
    pivot = F.when(F.col("relation") == "cover", F.col("second")).otherwise(F.col("first"))
    return invariants.select(pivot.alias("function"), "inv_id", "relation", trigger.alias("trigger"))


class Thread:
    """State of one thread: open calls and, for each rule, what its next trigger needs.

    Rules are (inv_id, relation, first, second).  All state is plain JSON, and
    bounded by the open calls and the number of rules.
    """

    def __init__(self, rules: list[tuple[str, str, str, str]], data: dict | None = None):
        self.rules = rules
        data = data or {}
        self.waiting: list[list] = data.get("waiting", [])
        self.open: dict[str, list] = data.get("open", {})
        self.memory: dict[str, dict] = data.get("memory", {})
        self.last = data.get("last", 0)

    def dump(self) -> dict:
        return {"waiting": self.waiting, "open": self.open, "memory": self.memory, "last": self.last}

    def add(self, rows: list[list]) -> None:
        """Rows: [time, order, kind, call, function, step]."""
        self.waiting += rows

    def advance(self, until: int | None) -> Iterator[tuple]:
        """Handle what is no later than ``until`` (None: everything), in order; yields violations."""
        self.waiting.sort()
        ready = [r for r in self.waiting if until is None or r[0] <= until]
        self.waiting = self.waiting[len(ready) :]
        for row in ready:
            yield from self._handle(*row)

    def _handle(self, time, order, kind, call, function, step):
        self.last = max(self.last, time)
        if kind == "pre":
            for inv, relation, first, second in self.rules:
                m = self.memory.setdefault(inv, {})
                if relation == "cover" and function == second:
                    latest, before = m.get("latest"), m.get("end")
                    if latest is None or (before is not None and latest <= before) or (before is None and m.get("seen")):
                        yield inv, call, step, time
                    m["seen"], m["end"], m["call"] = True, None, call
                elif relation == "lead" and function == first:
                    if m.get("call") is not None and not m.get("met"):
                        yield inv, m["call"], m["step"], m["time"]
                    m.update(call=call, step=step, time=time, end=None, met=False)
                elif relation == "contain" and function == first:
                    m.setdefault("parents", {})[call] = [time, step, False]
            self.open[call] = [time, function]
            return
        start = self.open.pop(call, None)
        if start is None:
            return
        began = start[0]
        for inv, relation, first, second in self.rules:
            m = self.memory.setdefault(inv, {})
            if relation == "cover":
                if function == first and began > (m.get("latest") if m.get("latest") is not None else -1):
                    m["latest"] = began
                if function == second and m.get("call") == call:
                    m["end"] = time
            elif relation == "lead":
                if function == first and m.get("call") == call:
                    m["end"] = time
                if function == second and m.get("end") is not None and began > m["end"]:
                    m["met"] = True
            elif relation == "contain":
                if function == second:
                    for p, own in m.get("parents", {}).items():
                        if p != call and began > own[0]:
                            own[2] = True
                if function == first:
                    own = m.get("parents", {}).pop(call, None)
                    if own and not own[2]:
                        yield inv, call, own[1], own[0]


def check_stream(records: DataFrame, rules: list[tuple[str, str, str, str]]) -> DataFrame:
    """(trace_id, process_id, thread_id, inv_id, func_call_id, step, time_ns): violations of a stream of records.

    ``rules`` come from the invariants: their number is that of function pairs,
    not of records.  A record waits in its thread's state until the watermark
    has passed it, so that files that lag are read in order; a file that stops
    holds nobody back, as the watermark is that of the whole stream.
    """
    keys = ["trace_id", "process_id", "thread_id"]
    kind = F.when(F.col("type") == PRE, "pre").when(F.col("type").isin(POST, EXCEPTION), "post")
    own = records.filter("func_call_id IS NOT NULL").select(*keys, "event_time", "time_ns", "line_no", kind.alias("kind"), "func_call_id", "function", "step")
    out = ["trace_id", "process_id", "thread_id", "inv_id", "func_call_id", "step", "time_ns"]

    def step(key, batches, state: GroupState):
        thread = Thread(rules, json.loads(state.get[0]) if state.exists else None)
        for pdf in batches:
            rows = pdf[["time_ns", "line_no", "kind", "func_call_id", "function", "step"]].astype(object).where(pdf[["time_ns", "line_no", "kind", "func_call_id", "function", "step"]].notna(), None)
            thread.add([[int(t), 1 if k == "pre" else 0, k, c, f, None if s is None else int(s)] for t, _, k, c, f, s in rows.values.tolist()])
        mark = state.getCurrentWatermarkMs() * 1_000_000
        found = list(thread.advance(None if state.hasTimedOut else mark))
        state.update((json.dumps(thread.dump()),))
        if thread.waiting:
            latest = max(r[0] for r in thread.waiting) // 1_000_000 + 1
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(*key, *f) for f in found], columns=out)

    schema = "trace_id string, process_id long, thread_id long, inv_id string, func_call_id string, step long, time_ns long"
    return own.groupBy(*keys).applyInPandasWithState(step, schema, "data string", "append", GroupStateTimeout.EventTimeTimeout)


def dedup_pairs(violations: DataFrame, a: str, b: str) -> DataFrame:
    """One violation for each invariant and unordered pair of records."""
    return violations.withColumn("__lo", F.least(a, b)).withColumn("__hi", F.greatest(a, b)).dropDuplicates(["inv_id", "__lo", "__hi"]).drop("__lo", "__hi")


def detail(violations: DataFrame, most: int = 500) -> DataFrame:
    """For each invariant: count, the first ``most`` steps, and its first violation as a sample."""
    steps = violations.filter("step IS NOT NULL").select("inv_id", "step").distinct()
    first = steps.groupBy("inv_id").agg(F.slice(F.sort_array(F.collect_list("step")), 1, most).alias("steps"))
    return violations.groupBy("inv_id").agg(F.count("*").alias("n"), F.min_by("func_call_id", F.struct("time_ns", "func_call_id")).alias("sample")).join(first, "inv_id", "left")


def sampled(step: Column, interval: int, warm_up: int) -> Column:
    """Is a step looked at: all of the warm-up, then every ``interval``-th."""
    return (step < warm_up) | ((step - warm_up) % interval == 0)
