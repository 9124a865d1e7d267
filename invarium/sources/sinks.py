"""Writers of invariants, check results and reports."""

from __future__ import annotations

import html
import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invarium.plans.report import by_relation, overview, status, summary


def save_invariants(invariants: DataFrame, path: str) -> None:
    """JSON lines, sorted by text."""
    invariants.orderBy("text_description", "relation").write.mode("overwrite").json(path)


def save_failed(failed: DataFrame, path: str) -> None:
    """Hypotheses without a precondition, beside the invariants."""
    failed.write.mode("overwrite").json(path.rstrip("/") + ".failed")


def save_results(results: DataFrame, path: str) -> None:
    """One folder for each status: failed, not_triggered, passed."""
    results.withColumn("status", status()).write.mode("overwrite").partitionBy("status").json(path)


def write_text(df: DataFrame, path: str, text: str) -> None:
    """One text through Spark's file system, so that it reaches any store."""
    jvm = df.sparkSession._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def save_summary(results: DataFrame, path: str, most: int = 10_000) -> dict:
    """``violations_summary.json``: counts and at most ``most`` violations (a report for readers)."""
    head = overview(results).first()
    rows = summary(results).orderBy("first_step", "display_name").limit(most).collect()
    out = {"first_violation_step": head[0], "distinct_invariants_violated": head[1], "violations": [r.asDict() for r in rows]}
    write_text(results, path, json.dumps(out, indent=2))
    return out


def save_html(results: DataFrame, path: str, title: str = "Check report", most: int = 1000) -> None:
    """A page with counts by relation and the violations."""
    cell = lambda x: f"<td>{html.escape('' if x is None else str(x))}</td>"

    def table(df: DataFrame) -> str:
        rows = df.limit(most).collect()
        return "<table><tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in df.columns) + "</tr>" + "".join("<tr>" + "".join(map(cell, r)) + "</tr>" for r in rows) + "</table>"

    page = f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{table(by_relation(results).orderBy('relation'))}{table(summary(results).orderBy('first_step'))}"
    write_text(results, path, page)


class Emitter:
    """Calls ``send(metrics)`` when they change, or when ``interval`` seconds have passed (metrics services plug in here)."""

    def __init__(self, send: Callable[[dict], None], interval: float = 30.0, clock: Callable[[], float] = time.monotonic):
        self.send, self.interval, self.clock = send, interval, clock
        self.last: dict | None = None
        self.at = float("-inf")

    def offer(self, metrics: dict) -> bool:
        now = self.clock()
        if metrics == self.last and now - self.at < self.interval:
            return False
        self.send(metrics)
        self.last, self.at = dict(metrics), now
        return True


def append_violations(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that appends violations as JSON lines, one folder a batch (a retried batch replaces its own)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").json(f"{path}/batch={batch_id}")

    return write
