"""Readers of trace files, invariants and check results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from invarium.schema import INVARIANTS, RAW, text_map


def read_records(spark: SparkSession, paths: str | list[str], trace_id: str | None = None, strict: bool = True) -> DataFrame:
    """Records of JSON-lines trace files in the canonical model.

    ``strict`` fails on a line that is no JSON object; otherwise such lines are
    skipped.  A folder is one trace, named by ``trace_id`` or by its own path.
    """
    corrupt = "__corrupt"
    reader = spark.read.schema(RAW + f", {corrupt} STRING").option("columnNameOfCorruptRecord", corrupt)
    raw = reader.option("mode", "FAILFAST" if strict else "PERMISSIVE").json(paths)
    raw = raw.select("*", F.col("_metadata.file_path").alias("source_file"))
    if not strict:
        raw = raw.filter(F.col(corrupt).isNull() & F.col("type").isNotNull())
    return canonical(raw.drop(corrupt), trace_id)


def canonical(raw: DataFrame, trace_id: str | None = None) -> DataFrame:
    """``RAW`` rows with ``source_file`` (batch or stream) as ``RECORDS``; ``line_no`` orders rows of a file that share a time."""
    meta = text_map(F.col("meta_vars"))
    name = F.lit(trace_id) if trace_id else F.regexp_extract("source_file", r"^(.*)/[^/]*$", 1)
    line = F.lit(0).cast("long") if raw.isStreaming else F.monotonically_increasing_id()
    unquote = lambda c: F.get_json_object(F.concat(F.lit('{"v":'), c, F.lit("}")), "$.v")
    return raw.select(
        name.alias("trace_id"), "source_file", line.alias("line_no"), F.col("time").alias("time_ns"), "type", "process_id", "thread_id",
        meta["step"].try_cast("long").alias("step"), unquote(meta["stage"]).alias("stage"), "func_call_id", "function", "is_bound_method", "obj_id",
        F.to_json("args").alias("args_json"), F.to_json("kwargs").alias("kwargs_json"), F.to_json("return_values").alias("return_json"),
        "exception", "exception_msg", "proxy_obj_names", "var_name", "var_type", "mode", "dump_loc", meta.alias("meta_vars"), text_map(F.col("attributes")).alias("attributes"),
    )


def read_folder(spark: SparkSession, folder: str, trace_id: str | None = None, strict: bool = True) -> DataFrame:
    """The trace in a folder: files named ``trace_*`` or ``proxy_log.json*``."""
    reader = spark.read.option("pathGlobFilter", "{trace_*,proxy_log.json*}")
    files = reader.format("binaryFile").load(folder).select("path").orderBy("path")
    paths = [r.path for r in files.collect()]  # file names alone
    if not paths:
        raise FileNotFoundError(f"no trace files in {folder}")
    return read_records(spark, paths, trace_id or folder, strict)


def read_invariants(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Invariants from JSON lines, numbered by identity."""
    return spark.read.schema(INVARIANTS).json(paths)


def read_check_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Concatenated pretty-printed JSON objects, one row each.

    Objects start at a line that is ``{`` alone and end at a line ``}``.
    """
    text = spark.read.text(path, wholetext=True)
    parts = F.filter(F.split("value", r"(?m)^(?=\{\s*$)"), lambda x: F.length(F.trim(x)) > 0)
    return text.select(F.explode(parts).alias("j")).select(F.from_json("j", schema).alias("r")).select("r.*")


def read_sampling_config(spark: SparkSession, path: str) -> DataFrame:
    """(interval, warm_up) from an environment dump; NULL where it names none."""
    text = spark.read.text(path, wholetext=True)
    grab = lambda key: F.nullif(F.regexp_extract("value", rf"(?i){key}['\"]?\s*[:=]\s*(\d+)", 1), F.lit("")).cast("long")
    return text.select(grab("interval").alias("interval"), grab("warm_up").alias("warm_up"))


def read_diff(spark: SparkSession, path: str) -> DataFrame:
    """(side, line) of a trace diff: ``added`` for + and ++, ``removed`` for - and --, headers left out."""
    lines = spark.read.text(path)
    return diff_lines(lines)


def diff_lines(lines: DataFrame) -> DataFrame:
    v = F.col("value")
    side = F.when(v.startswith("++"), "added_only").when(v.startswith("--"), "removed_only").when(v.startswith("+"), "added").when(v.startswith("-"), "removed")
    return lines.select(side.alias("side"), F.trim(F.regexp_replace(v, r"^[+-]{1,2}", "")).alias("line")).filter("side IS NOT NULL")


def read_call_depths(spark: SparkSession, path: str) -> DataFrame:
    """(function, depth) from lines ``<Node function:name> - depth``."""
    lines = spark.read.text(path)
    return call_depths(lines)


def call_depths(lines: DataFrame) -> DataFrame:
    node = r"<Node\s+\w+:([^>]+)>\s*-\s*(\d+)"
    return lines.filter(F.col("value").rlike(node)).select(F.regexp_extract("value", node, 1).alias("function"), F.regexp_extract("value", node, 2).cast("int").alias("depth"))
