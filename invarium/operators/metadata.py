"""Metadata queries over records and calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from invarium.schema import ORDER, PT, kind_of

#: Functions whose name holds one of these are never analysed.
SKIPPED_NAMES = (
    "cuda.is_available",
    "torch.get_default_dtype",
    "torch._VariableFunctionsClass",
    "torch.nn.modules.module.Module._call_impl",
    "torch.nn.modules.module.Module._wrapped_impl",
    "torch.nn.modules.module.Module._wrapped_call_impl",
    "torch.cuda._is_compiled",
    "torch.is_grad_enabled",
    "torch._ops.OpOverload",
    "torch.nn.modules.module.Module",
    "torch.utils.data._utils",
    "torch.distributed.utils._to_kwargs",
    "torch.distributed.utils._recursive_to",
    "torch.nn.parallel.scatter_gather._is_namedtuple",
    "torch.nn._reduction",
    "torch.nn.functional",
    "torch._tensor.Tensor.backward",
    "torch.autograd",
    "torch.optim.optimizer.Optimizer._optimizer_step_code",
    "torch.optim.optimizer._get_value",
    "torch.overrides",
    "._",
    "<locals>",
)
#: Longest run of one function that lead/cover and distinct-argument relations accept.
RUN_LIMIT_ORDER, RUN_LIMIT_ARGUMENT = 4, 6


def stages(records: DataFrame) -> DataFrame:
    return records.filter("stage IS NOT NULL").select("stage").distinct()


def flags(records: DataFrame) -> DataFrame:
    """One row: is the trace annotated with stages, are variables proxied."""
    return records.agg(F.max(F.col("stage").isNotNull()).alias("stage_annotated"), F.max(F.col("mode").isNotNull()).alias("proxied"))


def fill_stage(records: DataFrame) -> DataFrame:
    """Missing stages become ``init`` in traces that have stages at all."""
    staged = records.groupBy("trace_id").agg(F.max(F.col("stage").isNotNull()).alias("__staged"))
    filled = F.when(F.col("__staged"), F.coalesce("stage", F.lit("init")))
    return records.join(staged, "trace_id").withColumn("stage", filled).drop("__staged").select(*records.columns)


def is_called(records: DataFrame, function: str, stage: str | None = None) -> bool:
    found = records.filter(F.col("function") == function)
    return bool((found if stage is None else found.filter(F.col("stage") == stage)).limit(1).count())


def time_bounds(records: DataFrame) -> DataFrame:
    """Start and end for each trace, each process and each thread of it (grouping sets; NULL: all)."""
    sets = records.groupingSets([["trace_id"], ["trace_id", "process_id"], ["trace_id", "process_id", "thread_id"]], "trace_id", "process_id", "thread_id")
    return sets.agg(F.min("time_ns").alias("start_ns"), F.max("time_ns").alias("end_ns"), F.count("*").alias("n_records"))


def distinct_ids(records: DataFrame) -> DataFrame:
    """(kind, value): processes, threads, functions and stages."""
    parts = [records.filter(F.col(c).isNotNull()).select(F.lit(k).alias("kind"), F.col(c).cast("string").alias("value")).distinct() for k, c in (("process", "process_id"), ("thread", "thread_id"), ("function", "function"), ("stage", "stage"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def call_ids(records: DataFrame) -> DataFrame:
    """Call ids of each function of a trace, numbered by first appearance."""
    seen = records.filter("func_call_id IS NOT NULL").groupBy("trace_id", "function", "func_call_id").agg(F.min(F.struct(*ORDER)).alias("at"))
    return seen.withColumn("position", F.row_number().over(Window.partitionBy("trace_id", "function").orderBy("at"))).select("trace_id", "function", "func_call_id", "position")


def bound_methods(records: DataFrame) -> DataFrame:
    """Is each function a bound method; ``consistent`` is false where its records disagree."""
    known = records.filter("function IS NOT NULL")
    return known.groupBy("function").agg(F.bool_and("is_bound_method").alias("is_bound"), (F.count_distinct("is_bound_method") == 1).alias("consistent"))


def run_lengths(records: DataFrame, order: list[str]) -> DataFrame:
    """Longest run of consecutive records of each function in each thread; records without a function break runs."""
    w = Window.partitionBy(*PT).orderBy(*order)
    brk = F.when(F.col("function").eqNullSafe(F.lag("function").over(w)), 0).otherwise(1)
    runs = records.withColumn("__new", brk).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sizes = runs.filter("function IS NOT NULL").groupBy(*PT, "function", "__run").count()
    return sizes.groupBy("function").agg(F.max("count").alias("longest_run"))


def skipped(function: Column) -> Column:
    out = F.lit(False)
    for name in SKIPPED_NAMES:
        out = out | F.contains(function, F.lit(name))
    return out


def is_private(function: Column) -> Column:
    """The last part of the dotted name starts with an underscore."""
    return F.substring(F.substring_index(function, ".", -1), 1, 1) == "_"


def function_pool(records: DataFrame, order: list[str], limit: int, drop_private: bool = False) -> DataFrame:
    """Functions whose runs are short enough to be compared in order."""
    pool = run_lengths(records, order).filter((F.col("longest_run") <= limit) & ~skipped(F.col("function")))
    return pool.filter(~is_private(F.col("function"))) if drop_private else pool


def time_percentage(records: DataFrame, time: str = "time_ns") -> DataFrame:
    """Adds ``time_pct``, where a record stands between the first and the last of its trace."""
    bounds = records.groupBy("trace_id").agg(F.min(time).alias("__lo"), F.max(time).alias("__hi"))
    return records.join(bounds, "trace_id").withColumn("time_pct", F.try_divide(F.col(time) - F.col("__lo"), F.col("__hi") - F.col("__lo"))).drop("__lo", "__hi")


def column_kinds(fields: DataFrame) -> DataFrame:
    """Kind of each field: that of its first value that is neither missing nor null."""
    return fields.filter(F.col("value_json").isNotNull() & (F.col("value_json") != "null")).groupBy("field").agg(F.min_by(kind_of(F.col("value_json")), "position").alias("kind"))
