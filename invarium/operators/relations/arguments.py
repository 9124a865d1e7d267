"""Relations of arguments and results: distinct arguments, constant outputs, input equals output, thresholds."""

from __future__ import annotations

from json import dumps, loads

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invarium.functions.values import same_argument
from invarium.schema import kind_of

#: A type that holds a tensor.
TENSOR = r"torch\..*Tensor|Parameter"
#: Relative slack within which a result suggests a threshold.
SLACK = 0.2


def argument_pairs(calls: DataFrame, keys: list[str], argument: str = "args_json") -> DataFrame:
    """(keys, value, n_calls): calls of a function in a step grouped by their whole argument text.

    Equal arguments meet by aggregation, so that a step with very many equal
    calls is one row; a group of n rows stands for n (n - 1) / 2 equal pairs.
    """
    return calls.groupBy(*keys, F.col(argument).alias("value")).agg(F.count("*").alias("n_calls"), F.min("func_call_id").alias("first_call"))


def distinct_arguments(calls: DataFrame, keys: list[str], argument: str = "args_json") -> DataFrame:
    """Pairs of calls of each group (n_pairs) and those with the same argument (n_same), by exact text."""
    by_value = argument_pairs(calls, keys, argument)
    n = F.sum("n_calls")
    return by_value.groupBy(*keys).agg((n * (n - 1) / 2).cast("long").alias("n_pairs"), F.sum((F.col("n_calls") * (F.col("n_calls") - 1) / 2).cast("long")).alias("n_same"))


def similar_arguments(calls: DataFrame, keys: list[str], argument: str = "args_json") -> DataFrame:
    """Pairs of distinct argument texts of a group that still count as the same (float tolerance, similar lists).

    Only texts that can be close without being equal take part: floats and
    lists.  They meet by rounded value or by a shared member, never all with all.
    """
    values = argument_pairs(calls, keys, argument).filter(kind_of(F.col("value")).isin("float", "array"))
    number = F.col("value").try_cast("double")
    near = F.array(F.floor(number * 1e7), F.floor(number * 1e7) + 1).cast("array<string>")
    members = F.transform(F.from_json("value", "array<bigint>"), lambda x: x.cast("string"))
    met = values.withColumn("__key", F.explode(F.when(kind_of(F.col("value")) == "float", near).otherwise(F.array_distinct(members))))
    a = met.select(*keys, "__key", F.col("value").alias("a"), F.col("n_calls").alias("a_calls"))
    b = met.select(*keys, "__key", F.col("value").alias("b"), F.col("n_calls").alias("b_calls"))
    pairs = a.join(b, [*keys, "__key"]).filter("a < b").drop("__key").distinct()
    return pairs.filter(same_argument(F.col("a"), F.col("b")))


def tensor_properties(calls: DataFrame, json: str, key: str = "func_call_id") -> DataFrame:
    """(key, idx, type, prop, value_json): properties of the tensors in a JSON text ``{type: {prop: value}}`` or a list of such."""
    v = F.try_parse_json(json)
    whole = F.when(F.schema_of_variant(v).startswith("ARRAY"), v.cast("array<variant>")).otherwise(F.array(v))
    parts = calls.filter(F.col(json).isNotNull()).select(key, "function", F.posexplode(whole).alias("idx", "part"))
    typed = parts.filter(F.schema_of_variant("part").startswith("OBJECT")).select(key, "function", "idx", F.explode(F.col("part").cast("map<string,variant>")).alias("type", "props"))
    tensors = typed.filter(F.col("type").rlike(TENSOR) & F.schema_of_variant("props").startswith("OBJECT"))
    return tensors.select(key, "function", "idx", "type", F.explode(F.col("props").cast("map<string,variant>")).alias("prop", "value")).withColumn("value_json", F.to_json("value")).drop("value")


def constant_outputs(calls: DataFrame, properties: DataFrame) -> DataFrame:
    """(function, prop, value_json, n_positive, n_negative): values that returned tensors share.

    A function counts only if every one of its calls returns a tensor; a call
    whose tensors do not all have the value is a negative example.
    """
    total = calls.groupBy("function").agg(F.count_distinct("func_call_id").alias("n_calls"))
    covered = properties.groupBy("function").agg(F.count_distinct("func_call_id").alias("n_with"))
    always = total.join(covered, "function").filter("n_calls = n_with").select("function", "n_calls")
    by_call = properties.groupBy("function", "func_call_id", "prop").agg(F.min("value_json").alias("lo"), F.max("value_json").alias("hi")).filter("lo = hi")
    out = by_call.groupBy("function", "prop", F.col("lo").alias("value_json")).agg(F.count("*").alias("n_positive"))
    return out.join(always, "function").withColumn("n_negative", F.col("n_calls") - F.col("n_positive")).drop("n_calls")


def value_paths(calls: DataFrame, json: str, prefix: str) -> DataFrame:
    """(func_call_id, function, path, value_json): scalars of a JSON text by path, list elements one by one, at any depth.

    One pass over the calls.  A text that is no JSON has no paths, nulls are no values.
    """

    def walk(path, value):
        work = [(path, value)]
        while work:
            at, v = work.pop()
            if isinstance(v, (dict, list)):
                inner = v.items() if isinstance(v, dict) else enumerate(v)
                work += [(f"{at}.{k}", x) for k, x in inner]
            elif v is not None:
                yield at, dumps(v, ensure_ascii=False)

    def run(batches):
        for batch in batches:
            rows = ([], [], [], [])
            for call, function, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
                try:
                    value = loads(text)
                except ValueError:
                    continue
                for path, found in walk(prefix, value):
                    for column, x in zip(rows, (call, function, path, found)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in rows], ["func_call_id", "function", "path", "value_json"])

    texts = calls.filter(F.col(json).isNotNull()).select("func_call_id", "function", json)
    return texts.mapInArrow(run, "func_call_id string, function string, path string, value_json string")


def input_output(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """(function, in_path, out_path, n_positive, n_negative): paths whose values are equal in at least one call.

    A call without one of the paths is no example; booleans count only at the
    same path.  Candidates come from a join by call and value; negatives only
    for candidate pairs of paths.
    """
    i = inputs.select("func_call_id", "function", F.col("path").alias("in_path"), "value_json")
    o = outputs.select("func_call_id", F.col("path").alias("out_path"), "value_json")
    tail = lambda c: F.regexp_replace(c, r"^[^.]*\.", "")
    meaning = ~F.col("value_json").isin("true", "false") | (tail("in_path") == tail("out_path"))
    hits = i.join(o, ["func_call_id", "value_json"]).filter(meaning)
    found = hits.groupBy("function", "in_path", "out_path").agg(F.count_distinct("func_call_id").alias("n_positive"))
    both = i.join(found.select("function", "in_path", "out_path"), ["function", "in_path"]).join(o.select("func_call_id", "out_path"), ["func_call_id", "out_path"])
    total = both.groupBy("function", "in_path", "out_path").agg(F.count_distinct("func_call_id").alias("n"))
    return found.join(total, ["function", "in_path", "out_path"]).withColumn("n_negative", F.col("n") - F.col("n_positive")).drop("n")


def threshold_examples(arguments: DataFrame, results: DataFrame, kind: str) -> DataFrame:
    """(func_call_id, name, threshold, result, positive, close) for arguments whose name holds ``min`` or ``max``.

    Positive where the result respects the threshold; ``close`` where it lies
    within the relative slack that suggests the relation (a zero threshold
    suggests nothing).
    """
    named = arguments.filter(F.contains(F.lower("name"), F.lit(kind))).withColumn("threshold", F.col("value_json").try_cast("double")).filter("threshold IS NOT NULL")
    joined = named.join(results, "func_call_id")
    good = F.col("result") >= F.col("threshold") if kind == "min" else F.col("result") <= F.col("threshold")
    gap = F.abs(F.try_divide(F.col("result") - F.col("threshold"), F.col("threshold")))
    return joined.select("func_call_id", "name", "threshold", "result", good.alias("positive"), F.coalesce(gap <= SLACK, F.lit(False)).alias("close"))
