"""Relations of variables: consistency of two, periodic change of one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from invarium.functions.values import hypothesis_value, same_value
from invarium.operators.relations.overlaps import counted
from invarium.operators.temporal import interval_overlap, overlap_share
from invarium.schema import kind_of, number_of
from invarium.sources.scratch import staged

OVERLAP, LEAST_PAIRS, PERIODIC = 0.01, 2, 5
#: Kinds of variables whose first state says nothing.
SKIP_INITIAL = "(?i)tensor|module|parameter"


def _name() -> Column:
    return F.concat_ws("|", F.col("process_id").cast("string"), "var_name", "attr")


def _compared(states: DataFrame, inference: bool) -> DataFrame:
    used = states.withColumn("value_kind", F.coalesce(kind_of(F.col("value_json")), F.lit("missing")))
    return used.filter(~(F.col("var_type").rlike(SKIP_INITIAL) & (F.col("state_no") == 1))) if inference else used


def state_pairs(states: DataFrame, keys: list[str], inference: bool = True) -> DataFrame:
    """Pairs of states of two variables that live together for more than a hundredth of their time.

    States must share ``keys`` and the kind of their value; ``inference`` leaves
    out first states of tensor-like types and compares floats with tolerance,
    a check takes all states and compares exactly.
    """
    used = _compared(states, inference)
    side = lambda x: used.select(*keys, "value_kind", _name().alias(f"{x}_var"), F.col("var_type").alias(f"{x}_type"), F.col("attr").alias(f"{x}_attr"), F.col("value_json").alias(f"{x}_value"), F.col("start_ns").alias(f"{x}_start"), F.col("end_ns").alias(f"{x}_end"))
    pairs = interval_overlap(side("a"), side("b"), [*keys, "value_kind"], ("a_start", "a_end"), ("b_start", "b_end")).filter("a_var < b_var")
    share = overlap_share(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end"))
    equal = same_value(F.col("a_value"), F.col("b_value"), inference)
    return pairs.withColumn("overlap", share).filter(F.col("overlap") > OVERLAP).withColumn("positive", equal)


def pair_counts(states: DataFrame, keys: list[str], inference: bool = True) -> DataFrame:
    """(keys, type_1, attr_1, type_2, attr_2, n_positive, n_negative): the ``state_pairs`` of two kinds of variables, counted.

    No pair is made: all pairs that live together are counted, and those of
    equal values.  Shares are compared in whole numbers.
    """
    of = F.to_json(F.struct(F.col("var_type").alias("type"), "attr"))
    rows = _compared(states, inference).filter("end_ns > start_ns").select(*keys, "value_kind", _name().alias("name"), F.struct("process_id", "var_name", "var_type", "attr").alias("var"), of.alias("of"), F.coalesce("value_json", F.lit("")).alias("value"), "start_ns", "end_ns")
    rows = staged(rows, "states")
    tolerance = inference and not rows.filter("value_kind = 'float'").isEmpty()
    n = _counts(rows, [*keys, "value_kind"], tolerance)
    # states of one name are no pair; those of one variable never live together
    several = rows.groupBy(*keys, "value_kind", "name").agg(F.count_distinct("var").alias("n")).filter("n > 1").drop("n")
    if not several.isEmpty():
        own = _counts(rows.join(several, [*keys, "value_kind", "name"], "left_semi"), [*keys, "value_kind", "name"], tolerance).drop("name")
        n = n.unionByName(own.withColumn("n", -F.col("n")))
    out = n.groupBy(*keys, "lo", "hi").agg(F.sum(F.when(F.col("equal"), F.col("n")).otherwise(0)).alias("n_positive"), F.sum(F.when(F.col("equal"), -F.col("n")).otherwise(F.col("n"))).alias("n_negative"))
    part = lambda c, i: [F.get_json_object(c, "$.type").alias(f"type_{i}"), F.get_json_object(c, "$.attr").alias(f"attr_{i}")]
    return out.filter("n_positive + n_negative > 0").select(*keys, *part("lo", 1), *part("hi", 2), "n_positive", "n_negative")


def _counts(rows: DataFrame, keys: list[str], tolerance: bool) -> DataFrame:
    """(keys, lo, hi, equal, n): pairs of states of two kinds of variables, all and those of one value."""
    kinds = rows.select(*keys, "of").distinct()
    two = kinds.withColumnRenamed("of", "lo").join(kinds.withColumnRenamed("of", "hi"), keys).filter("lo <= hi")
    left = rows.join(two.withColumn("of", F.col("lo")), [*keys, "of"]).withColumn("side", F.lit(0))
    right = rows.join(two.filter("lo < hi").withColumn("of", F.col("hi")), [*keys, "of"]).withColumn("side", F.lit(1))
    both = left.unionByName(right).withColumn("twofold", F.col("lo") < F.col("hi"))
    job = [*keys, "lo", "hi", "equal", "u", "v"]
    asked = F.array(F.struct(F.lit(False).alias("equal"), F.lit("").alias("u"), F.lit("").alias("v")), F.struct(F.lit(True).alias("equal"), F.col("value").alias("u"), F.col("value").alias("v")))
    columns = [*job, "twofold", "side", F.col("var").alias("id"), "start_ns", "end_ns"]
    jobs = both.withColumn("asked", F.explode(asked)).select("*", "asked.*").select(*columns)
    if tolerance:
        # floats of other texts that are equal within the tolerance: a side holds the one, the other side the other
        x = number_of(F.col("value"))
        floats = rows.filter("value_kind = 'float'").select(*keys, "value").distinct()
        spot = F.when(F.abs(x) < 1e8, F.floor(x * 1e7).cast("string")).otherwise(F.concat(F.lit("="), x.cast("string")))
        near = F.when(F.abs(x) < 1e8, F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: (F.floor(x * 1e7) + d).cast("string"))).otherwise(F.array(F.concat(F.lit("="), x.cast("string"))))
        a = floats.select(*keys, F.col("value").alias("u"), spot.alias("at"))
        b = floats.select(*keys, F.col("value").alias("v"), F.explode(near).alias("at"))
        close = a.join(b, [*keys, "at"]).filter(F.col("u") != F.col("v")).filter(same_value(F.col("u"), F.col("v"))).drop("at")
        # of one kind of variable, a pair of values is met once: the lesser to the left
        lefts = left.join(close.withColumn("value", F.col("u")), [*keys, "value"]).filter("lo < hi OR u < v")
        rights = rows.join(two.withColumn("of", F.col("hi")), [*keys, "of"]).withColumn("side", F.lit(1)).join(close.withColumn("value", F.col("v")), [*keys, "value"]).filter("lo < hi OR u < v")
        jobs = jobs.unionByName(lefts.unionByName(rights).withColumn("equal", F.lit(True)).withColumn("twofold", F.lit(True)).select(*columns))
    return counted(jobs, job).groupBy(*keys, "lo", "hi", "equal").agg(F.sum("n").alias("n"))


def typed(counts: DataFrame) -> DataFrame:
    """Type-level hypotheses out of ``pair_counts``: at least two equal pairs."""
    a, b = F.struct(F.col("type_1").alias("type"), F.col("attr_1").alias("attr")), F.struct(F.col("type_2").alias("type"), F.col("attr_2").alias("attr"))
    both = counts.withColumn("__lo", F.least(a, b)).withColumn("__hi", F.greatest(a, b))
    out = both.groupBy(F.col("__lo.type").alias("type_1"), F.col("__lo.attr").alias("attr_1"), F.col("__hi.type").alias("type_2"), F.col("__hi.attr").alias("attr_2"))
    return out.agg(F.sum("n_positive").alias("n_positive"), F.sum("n_negative").alias("n_negative")).filter(F.col("n_positive") >= LEAST_PAIRS)


def consistency(pairs: DataFrame) -> DataFrame:
    """Type-level hypotheses: (type, attr) pairs with at least two equal pairs of states."""
    side = lambda x: F.struct(F.col(f"{x}_type").alias("type"), F.col(f"{x}_attr").alias("attr"))
    a, b = side("a"), side("b")
    both = pairs.withColumn("__lo", F.least(a, b)).withColumn("__hi", F.greatest(a, b))
    out = both.groupBy(F.col("__lo.type").alias("type_1"), F.col("__lo.attr").alias("attr_1"), F.col("__hi.type").alias("type_2"), F.col("__hi.attr").alias("attr_2"))
    return out.agg(F.count_if("positive").alias("n_positive"), F.count_if(~F.col("positive")).alias("n_negative")).filter(F.col("n_positive") >= LEAST_PAIRS)


def periodic(states: DataFrame, least: int = PERIODIC) -> DataFrame:
    """Values that an attribute of a variable takes more than ``least`` times."""
    value = hypothesis_value(F.col("value_json"))
    return states.groupBy("process_id", "var_name", "var_type", "attr", value.alias("value")).agg(F.count("*").alias("times")).filter(F.col("times") > least)
