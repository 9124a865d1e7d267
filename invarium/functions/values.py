"""Scalar functions over values: symbolic classes, tolerance, similarity, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from invarium.schema import kind_of, number_of

#: Floats this close are equal.
TOLERANCE = 1e-8
#: Argument lists of integers with this Jaccard similarity count as the same.
SAME_LIST = 0.1

#: Symbolic classes of values, and the predicate of each over (n: number or NULL, explicit null: is_null).
CLASSES = ("above_zero", "below_zero", "non_positive", "non_negative", "non_zero", "non_none", "anything")


def generalized(value: Column) -> list[Column]:
    """Aggregates of a group of canonical values: (symbol or single value, number of distinct values).

    One distinct value stands for itself; numbers become the narrowest sign
    class; other kinds ``non_none``, or ``anything`` where null is among them.
    """
    number, null = number_of(value), value == "null"
    lo, hi = F.min(number), F.max(number)
    zero, nulls, n = F.count_if(number == 0), F.count_if(null), F.count_distinct(value)
    symbol = (
        F.when(n == 1, F.min(value)).when(lo > 0, "above_zero").when(lo >= 0, "non_negative").when(hi < 0, "below_zero").when(hi <= 0, "non_positive")
        .when(lo.isNotNull() & (zero == 0), "non_zero").when(lo.isNotNull() & (nulls == 0), "non_none").when(lo.isNotNull(), "anything")
        .when(nulls == 0, "non_none").otherwise("anything")
    )
    return [symbol.alias("symbol"), n.alias("n_values")]


def matches(symbol: Column, value: Column) -> Column:
    """Does a canonical value belong to a symbolic class (explicit null is non-positive and non-negative)."""
    n, null = number_of(value), value == "null"
    return (
        F.when(symbol == "anything", True).when(symbol == "non_none", ~null).when(symbol == "above_zero", F.coalesce(n > 0, F.lit(False))).when(symbol == "below_zero", F.coalesce(n < 0, F.lit(False)))
        .when(symbol == "non_positive", null | F.coalesce(n <= 0, F.lit(False))).when(symbol == "non_negative", null | F.coalesce(n >= 0, F.lit(False))).when(symbol == "non_zero", F.coalesce(n != 0, F.lit(False)))
    )


def close(a: Column, b: Column) -> Column:
    """Equal numbers within the tolerance; NULL and NaN equal themselves."""
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).when(F.isnan(a) | F.isnan(b), F.isnan(a) & F.isnan(b)).otherwise(F.abs(a - b) < TOLERANCE)


def all_close(a: Column, b: Column) -> Column:
    """Arrays of numbers of equal length, close element by element."""
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) < TOLERANCE), lambda x: x)


def same_value(a: Column, b: Column, tolerance: bool = True) -> Column:
    """Canonical values of the same kind and equal, floats within the tolerance."""
    exact = a.eqNullSafe(b)
    if not tolerance:
        return exact
    floats = (kind_of(a) == "float") & (kind_of(b) == "float")
    return exact | F.coalesce(floats & (F.abs(number_of(a) - number_of(b)) < TOLERANCE), F.lit(False))


def jaccard(a: Column, b: Column) -> Column:
    """Intersection over union of two arrays as sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def same_argument(a: Column, b: Column) -> Column:
    """Arguments that count as the same: lists of integers by similarity, floats by tolerance, else equality."""
    numbers = r"^\[\s*-?\d+(\s*,\s*-?\d+)*\s*\]$"
    lists = a.rlike(numbers) & b.rlike(numbers)
    ints = lambda c: F.from_json(c, "array<bigint>")
    return F.when(lists, jaccard(ints(a), ints(b)) >= SAME_LIST).otherwise(same_value(a, b))


def likelihood(positives: Column, negatives: Column) -> Column:
    return 1 / (1 + F.exp(-0.1 * (positives - negatives)))


def hypothesis_value(value: Column) -> Column:
    """Text by which values of a periodic variable are compared: numbers with seven decimals, lists by their L1 norm."""
    norm = F.aggregate(F.from_json(value, "array<double>"), F.lit(0.0), lambda s, x: s + F.abs(x))
    return F.when(kind_of(value).isin("int", "float"), F.format_string("%.7f", number_of(value))).when(kind_of(value) == "array", F.format_string("%.7f", norm)).otherwise(value)


def short_name(name: Column) -> Column:
    """From the first capitalised part of a dotted name on, else its last two parts."""
    capital = F.regexp_extract(name, r"(?:^|\.)(\p{Lu}[^.]*(?:\..*)?)$", 1)
    return F.when(capital != "", capital).otherwise(F.substring_index(name, ".", -2))


def display_attribute(attr: Column) -> Column:
    """Attribute name without the producer's own prefix (underscore, capitals, underscore)."""
    return F.regexp_replace(attr, r"^_[A-Z]+_", "")


def normalised_line(line: Column) -> Column:
    return F.regexp_replace(line, r"\d+", "0")


def canonical_json(value: Column) -> Column:
    """Canonical text of a JSON text: variants print objects with sorted keys."""
    return F.to_json(F.try_parse_json(value))


def flatten_json(rows: DataFrame, keys: list[str], json: str, depth: int = 6, prefix: str = "") -> DataFrame:
    """(keys, path, value_json): leaves of a JSON text by dotted path; empty objects are leaves, lists stay whole."""
    work = rows.select(*keys, F.lit(prefix).alias("path"), F.try_parse_json(json).alias("v"), F.lit(False).alias("leaf"))
    out = None
    for _ in range(depth):
        is_object = F.schema_of_variant("v").startswith("OBJECT<") & (F.to_json("v") != "{}")
        leaves = work.filter(~is_object).select(*keys, "path", F.to_json("v").alias("value_json"))
        out = leaves if out is None else out.unionByName(leaves)
        nested = work.filter(is_object)
        fields = F.map_entries(F.col("v").cast("map<string,variant>"))
        work = nested.select(*keys, F.col("path").alias("above"), F.explode(fields).alias("e")).select(
            *keys, F.when(F.col("above") == "", F.col("e.key")).otherwise(F.concat_ws(".", "above", "e.key")).alias("path"), F.col("e.value").alias("v"), F.lit(False).alias("leaf")
        )
    deeper = work.select(*keys, "path", F.to_json("v").alias("value_json"))
    return out.unionByName(deeper)


def value_stats(values: Column) -> Column:
    """min, max, mean, std (population) and length of an array of numbers."""
    n = F.size(values)
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    mean = F.try_divide(total, n)
    spread = F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean))
    return F.struct(F.array_min(values).alias("min"), F.array_max(values).alias("max"), mean.alias("mean"), F.sqrt(F.try_divide(spread, n)).alias("std"), n.alias("n"))
