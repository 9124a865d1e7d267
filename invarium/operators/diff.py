"""Differences between traces and between invariant sets."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from invarium.functions.values import normalised_line

#: Endings of keys that differ from run to run.
VOLATILE = ("_id", "time", "time_ns", "_millis", "_str", "idx")
EDIT_LIMIT, PATTERN_LIMIT = 4, 3


def volatile(path: Column) -> Column:
    out = F.lit(False)
    for s in VOLATILE:
        out = out | path.endswith(s)
    return out


def diff_fields(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Paths that differ: (keys, path, left_json, right_json, change) with added, removed and changed.

    Volatile keys are left out on the left side only: on the right they count
    as added.
    """
    a = left.filter(~volatile(F.col("path"))).select(*keys, "path", F.col("value_json").alias("left_json"))
    b = right.select(*keys, "path", F.col("value_json").alias("right_json"))
    both = a.join(b, [*keys, "path"], "full_outer")
    change = F.when(F.col("left_json").isNull(), "added").when(F.col("right_json").isNull(), "removed").otherwise("changed")
    return both.filter(~F.col("left_json").eqNullSafe(F.col("right_json"))).withColumn("change", change)


def count_leaves(fields: DataFrame, keys: list[str]) -> DataFrame:
    return fields.groupBy(*keys).agg(F.count("*").alias("n_leaves"))


def greedy_match(left: list[tuple[int, dict]], right: list[tuple[int, dict]]) -> list[tuple[int, int, int]]:
    """(left_no, right_no, n_diff): left rows in order take the unused right row, no earlier than they are, with the fewest differences.

    Of equals the earlier one; rows with different ``type`` do not match.
    Volatile keys do not count.  Rows of equal content are looked at once, each
    content knowing its next unused row.
    """
    plain = lambda fields: tuple(sorted((k, v) for k, v in fields.items() if v is not None and not k.endswith(VOLATILE)))
    places: dict[tuple, list[int]] = {}
    for no, fields in sorted(right, key=lambda r: r[0]):
        places.setdefault((plain(fields), fields.get("type")), []).append(no)
    contents, numbers = list(places), list(places.values())
    sets = [frozenset(c[0]) for c in contents]
    follow = [list(range(len(n) + 1)) for n in numbers]  # the next unused row at or after a place

    def unused(c: int, at: int) -> int:
        own, path = follow[c], []
        while own[at] != at:
            path.append(at)
            at = own[at]
        for x in path:
            own[x] = at
        return at

    ranked: dict[tuple, list[tuple[int, list[int]]]] = {}

    def levels(content: tuple, kind) -> list[tuple[int, list[int]]]:
        """Right contents by their number of differences."""
        if (content, kind) not in ranked:
            by: dict[int, list[int]] = {}
            mine = set(content)
            for c, (_, other) in enumerate(contents):
                if kind is None or other is None or kind == other:
                    by.setdefault(len({k for k, _ in mine ^ sets[c]}), []).append(c)
            ranked[content, kind] = sorted(by.items())
        return ranked[content, kind]

    out = []
    for no, fields in sorted(left, key=lambda r: r[0]):
        for n_diff, own in levels(plain(fields), fields.get("type")):
            at = [(numbers[c][p], c, p) for c in own if (p := unused(c, bisect_left(numbers[c], no))) < len(numbers[c])]
            if at:
                right_no, c, p = min(at)
                follow[c][p] = p + 1
                out.append((no, right_no, n_diff))
                break
    return out


def best_matches(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Greedy matches of rows of the same ``keys``: (keys, left_no, right_no, n_diff).

    ``left`` and ``right`` are (keys, no, fields MAP<STRING,STRING>); a row looks
    at all rows from its own number on.  The choice is sequential within a key,
    which one task holds: its work grows with rows times distinct contents.
    """
    kinds = dict(left.dtypes)
    columns = [*keys, "left_no", "right_no", "n_diff"]

    def match(key, ours, theirs):
        if ours.empty or theirs.empty:
            return pd.DataFrame([], columns=columns)
        rows = lambda pdf: list(zip(pdf.iloc[:, -2].tolist(), (dict(f) for f in pdf.iloc[:, -1])))
        return pd.DataFrame([(*key, *m) for m in greedy_match(rows(ours), rows(theirs))], columns=columns)

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", left_no long, right_no long, n_diff long"
    ours = left.select(*keys, "no", "fields").groupBy(*keys)
    names = [f"right_{k}" for k in keys]  # both sides may come from one table
    theirs = right.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col("no").alias("right_no"), F.col("fields").alias("right_fields")).groupBy(*names)
    return ours.cogroup(theirs).applyInPandas(match, schema)


def edits(matches: DataFrame, left: DataFrame, right: DataFrame, keys: list[str], limit: int = EDIT_LIMIT) -> DataFrame:
    """(keys, no, kind): ``edit`` for matches of few differences, else ``delete`` and ``insert``."""
    near = matches.filter(F.col("n_diff") <= limit)
    edited = near.filter("n_diff > 0").select(*keys, F.col("left_no").alias("no"), F.lit("edit").alias("kind"))
    gone = left.select(*keys, "no").join(near.select(*keys, F.col("left_no").alias("no")), [*keys, "no"], "left_anti").withColumn("kind", F.lit("delete"))
    new = right.select(*keys, "no").join(near.select(*keys, F.col("right_no").alias("no")), [*keys, "no"], "left_anti").withColumn("kind", F.lit("insert"))
    return edited.unionByName(gone).unionByName(new)


def patterns(lines: DataFrame) -> DataFrame:
    """Lines grouped by what is left when numbers are made equal."""
    return lines.groupBy(normalised_line(F.col("line")).alias("pattern")).agg(F.count("*").alias("n"), F.min("line").alias("sample"))


def anomalies(good: DataFrame, bad: DataFrame) -> DataFrame:
    """Patterns of the second diff that the first does not have."""
    return patterns(bad).join(patterns(good).select("pattern"), "pattern", "left_anti")


def without_common(a: Column, b: Column) -> Column:
    """Entries of map ``a`` that map ``b`` does not have with the same value."""
    return F.map_filter(a, lambda k, v: ~v.eqNullSafe(F.try_element_at(b, k)))


def match_invariants(left: DataFrame, right: DataFrame) -> DataFrame:
    """Invariant sets by identity: (inv_id, side) with both, left or right."""
    both = left.select("inv_id", F.lit(1).alias("l")).join(right.select("inv_id", F.lit(1).alias("r")), "inv_id", "full_outer")
    return both.select("inv_id", F.when(F.col("l").isNull(), "right").when(F.col("r").isNull(), "left").otherwise("both").alias("side"))
