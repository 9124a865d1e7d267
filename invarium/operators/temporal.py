"""Joins and groupings over time."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def point_in_interval(points: DataFrame, intervals: DataFrame, keys: Iterable[str], point: str, lo: str, hi: str) -> DataFrame:
    """Points joined to the intervals [lo, hi] that hold them, by equal ``keys``.

    An interval is entered on the grid that fits its length, in powers of four,
    so that it covers five cells at most however long it is; a point is looked
    up once on every grid in use.  The join is hence by equality, with the
    bounds as a residual, and no interval is exploded without limit.

    The grids in use are a row of 32 flags at most, which meets the points in
    the same plan: nothing is run ahead of it.
    """
    keys = list(keys)
    length = F.greatest(F.col(hi) - F.col(lo), F.lit(1))
    level = (F.ceil(F.log2(length.cast("double")) / 2) * 2).cast("int")
    entered = intervals.withColumn("__level", level)
    used = entered.agg(F.collect_set("__level").alias("__levels"))  # one row, 32 values at most
    cells = entered.withColumn("__cell", F.explode(F.expr(f"sequence(shiftright({lo}, __level), shiftright({hi}, __level))")))
    looked = points.join(F.broadcast(used), F.lit(True)).withColumn("__level", F.explode("__levels")).drop("__levels").withColumn("__cell", F.expr(f"shiftright({point}, __level)"))
    joined = looked.join(cells, [*keys, "__level", "__cell"])
    return joined.filter((F.col(point) >= F.col(lo)) & (F.col(point) <= F.col(hi))).drop("__level", "__cell")


def without_point(intervals: DataFrame, points: DataFrame, keys: Iterable[str], point: str, lo: str, hi: Column) -> DataFrame:
    """Intervals [lo, hi] that hold no point of equal ``keys``.

    An interval stays one row, in the cell of its start on the grid that fits
    its length; a point is entered in its own cell and the one before, on each
    of the 32 grids at most.
    """
    keys = list(keys)
    level = (F.ceil(F.log2(F.greatest(hi - F.col(lo), F.lit(1)).cast("double")) / 2) * 2).cast("int")
    placed = intervals.withColumn("__hi", hi).withColumn("__level", level).withColumn("__cell", F.expr(f"shiftright({lo}, __level)"))
    used = placed.agg(F.collect_set("__level").alias("__levels"))  # one row, 32 values at most
    looked = points.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(point).alias("__point")).join(F.broadcast(used), F.lit(True)).select("*", F.explode("__levels").alias("__grid"))
    own = F.expr("shiftright(__point, __grid)")
    looked = looked.withColumn("__at", F.explode(F.array(own, own - 1))).drop("__levels")
    same = (F.col("__level") == F.col("__grid")) & (F.col("__cell") == F.col("__at")) & (F.col("__point") >= F.col(lo)) & (F.col("__point") <= F.col("__hi"))
    for k in keys:
        same = same & (F.col(k) == F.col(f"__{k}"))
    return placed.join(looked, same, "left_anti").drop("__hi", "__level", "__cell")


def interval_overlap(a: DataFrame, b: DataFrame, keys: Iterable[str], a_range: tuple[str, str], b_range: tuple[str, str]) -> DataFrame:
    """Pairs whose closed intervals meet: the later start lies in the other interval."""
    keys = list(keys)
    later_b = point_in_interval(b, a, keys, b_range[0], *a_range)
    later_a = point_in_interval(a, b, keys, a_range[0], *b_range).filter(F.col(a_range[0]) > F.col(b_range[0]))
    return later_b.unionByName(later_a)


def islands(rows: DataFrame, keys: Iterable[str], order: Iterable[str], value: Column) -> DataFrame:
    """Adds ``state_no``: the number of the run of equal consecutive values (null equals null)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = F.when(F.row_number().over(w) == 1, 1).when(~value.eqNullSafe(F.lag(value).over(w)), 1).otherwise(0)
    return rows.withColumn("__changed", changed).withColumn("state_no", F.sum("__changed").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__changed")


def next_where(keys: Iterable[str], order: Iterable[str], wanted: Column, value: Column) -> Column:
    """Value of the first following row of the same keys where ``wanted`` holds.

    Read backwards, so that the frame only grows and each row is looked at once.
    """
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(F.when(wanted, value), ignorenulls=True).over(w)


def overlap_share(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    """Length of the intersection over that of the union; 0 for disjoint or touching intervals."""
    common = F.least(a_hi, b_hi) - F.greatest(a_lo, b_lo)
    whole = F.greatest(a_hi, b_hi) - F.least(a_lo, b_lo)
    return F.when(common <= 0, F.lit(0.0)).otherwise(common / whole)
