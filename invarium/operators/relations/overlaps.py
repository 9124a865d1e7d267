"""Counting pairs of intervals that share enough of their time, without making them.

Of two intervals with starts s and ends e, the shared time is more than a
hundredth of the whole where

    100 e_i + s_i > 100 s_j + e_j, the same with i and j exchanged,
    100 len_i > len_j, and the same with i and j exchanged.

Of the failures of these four only one of the first two meets one of the last
two, so that pairs are counted by sorting, and the meetings as dominance in the
plane; all in whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An interval's share of time, as one of so many parts.
PARTS = 100
#: Rows of a side up to which a count is one task.
CHUNK = 1 << 19


def dominated(x: np.ndarray, p: np.ndarray, y: np.ndarray, q: np.ndarray) -> int:
    """Number of (i, j) with x[i] <= y[j] and p[i] <= q[j]: bit by bit over the ranks of x, in the order of p."""
    n = len(x)
    order = np.argsort(p, kind="stable")
    hi = np.searchsorted(p[order], q, "right")
    by_x = np.argsort(x, kind="stable")
    r = np.searchsorted(x[by_x], y, "right")
    some = (hi > 0) & (r > 0)
    hi, r = hi[some], r[some]
    lo = np.zeros_like(hi)
    rank = np.empty(n, np.int64)
    rank[by_x] = np.arange(n)
    rank, out = rank[order], 0
    for bit in range(n.bit_length() - 1, -1, -1):
        one = (rank >> bit) & 1 == 1
        zeros = np.concatenate([[0], np.cumsum(~one)])
        z_lo, z_hi = zeros[lo], zeros[hi]
        up = (r >> bit) & 1 == 1
        out += int((z_hi - z_lo)[up].sum())
        lo, hi = np.where(up, zeros[-1] + lo - z_lo, z_lo), np.where(up, zeros[-1] + hi - z_hi, z_hi)
        rank = np.concatenate([rank[~one], rank[one]])
    return out


def _at_most(x: np.ndarray, y: np.ndarray) -> int:
    return int(np.searchsorted(np.sort(x), y, "right").sum())


def _half(a: tuple, b: tuple) -> int:
    """Failures of the conditions that name ``a`` first."""
    (u, _, n), (_, v, m) = a, b
    return _at_most(u, v) + _at_most(PARTS * n, m) - dominated(u, PARTS * n, v, m) - dominated(u, -n, v, -PARTS * m)


def count_pairs(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray] | None = None) -> int:
    """Pairs of one (start, end) of ``a`` and one of ``b``, or of two of ``a``; all ends lie behind their starts."""
    sides = [a] if b is None else [a, b]
    if any(len(s) == 0 for s, _ in sides):
        return 0
    first, last = min(int(s.min()) for s, _ in sides), max(int(e.max()) for _, e in sides)
    kind = np.int64 if last - first < (1 << 55) else object  # a hundred times it is a long
    made = []
    for s, e in sides:
        s, e = (s - first).astype(kind), (e - first).astype(kind)
        made.append((PARTS * e + s, PARTS * s + e, e - s))
    if b is None:
        n = len(a[0])
        return n * (n - 1) // 2 - _half(made[0], made[0])
    return len(a[0]) * len(b[0]) - _half(made[0], made[1]) - _half(made[1], made[0])


def counted(rows: DataFrame, job: list[str]) -> DataFrame:
    """(job, n): pairs of each job's intervals.

    ``rows(job, twofold, side, id, start_ns, end_ns)``: a ``twofold`` job pairs
    side 0 with side 1, another one side 0 with itself.  A large job is dealt
    out in chunks, every two of which meet in a task.
    """
    sizes = rows.groupBy(*job, "twofold").agg(F.count_if(F.col("side") == 0).alias("__n"), F.count_if(F.col("side") == 1).alias("__m"))
    sizes = sizes.filter("IF(twofold, __n > 0 AND __m > 0, __n > 1)").select(*job, F.ceil(F.greatest("__n", "__m") / CHUNK).cast("int").alias("__chunks"))
    dealt = rows.join(sizes, job).withColumn("__own", F.pmod(F.xxhash64("id", "start_ns"), F.col("__chunks")).cast("int")).withColumn("__other", F.explode(F.expr("sequence(0, __chunks - 1)")))
    # where both sides are one, the chunk with the smaller number is the left one
    right = F.when(F.col("twofold"), F.col("side") == 1).otherwise(F.col("__own") > F.col("__other"))
    placed = dealt.select(
        *job, "start_ns", "end_ns", right.alias("__right"), (F.col("twofold") | (F.col("__own") != F.col("__other"))).alias("__two"),
        F.when(right, F.col("__other")).otherwise(F.col("__own")).alias("__a"), F.when(right, F.col("__own")).otherwise(F.col("__other")).alias("__b"),
    )

    def count(table: pa.Table) -> pa.Table:
        s, e, side = (table.column(c).to_numpy() for c in ("start_ns", "end_ns", "__right"))
        side = side.astype(bool)
        n = count_pairs((s[~side], e[~side]), (s[side], e[side])) if table.column("__two")[0].as_py() else count_pairs((s, e))
        return table.slice(0, 1).select(job).append_column("n", pa.array([n], pa.int64()))

    types = dict(rows.dtypes)
    parts = placed.groupBy(*job, "__a", "__b").applyInArrow(count, ", ".join(f"`{c}` {types[c]}" for c in job) + ", n long")
    return parts.groupBy(*job).agg(F.sum("n").alias("n"))
