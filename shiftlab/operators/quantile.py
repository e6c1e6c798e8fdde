"""Exact quantiles without pulling a column into one task.

``percentile``/``median`` keep every value of a group in one buffer, so a
global median is a single task over the whole column.  Here each pass is a
distributed histogram (at most ``HIST_BINS`` rows to the driver) that narrows
a wanted rank's value window; the bin that holds the rank has its exact least
and greatest value, which are the next window, so each pass leaves fewer
distinct values until one is left.  The ranks of an interpolated quantile have
windows of their own, so far-apart middle values need no special case.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HIST_BINS = 4096


def _value_at(d: DataFrame, rank: int, lo: float, hi: float, below: int, seen: dict) -> float:
    """The value at 0-based ``rank`` of the finite double column ``v``, which lies in [lo, hi];
    ``below`` rows are less than ``lo``.  ``seen`` keeps histograms by window."""
    v = F.col("v")
    while lo < hi:
        if (lo, hi) not in seen:
            # Halves, so that the width of the largest doubles is finite.
            place = (v / 2 - F.lit(lo / 2)) / F.lit(hi / 2 - lo / 2)
            b = F.least(F.floor(place * HIST_BINS), F.lit(HIST_BINS - 1))
            b = F.when(v == F.lit(lo), 0).when(v == F.lit(hi), HIST_BINS - 1).otherwise(b).cast("int")
            seen[lo, hi] = (d.where(v.between(lo, hi)).groupBy(b.alias("b"))
                            .agg(F.count(F.lit(1)).alias("c"), F.min(v).alias("lo"), F.max(v).alias("hi"))
                            .orderBy("b").collect())
        for row in seen[lo, hi]:
            if rank < below + row["c"]:
                lo, hi = float(row["lo"]), float(row["hi"])
                break
            below += row["c"]
    return lo


def exact_quantile(df: DataFrame, column: str, p: float) -> float | None:
    """Linear-interpolated quantile of the values that are neither NULL nor NaN.

    Infinities take part by order; they stay out of the histograms.
    """
    v = F.col("v")
    d = df.select(F.col(column).cast("double").alias("v")).where(v.isNotNull() & ~F.isnan(v))
    inf = F.lit(float("inf"))
    finite = (v > -inf) & (v < inf)
    n, low, n_finite, lo, hi = d.agg(
        F.count(F.lit(1)), F.count(F.when(v == -inf, 1)), F.count(F.when(finite, 1)),
        F.min(F.when(finite, v)), F.max(F.when(finite, v))).first()
    if n == 0:
        return None
    d, seen = d.where(finite), {}

    def at(rank: int) -> float:
        if rank < low:
            return -math.inf
        return math.inf if rank >= low + n_finite else _value_at(d, rank - low, float(lo), float(hi), 0, seen)

    pos = (n - 1) * p
    k = int(math.floor(pos))
    a = at(k)
    if k == pos:
        return a
    b = at(k + 1)
    if a == b:
        return a
    return a / 2 + b / 2 if p == 0.5 and math.isinf(a + b) else (a + b) / 2 if p == 0.5 else a + (b - a) * (pos - k)


def exact_median(df: DataFrame, column: str) -> float | None:
    """Median as pandas computes it: mean of the two middle values."""
    return exact_quantile(df, column, 0.5)
