"""Rebalance a table by a signed slider in [-1, 1].

Positive sliders up-sample (with replacement), negative ones down-sample
(without replacement); ``|slider| < 0.01`` is the identity.  Target counts are
computed in double arithmetic and truncated, exactly like ``int(a + b * s)``.

Only scalars (min/max class size, number of classes, a median) reach the
driver; the class tables stay distributed and are broadcast only when their
row count is known to be small.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlab.functions.hashing import DEFAULT_SEED
from shiftlab.operators.quantile import exact_median
from shiftlab.operators.sampling import (
    Q,
    _maybe_broadcast,
    draw_with_replacement,
    prepare,
    rank_cut,
)

IDENTITY_EPS = 0.01
MAX_LOCAL_CLASSES = 100_000
KINDS = ("target", "binary", "continuous", "categorical")
GROUP = "_grp"
#: The column that tells a row's copies apart in a sweep: 0 for a row that was kept, else its draw.
COPY = "_copy"


def value_counts(df: DataFrame, col: str, count_col: str = "n") -> DataFrame:
    """Non-NULL value counts, most frequent first (ties: value ascending)."""
    return (df.where(F.col(col).isNotNull()).groupBy(col)
            .agg(F.count(F.lit(1)).alias(count_col))
            .orderBy(F.col(count_col).desc(), F.col(col).asc()))


@dataclass(frozen=True)
class CountStats:
    min: int
    max: int
    groups: int
    rows: int


def count_stats(counts: DataFrame, count_col: str = "n") -> CountStats:
    """One small job: min/max class size, number of classes, total rows."""
    r = counts.agg(F.min(count_col), F.max(count_col), F.count(F.lit(1)),
                   F.sum(count_col)).first()
    return CountStats(int(r[0] or 0), int(r[1] or 0), int(r[2] or 0), int(r[3] or 0))


def up_target(m: int, big: int, slider: float) -> int:
    """Class size that minority classes are raised to."""
    return int(m + (big - m) * slider)


def down_target(m: int, big: int, slider: float) -> int:
    """Class size that majority classes are cut to (never below the minority)."""
    return max(int(big - (big - m) * abs(slider)), m)


@dataclass
class PreparedRebalance:
    """Slider-independent work of one (column, kind), reusable across a sweep:
    the filtered/grouped frame, its cached (group, bucket) counts, and the
    class statistics (target) or the two group sizes (binary, continuous,
    categorical -- median and majority value included)."""

    kind: str
    frame: DataFrame | None
    hp: object | None
    stats: CountStats | None = None
    sizes: dict | None = None
    last_size: int | None = None   # rows produced by the latest rebalance, when known

    def release(self) -> None:
        if self.hp is not None:
            self.hp.bc.unpersist()


def _median_side(c, med: float):
    """'low' up to the median, 'high' above; NULL and NaN, which no comparison holds for, are neither."""
    number = ~F.isnan(c.cast("double"))
    return F.when(number & (c <= F.lit(med)), F.lit("low")).when(number & (c > F.lit(med)), F.lit("high"))


def _group_expr(df: DataFrame, column: str, kind: str):
    c = F.col(column)
    if kind == "binary":
        return F.when(c == 1, F.lit("1")).when(c == 0, F.lit("0"))
    if kind == "continuous":
        med = exact_median(df, column)
        if med is None:
            return None
        return _median_side(c, med)
    if kind == "categorical":
        v = majority_value(df, column)
        if v is None:
            return None
        return F.when(c.eqNullSafe(F.lit(v)), F.lit("major")).otherwise(F.lit("rest"))
    return None


def prepare_rebalance(df: DataFrame, column: str, kind: str, key: Sequence[str],
                      seed: int = DEFAULT_SEED) -> PreparedRebalance | None:
    """Compute once what every slider of a sweep over ``(column, kind)`` shares."""
    if kind == "target":
        d = df.where(F.col(column).isNotNull())
        hp = prepare(d, [column], key, seed)
        hp.bc = hp.bc.cache()
        rows = hp.group_sizes().limit(MAX_LOCAL_CLASSES + 1).collect()
        if len(rows) > MAX_LOCAL_CLASSES:
            return PreparedRebalance(kind, d, hp, stats=count_stats(hp.group_sizes()))
        sizes = {r[column]: int(r["n"]) for r in rows}
        n = list(sizes.values())
        st = CountStats(min(n, default=0), max(n, default=0), len(n), sum(n))
        return PreparedRebalance(kind, d, hp, stats=st, sizes=sizes)
    if kind in ("binary", "continuous", "categorical"):
        expr = _group_expr(df, column, kind)
        if expr is None:
            return PreparedRebalance(kind, None, None)
        g = df.withColumn(GROUP, expr).where(F.col(GROUP).isNotNull())
        hp = prepare(g, [GROUP], key, seed)
        hp.bc = hp.bc.cache()
        sizes = {r[GROUP]: int(r["n"]) for r in hp.group_sizes().collect()}
        return PreparedRebalance(kind, g, hp, sizes=sizes)
    return None


def _numbered(df: DataFrame, copy_col: str | None) -> DataFrame:
    """Rows that are kept as they are: copy 0."""
    return df if copy_col is None else df.withColumn(copy_col, F.lit(0).cast("bigint"))


def rebalance_target(df: DataFrame, column: str, slider: float, key: Sequence[str],
                     seed: int = DEFAULT_SEED, tiebreak: Sequence[str] = (),
                     prepared: PreparedRebalance | None = None, copy_col: str | None = None) -> DataFrame:
    """Move every class size toward the others.

    s > 0: classes smaller than ``T = int(m + (M - m) s)`` are *replaced* by T
    draws with replacement; s < 0: classes larger than
    ``T = max(int(M - (M - m)|s|), m)`` are cut to T.  NULL labels are dropped.

    ``copy_col`` numbers the draws of a class, so that ``key`` and it identify a row; rows that
    are kept have 0.  (All functions here take it.)
    """
    if abs(slider) < IDENTITY_EPS:
        return _numbered(df, copy_col)
    if prepared is not None:
        d, hp, st = prepared.frame, prepared.hp, prepared.stats
    else:
        d = df.where(F.col(column).isNotNull())
        hp = prepare(d, [column], key, seed)
        st = count_stats(hp.group_sizes())
    counts = hp.group_sizes()
    if st.groups == 0:
        return _numbered(d, copy_col)
    if slider > 0:
        t = up_target(st.min, st.max, slider)
        if prepared is not None and prepared.sizes is not None:
            prepared.last_size = sum(t if c < t else c for c in prepared.sizes.values())
        small = counts.where(F.col("n") < t)
        keep = d.join(_maybe_broadcast(counts.where(F.col("n") >= t).select(column), st.groups),
                      column, "left_semi")
        draws = draw_with_replacement(d, small.select(column, F.lit(t).alias(Q)), [column],
                                      key, seed, tiebreak, st.groups, prepared=hp, draw_id=copy_col)
        return _numbered(keep, copy_col).unionByName(draws)
    t = down_target(st.min, st.max, slider)
    if prepared is not None and prepared.sizes is not None:
        prepared.last_size = sum(min(c, t) for c in prepared.sizes.values())
    cut = rank_cut(d, counts.select(column, F.least(F.col("n"), F.lit(t)).alias(Q)),
                   [column], key, seed, tiebreak, n_groups=st.groups, prepared=hp)
    return _numbered(cut, copy_col)


def _two_group(df: DataFrame, group_expr, grow: str, slider: float, up_n, down_n,
               key, seed, tiebreak, other: str, prepared: PreparedRebalance | None = None,
               copy_col: str | None = None) -> DataFrame:
    """Resample group ``grow`` of a two-group split; keep group ``other`` whole."""
    if prepared is not None:
        g, hp, sizes = prepared.frame, prepared.hp, prepared.sizes
    else:
        g = df.withColumn(GROUP, group_expr).where(F.col(GROUP).isNotNull())
        hp = prepare(g, [GROUP], key, seed)
        sizes = {r[GROUP]: int(r["n"]) for r in hp.group_sizes().collect()}
    n_grow, n_other = sizes.get(grow, 0), sizes.get(other, 0)
    if n_grow == 0 or n_other == 0:
        return None
    base = g.where(F.col(GROUP) == other)
    t = up_n(n_grow, n_other) if slider > 0 else down_n(n_grow, n_other)
    if prepared is not None:
        prepared.last_size = n_other + int(t)
    quota = hp.group_sizes().where(F.col(GROUP) == grow).select(GROUP, F.lit(int(t)).alias(Q))
    if slider > 0:
        moved = draw_with_replacement(g, quota, [GROUP], key, seed, tiebreak, 2, prepared=hp,
                                      hash_groups=False, draw_id=copy_col)
    else:
        moved = _numbered(rank_cut(g, quota, [GROUP], key, seed, tiebreak, n_groups=2, prepared=hp), copy_col)
    return _numbered(base, copy_col).unionByName(moved).drop(GROUP)


def rebalance_binary(df: DataFrame, column: str, slider: float, key: Sequence[str],
                     seed: int = DEFAULT_SEED, tiebreak: Sequence[str] = (),
                     prepared: PreparedRebalance | None = None, copy_col: str | None = None) -> DataFrame:
    """Resample the rows with ``column == 1``; rows not 0/1 are dropped.

    s > 0: ``max(int(n1 + (n0 - n1) s), n1)`` draws with replacement (even when
    equal to n1); s < 0: ``max(int(n1 (1 - |s|)), 1)`` rows without.
    Either group empty: input unchanged.
    """
    if abs(slider) < IDENTITY_EPS:
        return _numbered(df, copy_col)
    grp = None if prepared is not None else _group_expr(df, column, "binary")
    out = _two_group(
        df, grp, "1", slider,
        lambda n1, n0: max(int(n1 + (n0 - n1) * slider), n1),
        lambda n1, n0: max(int(n1 * (1 - abs(slider))), 1),
        key, seed, tiebreak, other="0", prepared=prepared, copy_col=copy_col)
    return _numbered(df, copy_col) if out is None else out


def rebalance_continuous(df: DataFrame, column: str, slider: float, key: Sequence[str],
                         seed: int = DEFAULT_SEED, tiebreak: Sequence[str] = (),
                         prepared: PreparedRebalance | None = None, copy_col: str | None = None) -> DataFrame:
    """Split at the exact median (``<=`` low, ``>`` high), resample high.

    s > 0: ``max(int(h (1 + 2 s)), h)`` draws with replacement; s < 0:
    ``max(int(h (1 - 0.8|s|)), 1)`` rows without.  NULL and NaN are dropped.
    """
    if abs(slider) < IDENTITY_EPS:
        return _numbered(df, copy_col)
    if prepared is not None and prepared.frame is None:
        return _numbered(df, copy_col)
    grp = None if prepared is not None else _group_expr(df, column, "continuous")
    if prepared is None and grp is None:
        return _numbered(df, copy_col)
    out = _two_group(
        df, grp, "high", slider,
        lambda h, lo: max(int(h * (1 + slider * 2)), h),
        lambda h, lo: max(int(h * (1 - abs(slider) * 0.8)), 1),
        key, seed, tiebreak, other="low", prepared=prepared, copy_col=copy_col)
    return _numbered(df, copy_col) if out is None else out


def majority_value(df: DataFrame, column: str):
    """Most frequent non-NULL value (ties: smallest value)."""
    r = value_counts(df, column).limit(1).collect()
    return r[0][0] if r else None


def rebalance_categorical(df: DataFrame, column: str, slider: float, key: Sequence[str],
                          seed: int = DEFAULT_SEED, tiebreak: Sequence[str] = (),
                          prepared: PreparedRebalance | None = None, copy_col: str | None = None) -> DataFrame:
    """Majority value vs the rest (NULL counts as rest).

    s > 0: the rest gets ``max(int(r + (g - r) s), r)`` draws with replacement;
    s < 0: the majority keeps ``max(int(g (1 - 0.8|s|)), r)`` rows, at most g.
    """
    if abs(slider) < IDENTITY_EPS:
        return _numbered(df, copy_col)
    if prepared is not None and prepared.frame is None:
        return _numbered(df, copy_col)
    grp = None if prepared is not None else _group_expr(df, column, "categorical")
    if prepared is None and grp is None:
        return _numbered(df, copy_col)
    if slider > 0:
        out = _two_group(df, grp, "rest", slider,
                         lambda r, g: max(int(r + (g - r) * slider), r), None,
                         key, seed, tiebreak, other="major", prepared=prepared, copy_col=copy_col)
    else:
        out = _two_group(df, grp, "major", slider, None,
                         lambda g, r: min(max(int(g * (1 - abs(slider) * 0.8)), r), g),
                         key, seed, tiebreak, other="rest", prepared=prepared, copy_col=copy_col)
    return _numbered(df, copy_col) if out is None else out


def rebalance(df: DataFrame, column: str, kind: str, slider: float, key: Sequence[str],
              seed: int = DEFAULT_SEED, tiebreak: Sequence[str] = (),
              prepared: PreparedRebalance | None = None, copy_col: str | None = None) -> DataFrame:
    """Dispatch on ``kind``; an unknown kind returns the input."""
    fn = {
        "target": rebalance_target,
        "binary": rebalance_binary,
        "continuous": rebalance_continuous,
        "categorical": rebalance_categorical,
    }.get(kind)
    if fn is None:
        return _numbered(df, copy_col)
    return fn(df, column, slider, key, seed, tiebreak, prepared=prepared, copy_col=copy_col)


def random_undersample(df: DataFrame, label: str, slider: float, key: Sequence[str],
                       seed: int = DEFAULT_SEED, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Cut every class larger than ``max(int(M - (M - m)|s|), m)`` to that size."""
    if abs(slider) < IDENTITY_EPS:
        return df
    return rebalance_target(df, label, -abs(slider), key, seed, tiebreak)


def random_oversample(df: DataFrame, label: str, slider: float, key: Sequence[str],
                      seed: int = DEFAULT_SEED, tiebreak: Sequence[str] = (), copy_col: str | None = None) -> DataFrame:
    """Keep all rows and append ``T - n_c`` draws to classes below ``T``."""
    if abs(slider) < IDENTITY_EPS:
        return _numbered(df, copy_col)
    d = df.where(F.col(label).isNotNull())
    hp = prepare(d, [label], key, seed)
    counts = hp.group_sizes()
    st = count_stats(counts)
    t = up_target(st.min, st.max, slider)
    need = counts.where(F.col("n") < t).select(label, (F.lit(t) - F.col("n")).alias(Q))
    extra = draw_with_replacement(d, need, [label], key, seed, tiebreak, st.groups, prepared=hp, draw_id=copy_col)
    if copy_col:
        extra = extra.withColumn(copy_col, F.col(copy_col) + 1)  # the rows themselves are 0
    return _numbered(d, copy_col).unionByName(extra)


def distribution_stats(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """Per class original/modified counts, difference and % change.

    Classes are the union of both sides (full outer join); ``pct_change`` is
    unrounded and 0 when the original count is 0.
    """
    b = before.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("original"))
    a = after.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("modified"))
    j = b.join(a, column, "full_outer").select(
        F.col(column).alias("class"),
        F.coalesce("original", F.lit(0)).alias("original"),
        F.coalesce("modified", F.lit(0)).alias("modified"))
    return (j.withColumn("difference", F.col("modified") - F.col("original"))
            .withColumn("pct_change",
                        F.when(F.col("original") > 0,
                               (F.col("modified") - F.col("original")) / F.col("original") * F.lit(100.0))
                        .otherwise(F.lit(0.0)))
            .orderBy("class"))


def binary_groups(df: DataFrame, column: str) -> DataFrame:
    """Tag rows 0/1 by ``column`` (other values dropped)."""
    c = F.col(column)
    return df.withColumn("group", F.when(c == 1, F.lit(1)).when(c == 0, F.lit(0))).where(
        F.col("group").isNotNull())


def median_groups(df: DataFrame, column: str) -> DataFrame:
    """Tag rows low (``<=`` exact median) / high; NULL and NaN dropped."""
    med = exact_median(df, column)
    side = F.lit(None).cast("string") if med is None else _median_side(F.col(column), med)
    return df.withColumn("group", side).where(F.col("group").isNotNull())


def majority_groups(df: DataFrame, column: str) -> DataFrame:
    """Tag rows major (the most frequent value) / rest (including NULL)."""
    v = majority_value(df, column)
    c = F.col(column)
    return df.withColumn("group", F.when(c.eqNullSafe(F.lit(v)), F.lit("major")).otherwise(F.lit("rest")))


__all__ = [
    "value_counts", "count_stats", "rebalance", "rebalance_target", "rebalance_binary",
    "rebalance_continuous", "rebalance_categorical", "random_undersample",
    "random_oversample", "distribution_stats", "binary_groups", "median_groups",
    "majority_groups",
]
