"""Stratified subsample, train/test split, folds and learning-curve prefixes.

Per-class quotas come from largest-remainder allocation on the (small) class
count table; membership comes from ``hash_rank``, so splits are reproducible and
do not change when the input is repartitioned (``randomSplit`` is neither
stratified nor stable).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftlab.functions.hashing import DEFAULT_SEED
from shiftlab.operators.rebalance import count_stats
from shiftlab.operators.sampling import Q, hash_rank, prepare, rank_cut

# Learning-curve size fractions: 8 evenly spaced values from 0.1 to 1.0.
LEARNING_CURVE_FRACTIONS = [float(x) for x in np.linspace(0.1, 1.0, 8)]


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def stratified_quota(counts: DataFrame, label: str, total: int, target: int) -> DataFrame:
    """Split ``target`` over classes proportionally to ``n``: floor shares, then
    one extra row to the largest remainders (ties: class ascending).  Exact
    integer arithmetic; the window runs over the class table only."""
    base = counts.select(
        label, "n",
        F.expr(f"(n * {int(target)}) div {int(total)}").cast("bigint").alias("_base"),
        ((F.col("n") * F.lit(target)) % F.lit(total)).alias("_rem"))
    w_all = Window.partitionBy()
    w_ord = Window.orderBy(F.col("_rem").desc(), F.col(label).asc())
    q = (base.withColumn("_left", F.lit(target) - F.sum("_base").over(w_all))
         .withColumn("_rn", F.row_number().over(w_ord))
         .select(label, "n", (F.col("_base") + F.when(F.col("_rn") <= F.col("_left"), 1).otherwise(0))
                 .alias(Q)))
    return q


MAX_LOCAL_GROUPS = 100_000


def local_group_sizes(hp, label: str) -> list[tuple] | None:
    """Per-class sizes as a driver list (one small job), or None when there are
    too many classes to hold (then the quota stays a distributed table)."""
    rows = hp.group_sizes().limit(MAX_LOCAL_GROUPS + 1).collect()
    if len(rows) > MAX_LOCAL_GROUPS:
        return None
    return [(r[label], int(r["n"])) for r in rows]


def largest_remainder(sizes: list[tuple], target: int) -> dict:
    """Driver twin of :func:`stratified_quota` (same integer arithmetic and ties)."""
    total = sum(n for _, n in sizes)
    base = {v: n * target // total for v, n in sizes}
    rem = {v: n * target % total for v, n in sizes}
    left = target - sum(base.values())
    order = sorted(sizes, key=lambda t: (-rem[t[0]], t[0] is not None, t[0]))
    for v, _ in order[:max(left, 0)]:
        base[v] += 1
    return base


def _quota_frame(df: DataFrame, label: str, quota: dict) -> DataFrame:
    schema = T.StructType([T.StructField(label, df.schema[label].dataType),
                           T.StructField(Q, T.LongType())])
    return df.sparkSession.createDataFrame([(v, int(q)) for v, q in quota.items()], schema)


def stratified_subsample(df: DataFrame, label: str, max_n: int, key: Sequence[str],
                         seed: int = DEFAULT_SEED, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Keep exactly ``max_n`` rows, proportional per class (all of them if fewer).

    Rows without a label are dropped first, whatever ``max_n`` is.
    """
    df = df.where(F.col(label).isNotNull())
    hp = prepare(df, [label], key, seed)
    counts = hp.group_sizes()
    st = count_stats(counts)
    if st.rows <= max_n:
        return df
    quota = stratified_quota(counts, label, st.rows, max_n)
    return rank_cut(df, quota.select(label, Q), [label], key, seed, tiebreak, n_groups=st.groups, prepared=hp)


def train_test_split(df: DataFrame, label: str, key: Sequence[str], test_size: float = 0.2,
                     seed: int = DEFAULT_SEED, tiebreak: Sequence[str] = (),
                     split_col: str = "split") -> DataFrame:
    """Add ``split`` = 'test' / 'train'; ``ceil(test_size * n)`` test rows of the ``n`` labelled ones,
    stratified.  Rows without a label are dropped before counting."""
    out, _ = train_test_split_info(df, label, key, test_size, seed, tiebreak, split_col)
    return out


def train_test_split_info(df: DataFrame, label: str, key: Sequence[str], test_size: float = 0.2,
                          seed: int = DEFAULT_SEED, tiebreak: Sequence[str] = (),
                          split_col: str = "split") -> tuple[DataFrame, dict | None]:
    """S02 plus what the split learnt on the way: ``classes`` (sorted) and
    ``train_counts`` per class, or None when the class table stays distributed."""
    df = df.where(F.col(label).isNotNull())
    hp = prepare(df, [label], key, seed)
    sizes = local_group_sizes(hp, label)
    info = None
    if sizes is None:
        counts = hp.group_sizes()
        st = count_stats(counts)
        quota = stratified_quota(counts, label, st.rows, math.ceil(test_size * st.rows)).select(label, Q)
        n_groups = st.groups
    else:
        total = sum(n for _, n in sizes)
        q = largest_remainder(sizes, math.ceil(test_size * total)) if total else {}
        quota = _quota_frame(df, label, q)
        n_groups = len(sizes)
        info = {"classes": sorted(v for v, _ in sizes if v is not None),
                "train_counts": {v: n - q.get(v, 0) for v, n in sizes}}
    out = rank_cut(df, quota, [label], key, seed, tiebreak, flag="_is_test", n_groups=n_groups, prepared=hp)
    out = out.withColumn(split_col, F.when(F.col("_is_test"), F.lit("test")).otherwise(F.lit("train"))) \
        .drop("_is_test")
    return out, info


def stratified_folds(df: DataFrame, label: str, key: Sequence[str], folds: int = 5,
                     seed: int = DEFAULT_SEED, tiebreak: Sequence[str] = (),
                     fold_col: str = "fold") -> tuple[DataFrame, int]:
    """``fold = hash_rank % k`` within class, ``k = min(folds, smallest class)``.

    Returns the frame with a fold column and ``k`` (0 when a class has one row).
    Rows without a label are dropped before counting.
    """
    df = df.where(F.col(label).isNotNull())
    hp = prepare(df, [label], key, seed)
    st = count_stats(hp.group_sizes())
    k = min(folds, st.min)
    ranked = hash_rank(df, [label], key, seed, tiebreak, "_fr", n_groups=st.groups, prepared=hp)
    return ranked.withColumn(fold_col, (F.col("_fr") % F.lit(max(k, 1))).cast("int")).drop("_fr"), k


def learning_curve_sizes(n_max: int, fractions: Sequence[float] = LEARNING_CURVE_FRACTIONS) -> list[int]:
    """Absolute training sizes: ``int(f * n_max)``, distinct, ascending."""
    return sorted({int(f * n_max) for f in fractions if int(f * n_max) > 0})


def fold_train_positions(df: DataFrame, fold_col: str, k: int, key: Sequence[str],
                         seed: int = DEFAULT_SEED, tiebreak: Sequence[str] = ()) -> DataFrame:
    """For every fold ``f``, each row outside ``f`` with its position in
    ``f``'s training part.  Training prefix of size s for fold f is
    ``cv_fold = f AND pos < s``; prefixes are nested by construction."""
    folds = F.array(*[F.lit(i) for i in range(k)])
    x = df.withColumn("cv_fold", F.explode(F.filter(folds, lambda f: f != F.col(fold_col))))
    return hash_rank(x, ["cv_fold"], key, seed, tiebreak, "pos", n_groups=k)


__all__ = ["stratified_quota", "stratified_subsample", "train_test_split", "stratified_folds",
           "learning_curve_sizes", "fold_train_positions", "class_counts"]
