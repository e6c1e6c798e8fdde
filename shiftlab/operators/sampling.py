"""Exact-size, reproducible sampling: the primitive under every resampler.

``hash_rank`` is the 0-based position of a row inside its group when rows are
ordered by ``(md5(seed|key), key, tiebreak)``.  In SQL that is::

    row_number() OVER (PARTITION BY g ORDER BY md5(concat_ws('|', seed, key)), key) - 1

A plain window like that puts a whole group on one task, and a group can hold a
third of the table.  Here the leading hex digits of the hash cut every group
into ``NUM_BUCKETS`` buckets; a tiny ``(group, bucket) -> count`` table gives
each bucket its offset, so

* taking the first ``n`` rows of a group keeps whole buckets by a narrow filter
  and ranks only inside the single boundary bucket, and
* a full rank is a window over ``(group, bucket)`` pieces plus an offset.

Results do not depend on partitioning or task retries.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftlab.functions.hashing import (
    DEFAULT_SEED,
    NUM_BUCKETS,
    draw_hash,
    hash_bucket,
    row_hash,
)
from shiftlab.session import BROADCAST_MAX_ROWS

H, B, G0 = "_sh_h", "_sh_b", "_sh_g"
Q, N = "_q", "_n"
# Draws are generated in chunks so that no task explodes more than this many.
DRAW_CHUNK_ROWS = 1 << 20
# Draws that meet one row under one join key: a row drawn more often is dealt over salts.
DRAWS_PER_KEY = 1024


def _maybe_broadcast(small: DataFrame, rows_bound: int | None) -> DataFrame:
    """Broadcast only a side whose row count is known to be bounded."""
    if rows_bound is not None and rows_bound <= BROADCAST_MAX_ROWS:
        return F.broadcast(small)
    return small


def _group_bound(counts: DataFrame, by: Sequence[str]) -> int:
    """The number of groups, by a job that reads keys only and returns one number; past the
    broadcast bound it stops counting, as the joins shuffle then."""
    return counts.select(*by).distinct().limit(BROADCAST_MAX_ROWS + 1).count()


def _prepare(df: DataFrame, by: Sequence[str], key: Sequence[str], seed: int):
    """Add hash and bucket columns; give an ungrouped frame one constant group."""
    by = list(by)
    if not by:
        df = df.withColumn(G0, F.lit(0))
        by = [G0]
    h = row_hash(key, seed)
    return df.withColumn(H, h).withColumn(B, hash_bucket(F.col(H))), by


def _order(key: Sequence[str], tiebreak: Sequence[str]) -> list[Column]:
    return [F.col(H)] + [F.col(k) for k in key] + [F.col(t) for t in tiebreak]


def _finish(df: DataFrame, added_group: bool) -> DataFrame:
    drop = [H, B] + ([G0] if added_group else [])
    return df.drop(*drop)


def bucket_counts(x: DataFrame, by: Sequence[str]) -> DataFrame:
    """(group, bucket) -> row count; partial aggregation keeps the shuffle tiny."""
    return x.groupBy(*by, B).agg(F.count(F.lit(1)).alias("_bn"))


@dataclass
class Hashed:
    """A frame with its hash/bucket columns and its ``(group, bucket)`` count
    table.  Group sizes, quotas, cut tables and offsets all derive from the
    small count table instead of separate aggregates over the source."""

    x: DataFrame
    by: list[str]
    added: bool
    bc: DataFrame

    def group_sizes(self, count_col: str = "n") -> DataFrame:
        return self.bc.groupBy(*self.by).agg(F.sum("_bn").alias(count_col))


def prepare(df: DataFrame, by: Sequence[str] = (), key: Sequence[str] = (),
            seed: int = DEFAULT_SEED) -> Hashed:
    """Hash ``df`` once; group sizes, quotas and cuts all derive from one
    ``(group, bucket)`` count table (at most groups x buckets rows), which
    Spark computes once per query (exchange reuse) instead of one aggregate
    per use."""
    if not key:
        raise ValueError("a row key is required for reproducible sampling")
    x, gb = _prepare(df, by, key, seed)
    return Hashed(x, gb, not by, bucket_counts(x, gb))


def _cut_table(x: DataFrame, by: list[str], quota: DataFrame | int,
               bc: DataFrame | None = None) -> DataFrame:
    """Per group: the boundary bucket ``_cb`` and how many rows ``_need`` to take in it.

    Buckets ``< _cb`` are taken whole.  A group whose quota covers it gets
    ``_cb = NUM_BUCKETS``; a zero quota gets ``_cb = -1``.
    """
    bc = bucket_counts(x, by) if bc is None else bc
    if isinstance(quota, int):
        qt = bc.groupBy(*by).agg(F.lit(int(quota)).cast("bigint").alias(Q))
    else:
        qt = quota.select(*by, F.col(Q).cast("bigint").alias(Q))
    w = Window.partitionBy(*by).orderBy(B).rowsBetween(Window.unboundedPreceding, 0)
    cum = bc.join(qt, by).withColumn("_cum", F.sum("_bn").over(w))
    edge = cum.where((F.col("_cum") - F.col("_bn") < F.col(Q)) & (F.col("_cum") >= F.col(Q)))
    edge = edge.select(*by, F.col(B).alias("_eb"),
                       (F.col(Q) - (F.col("_cum") - F.col("_bn"))).alias("_en"),
                       F.col("_bn").alias("_ebn"))
    cut = qt.join(edge, by, "left").select(
        *by,
        F.when(F.col("_eb").isNotNull(),
               F.when(F.col("_en") == F.col("_ebn"), F.col("_eb") + 1).otherwise(F.col("_eb")))
        .when(F.col(Q) > 0, F.lit(NUM_BUCKETS)).otherwise(F.lit(-1)).alias("_cb"),
        F.when(F.col("_eb").isNotNull() & (F.col("_en") < F.col("_ebn")), F.col("_en"))
        .otherwise(F.lit(0)).alias("_need"),
    )
    return cut


def rank_cut(df: DataFrame, quota: DataFrame | int, by: Sequence[str] = (),
             key: Sequence[str] = (), seed: int = DEFAULT_SEED,
             tiebreak: Sequence[str] = (), flag: str | None = None,
             n_groups: int | None = None, prepared: Hashed | None = None) -> DataFrame:
    """Rows whose ``hash_rank`` within ``by`` is below the group's quota.

    ``quota`` is an int for every group or a DataFrame ``(*by, _q)``; groups
    missing from it are dropped.  Without ``n_groups`` the groups are counted
    first, so that wide rows are not shuffled on a group key.  With ``flag`` set, every row is kept and the
    boolean column ``flag`` marks the selected ones instead.
    Only the boundary bucket of each group is ranked by a window.
    ``prepared`` (from :func:`prepare` on the same frame) reuses its counts.
    """
    if not key:
        raise ValueError("a row key is required for reproducible sampling")
    hp = prepared or Hashed(*_prepare(df, by, key, seed), not by, None)
    x, gb, added = hp.x, hp.by, hp.added
    if n_groups is None:
        n_groups = 1 if added else _group_bound(x, gb)
    cut = _maybe_broadcast(_cut_table(x, gb, quota, hp.bc), n_groups if not added else 1)
    xc = x.join(cut, gb)
    w = Window.partitionBy(*gb).orderBy(*_order(key, tiebreak))
    edge = xc.where(F.col(B) == F.col("_cb")).withColumn("_rn", F.row_number().over(w))
    if flag is None:
        whole = xc.where(F.col(B) < F.col("_cb"))
        edge = edge.where(F.col("_rn") <= F.col("_need"))
        out = whole.unionByName(edge.drop("_rn"))
    else:
        whole = xc.where(F.col(B) != F.col("_cb")).withColumn(flag, F.col(B) < F.col("_cb"))
        edge = edge.withColumn(flag, F.col("_rn") <= F.col("_need")).drop("_rn")
        out = whole.unionByName(edge)
    return _finish(out.drop("_cb", "_need"), added)


def sample_exact(df: DataFrame, n: DataFrame | int, by: Sequence[str] = (),
                 key: Sequence[str] = (), seed: int = DEFAULT_SEED,
                 tiebreak: Sequence[str] = (), n_groups: int | None = None,
                 prepared: Hashed | None = None) -> DataFrame:
    """Exactly ``min(n, group size)`` rows per group, without replacement."""
    return rank_cut(df, n, by, key, seed, tiebreak, None, n_groups, prepared)


def _ranked(x: DataFrame, by: list[str], key, tiebreak, bc: DataFrame | None = None):
    bc = bucket_counts(x, by) if bc is None else bc
    w = Window.partitionBy(*by).orderBy(B).rowsBetween(Window.unboundedPreceding, 0)
    off = bc.withColumn("_off", F.sum("_bn").over(w) - F.col("_bn")).drop("_bn")
    sizes = bc.groupBy(*by).agg(F.sum("_bn").alias(N))
    wr = Window.partitionBy(*by, B).orderBy(*_order(key, tiebreak))
    ranked = x.withColumn("_rib", F.row_number().over(wr) - 1)
    # The window has dealt and sorted the rows by (group, bucket), so a merge moves the offsets alone; they are
    # up to groups x NUM_BUCKETS rows, too many to pass through the driver in a broadcast.
    ranked = ranked.join(off.hint("merge"), [*by, B])
    ranked = ranked.withColumn("_rank", F.col("_off") + F.col("_rib")).drop("_off", "_rib")
    return ranked, sizes


def hash_rank(df: DataFrame, by: Sequence[str] = (), key: Sequence[str] = (),
              seed: int = DEFAULT_SEED, tiebreak: Sequence[str] = (),
              rank_col: str = "hash_rank", n_groups: int | None = None,
              prepared: Hashed | None = None) -> DataFrame:
    """Add the 0-based ``hash_rank`` of every row within its group."""
    if not key:
        raise ValueError("a row key is required for reproducible ranks")
    hp = prepared or Hashed(*_prepare(df, by, key, seed), not by, None)
    x, gb, added = hp.x, hp.by, hp.added
    ranked, _ = _ranked(x, gb, key, tiebreak, hp.bc)
    return _finish(ranked.withColumnRenamed("_rank", rank_col), added)


def draw_with_replacement(df: DataFrame, quota: DataFrame | int, by: Sequence[str] = (),
                          key: Sequence[str] = (), seed: int = DEFAULT_SEED,
                          tiebreak: Sequence[str] = (), n_groups: int | None = None,
                          chunk_rows: int = DRAW_CHUNK_ROWS, draw_id: str | None = None,
                          prepared: Hashed | None = None, hash_groups: bool = True) -> DataFrame:
    """``_q`` uniform draws with replacement per group.

    Draw ``j`` of group ``g`` picks the row of rank
    ``u60(md5(seed|g|j)) mod group_size``; ``draw_id`` keeps ``j`` as a column.  Draw ids are generated in chunks
    spread over tasks, then joined to the ranked rows on ``(g, rank, salt)``; a group that is
    drawn far more often than it has rows gets as many salts as leave about
    ``DRAWS_PER_KEY`` draws a key, so no key is hot.  With
    ``hash_groups=False`` the group value is left out of the draw hash.
    """
    if not key:
        raise ValueError("a row key is required for reproducible draws")
    hp = prepared or Hashed(*_prepare(df, by, key, seed), not by, None)
    x, gb, added, bc = hp.x, hp.by, hp.added, hp.bc
    if n_groups is None and not added:
        n_groups = _group_bound(x, gb)
    if isinstance(quota, int):
        base = bucket_counts(x, gb) if bc is None else bc
        qt = base.groupBy(*gb).agg(F.lit(int(quota)).cast("bigint").alias(Q))
    else:
        qt = quota.select(*gb, F.col(Q).cast("bigint").alias(Q)).where(F.col(Q) > 0)
        groups = _maybe_broadcast(qt.select(*gb), n_groups)
        x = x.join(groups, gb, "left_semi")
        bc = None if bc is None else bc.join(groups, gb, "left_semi")
    ranked, sizes = _ranked(x, gb, key, tiebreak, bc)
    plan = qt.join(sizes, gb).where(F.col(N) > 0)
    salts = F.ceil(F.col(Q) / (F.col(N) * F.lit(DRAWS_PER_KEY))).cast("bigint")
    nchunks = F.ceil(F.col(Q) / F.lit(chunk_rows)).cast("bigint")
    chunks = plan.select(*gb, Q, N, F.explode(F.sequence(F.lit(0).cast("bigint"), nchunks - 1)).alias("_c"))
    chunks = chunks.repartition("_c", *gb)
    lo = F.col("_c") * chunk_rows
    hi = F.least(F.col(Q), lo + chunk_rows) - 1
    draws = chunks.select(*gb, N, salts.alias("_salts"), F.explode(F.sequence(lo, hi)).alias("_j"))
    parts = [] if (added or not hash_groups) else list(gb)
    draws = draws.select(*gb, "_j", (draw_hash([*parts, F.col("_j")], seed) % F.col(N)).alias("_rank"),
                         (F.col("_j") % F.col("_salts")).alias("_salt"))
    dealt = _maybe_broadcast(plan.select(*gb, F.sequence(F.lit(0).cast("bigint"), salts - 1).alias("_of")), 1 if added else n_groups)
    ranked = ranked.join(dealt, gb).withColumn("_salt", F.explode("_of")).drop("_of")
    # Spark takes the draws for as few as their chunks and would broadcast them: a merge keeps them off the driver.
    out = ranked.join(draws.hint("merge"), [*gb, "_rank", "_salt"]).drop("_rank", "_salt")
    out = out.drop("_j") if draw_id is None else out.withColumnRenamed("_j", draw_id)
    return _finish(out, added)
