"""SMOTE over-sampling with exact within-class k nearest neighbours.

Neighbours come from the metric index in ``operators.knn``.  Synthetic rows
reuse the draw primitive: draw ``j`` of class ``c`` picks a member by
``hash_rank``, one of its neighbours by ``md5(seed|c|j|nn)`` and a gap in [0, 1)
by ``md5(seed|c|j|gap)``; ``x + gap * (x_nn - x)``.

What no slider changes (keyed vectors, class sizes, ranks, neighbours) is kept in
:class:`PreparedSmote`, so a sweep over sliders computes it once.
"""

from __future__ import annotations

import threading
from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlab.functions.hashing import DEFAULT_SEED, u60, row_hash
from shiftlab.operators.knn import as_array, exact_knn
from shiftlab.operators.rebalance import IDENTITY_EPS, count_stats, random_undersample, up_target
from shiftlab.operators.sampling import Q, _maybe_broadcast, draw_with_replacement
from shiftlab.session import ensure_checkpoint_dir

ROW_KEY = "row_key"
TWO60 = float(1 << 60)


class PreparedSmote:
    """What SMOTE at any slider shares: keyed vectors, class sizes, neighbours (on first use)."""

    def __init__(self, df: DataFrame, features: str, label: str, key: Sequence[str], seed: int = DEFAULT_SEED, k_max: int = 5):
        self.features, self.label, self.seed = features, label, seed
        self.base = as_array(df, features).select(
            F.col(label), F.col(features), F.concat_ws("|", *[F.col(c).cast("string") for c in key]).alias(ROW_KEY))
        self.labelled = self.base.where(F.col(label).isNotNull())  # NULL is no class
        self.counts = self.labelled.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
        self.stats = count_stats(self.counts)
        self.k = max(min(k_max, self.stats.min - 1), 1)
        self._neighbours: DataFrame | None = None
        self._lock = threading.Lock()  # sweep steps may run side by side

    @property
    def neighbours(self) -> DataFrame:
        """The nearest rows of every row of the classes that some slider raises (all but the largest)."""
        with self._lock:
            if self._neighbours is None:
                ensure_checkpoint_dir(self.base.sparkSession)
                raised = self.counts.where(F.col("n") < self.stats.max).select(self.label)
                rows = self.labelled.join(_maybe_broadcast(raised, self.stats.groups), self.label, "left_semi")
                self._neighbours = exact_knn(rows, self.label, self.features, ROW_KEY, self.k, self.seed).checkpoint()
            return self._neighbours

    def at(self, slider: float) -> DataFrame:
        """The rows at ``slider``: label, features (array<double>), ``row_key``, ``synthetic``."""
        real = F.lit(False).alias("synthetic")
        if abs(slider) < IDENTITY_EPS:
            return self.base.select("*", real)
        if slider < 0:
            return random_undersample(self.base, self.label, slider, [ROW_KEY], self.seed).select("*", real)
        target = up_target(self.stats.min, self.stats.max, slider)
        need = self.counts.where(F.col("n") < target).select(self.label, (F.lit(target) - F.col("n")).alias(Q))
        if not need.limit(1).count():
            return self.labelled.select("*", real)
        if self.stats.min <= self.k:  # a row without a neighbour to go to
            return self._copies(slider)
        return self.labelled.select("*", real).unionByName(self._synthetic(need))

    def _copies(self, slider: float) -> DataFrame:
        """Random over-sampling where a class is too small for neighbours; copies get keys of their own."""
        target = up_target(self.stats.min, self.stats.max, slider)
        need = self.counts.where(F.col("n") < target).select(self.label, (F.lit(target) - F.col("n")).alias(Q))
        drawn = draw_with_replacement(self.labelled, need, [self.label], [ROW_KEY], self.seed, n_groups=self.stats.groups, draw_id="_j")
        copies = drawn.select(self.label, self.features, F.concat_ws("|", F.lit("copy"), F.col(self.label).cast("string"),
                                                                    F.col("_j").cast("string")).alias(ROW_KEY), F.lit(True).alias("synthetic"))
        return self.labelled.select("*", F.lit(False).alias("synthetic")).unionByName(copies)

    def _synthetic(self, need: DataFrame) -> DataFrame:
        label, features, seed = self.label, self.features, self.seed
        picks = draw_with_replacement(self.labelled, need, [label], [ROW_KEY], seed, n_groups=self.stats.groups, draw_id="_j")
        near = self.neighbours
        cls = F.col(label).cast("string")

        def drawn(what: str):
            return u60(row_hash([cls, F.col("_j"), F.lit(what)], seed))

        picks = picks.withColumn("nn", (drawn("nn") % F.lit(self.k)).cast("int")).withColumn(
            "gap", drawn("gap").cast("double") / F.lit(TWO60))
        to = near.select(F.col("qkey").alias(ROW_KEY), "nn", "nkey")
        ends = self.labelled.select(F.col(ROW_KEY).alias("nkey"), F.col(features).alias("_nv"))
        rows = picks.join(to, [ROW_KEY, "nn"]).join(ends, "nkey")
        new = F.zip_with(features, "_nv", lambda a, b: a + F.col("gap") * (b - a))
        return rows.select(F.col(label), new.alias(features),
                           F.concat_ws("|", F.lit("smote"), cls, F.col("_j").cast("string")).alias(ROW_KEY), F.lit(True).alias("synthetic"))


def smote(df: DataFrame, features: str, label: str, slider: float, key: Sequence[str],
          seed: int = DEFAULT_SEED, k_max: int = 5) -> DataFrame:
    """Classes below ``T = int(m + (M - m) s)`` get ``T - n_c`` synthetic
    rows; ``k = max(min(5, m - 1), 1)``.  Negative sliders undersample (R14).  If the
    smallest class has a single row, which has no neighbour, classes are raised by random
    copies instead (R15).

    Output: label, features (array<double>), ``row_key`` (original key joined by
    '|', or ``smote|class|j`` / ``copy|class|j``) and ``synthetic``.
    """
    return PreparedSmote(df, features, label, key, seed, k_max).at(slider)


def as_vectors(df: DataFrame, features: str) -> DataFrame:
    """SMOTE's output with ``features`` as an MLlib vector again."""
    return df.withColumn(features, array_to_vector(F.col(features)))
