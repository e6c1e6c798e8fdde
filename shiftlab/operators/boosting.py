"""Multi-class gradient-boosted trees with a softmax loss.

A round grows one regression tree per class on the gradients and Hessians of the
softmax loss, all of them from the class probabilities before the round.  Features
are cut once into at most ``max_bins`` quantile bins that every tree shares.

Training rows are packed into blocks (a byte per feature, a float per class for
the margins) and cached.  A level of all trees of a round is one job: each task
adds up gradient and Hessian histograms of its blocks, the histograms of a (class,
node) meet by a shuffle and are added as they stream in, and the best split of the
node leaves the task with the sums left of it, so that the deepest leaves need no
job.  The driver only sees splits, at most classes x nodes rows a level.  Where tasks
have several blocks, a round's trees are added to the margins once, in a new set of
blocks that the first job of the next round fills; with one block a task the margins of
the last few rounds are recomputed, which is cheaper than another cached table.  Every
``REFRESH`` rounds a checkpoint cuts the blocks from their lineage.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftlab.session import ensure_checkpoint_dir, ship_package

#: Rows of a block, rounds between two checkpoints of the blocks, rows that the bins are cut from.
BLOCK_ROWS, REFRESH, BIN_SAMPLE = 8192, 10, 50_000


@dataclass
class Tree:
    """A binary tree in heap order: children of node i are 2 i + 1 and 2 i + 2; feature -1 is a leaf."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        """The leaf (so far) that each row of binned features ends in."""
        at = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        while True:
            inner = self.feature[at] >= 0
            if not inner.any():
                return at
            right = bins[rows, np.maximum(self.feature[at], 0)] > self.bin[at]
            at = np.where(inner, 2 * at + 1 + right, at)

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.leaf_of(bins)]


def empty_tree(depth: int) -> Tree:
    n = 2 ** (depth + 1) - 1
    return Tree(np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n))


def quantile_edges(sample: np.ndarray, max_bins: int) -> list[np.ndarray]:
    """Per feature, the upper edges of all bins but the last; a bin holds values up to its edge."""
    edges = []
    for x in sample.T:
        values = np.unique(x[np.isfinite(x)])
        if len(values) > max_bins:
            values = np.unique(np.quantile(x[np.isfinite(x)], np.linspace(0, 1, max_bins + 1)[1:-1], method="lower"))
        elif len(values):
            values = values[:-1]
        edges.append(values)
    return edges


def to_bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin numbers; NaN goes with the largest values."""
    return np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1).astype(np.uint8)


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def best_split(g: np.ndarray, h: np.ndarray, reg: float, min_child: float) -> tuple[float, int, int, float, float]:
    """(gain, feature, bin, g and h left of it) of the best split of a node's (feature, bin) histograms; ties: first feature, first bin."""
    gl, hl = np.cumsum(g, 1)[:, :-1], np.cumsum(h, 1)[:, :-1]
    gt, ht = g[0].sum(), h[0].sum()
    gr, hr = gt - gl, ht - hl
    gain = gl * gl / (hl + reg) + gr * gr / (hr + reg) - gt * gt / (ht + reg)
    gain[(hl < min_child) | (hr < min_child)] = -np.inf
    if gain.size == 0:
        return -np.inf, 0, 0, 0.0, 0.0
    # Gains that differ by rounding only (sums in another order) count as equal.
    top = gain.max()
    at = int(np.flatnonzero(gain.ravel() >= top - 1e-10 * max(1.0, abs(top)))[0]) if np.isfinite(top) else 0
    return float(gain.ravel()[at]), *divmod(at, gain.shape[1]), float(gl.ravel()[at]), float(hl.ravel()[at])


def add_histograms(sums: np.ndarray, node: np.ndarray, bins: np.ndarray, g: np.ndarray, h: np.ndarray, width: int) -> None:
    """Add rows to (node, feature x bin, g and h) histograms; ``bins`` is by feature, then row, ``node`` -1 a row of no node.

    A feature at a time, so that keys and sums of a block stay in the processor's cache.
    """
    keep = node >= 0
    if not keep.all():
        node, bins, g, h = node[keep], bins[:, keep], g[keep], h[keep]
    first = node * width
    size = len(sums) * width
    for f, b in enumerate(bins):
        key = first + b
        at = slice(f * width, (f + 1) * width)
        sums[:, at, 0] += np.bincount(key, g, size).reshape(-1, width)
        sums[:, at, 1] += np.bincount(key, h, size).reshape(-1, width)


def _unpack(batch: pa.RecordBatch, d: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for bins, y, margins in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
        yield (np.frombuffer(bins, np.uint8).reshape(-1, d), np.frombuffer(y, np.int32),
               np.frombuffer(margins, np.float64).reshape(-1, k))


def _with_rounds(bins: np.ndarray, margins: np.ndarray, rounds: list[list[Tree]], rate: float) -> np.ndarray:
    for trees in rounds:
        margins = margins + rate * np.stack([t.predict(bins) for t in trees], 1)
    return margins


def _pack(train: DataFrame, features: str, label: str, edges: list[np.ndarray], k: int) -> DataFrame:
    """Blocks (bins, y, margins) of binned rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(x: list[np.ndarray], y: list[np.ndarray]) -> pa.RecordBatch:
            bins, ys = to_bins(np.concatenate(x), edges), np.concatenate(y).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (bins, ys, np.zeros((len(ys), k)))],
                                              names=["bins", "y", "margins"])

        xs, ys = [], []
        for batch in batches:
            xs.append(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
            ys.append(batch.column(1).to_numpy(zero_copy_only=False))
            if sum(map(len, ys)) >= BLOCK_ROWS:
                yield block(xs, ys)
                xs, ys = [], []
        if ys:
            yield block(xs, ys)

    x = train.select(vector_to_array(features).alias("x"), F.col(label).cast("int").alias("y"))
    return x.mapInArrow(run, "bins binary, y binary, margins binary")


@dataclass
class SoftmaxBoostModel:
    edges: list[np.ndarray]
    classes: int
    rate: float
    rounds: list[list[Tree]] = field(default_factory=list)

    def margins(self, x: np.ndarray) -> np.ndarray:
        if len(x) == 0:
            return np.zeros((0, self.classes))
        return _with_rounds(to_bins(x, self.edges), np.zeros((len(x), self.classes)), self.rounds, self.rate)

    def transform(self, df: DataFrame, features: str) -> DataFrame:
        """Add ``rawPrediction``, ``probability`` (vectors) and ``prediction``."""
        held = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def score(col: pd.Series) -> pd.Series:
            model = held.value
            return pd.Series(list(model.margins(np.stack(col.to_numpy()) if len(col) else np.zeros((0, len(model.edges))))))

        raw = df.withColumn("_raw", score(vector_to_array(features)))
        top = F.array_max("_raw")
        e = F.transform("_raw", lambda v: F.exp(v - top))
        total = F.aggregate("_e", F.lit(0.0), lambda a, b: a + b)
        out = raw.withColumn("_e", e).withColumn("probability", array_to_vector(F.transform("_e", lambda v: v / total)))
        return (out.withColumn("rawPrediction", array_to_vector("_raw"))
                .withColumn("prediction", (F.array_position("_raw", F.array_max("_raw")) - 1).cast("double")).drop("_raw", "_e"))


class SoftmaxBoost:
    """``rounds`` x classes trees; ``reg`` is added to Hessian sums, a child needs ``min_child`` of them."""

    def __init__(self, rounds: int = 100, depth: int = 6, rate: float = 0.1, reg: float = 1.0, min_child: float = 1.0, max_bins: int = 32):
        self.rounds, self.depth, self.rate, self.reg, self.min_child, self.max_bins = rounds, depth, rate, reg, min_child, max_bins

    def fit(self, train: DataFrame, features: str, label: str, classes: int) -> SoftmaxBoostModel:
        """``label`` holds class numbers 0 .. classes - 1."""
        spark = train.sparkSession
        ensure_checkpoint_dir(spark)
        ship_package(spark)
        train = train.where(F.col(label).isNotNull())
        n = train.count()
        if n == 0:
            raise ValueError("no training rows")
        part = F.shiftrightunsigned(F.xxhash64(vector_to_array(features)), 1).cast("double")
        sample = train.where(part <= min(1.0, BIN_SAMPLE / n) * 2.0**63) if n > BIN_SAMPLE else train
        rows = sample.select(vector_to_array(features).alias("x")).toArrow()["x"].combine_chunks()
        edges = quantile_edges(rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1), self.max_bins)
        model = SoftmaxBoostModel(edges, classes, self.rate)
        parts = max(1, min(train.rdd.getNumPartitions(), -(-n // BLOCK_ROWS)))
        blocks = _pack(train.coalesce(parts), features, label, edges, classes).persist()
        every = 1 if n > parts * BLOCK_ROWS else REFRESH
        older, since = None, []
        for done in range(1, self.rounds + 1):
            trees = self._round(blocks, since, len(edges), classes, parts)
            model.rounds.append(trees)
            since.append(trees)
            if older is not None:  # the round's jobs have filled ``blocks`` from it
                older.unpersist()
                older = None
            if done < self.rounds and (len(since) >= every or done % REFRESH == 0):
                older, blocks = blocks, self._refreshed(blocks, since, len(edges), classes).persist()
                since = []
                if done % REFRESH == 0:
                    filled, blocks = blocks, blocks.checkpoint().persist()
                    older.unpersist()
                    older = filled
        for x in (older, blocks):
            if x is not None:
                x.unpersist()
        return model

    def _refreshed(self, blocks: DataFrame, since: list[list[Tree]], d: int, k: int) -> DataFrame:
        """The blocks with the trees of rounds in their margins."""
        rate = self.rate

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                margins = [_with_rounds(b, m, since, rate).tobytes() for b, _, m in _unpack(batch, d, k)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(margins, pa.binary())],
                                                 names=["bins", "y", "margins"])

        return blocks.mapInArrow(run, "bins binary, y binary, margins binary")

    def _round(self, blocks: DataFrame, since: list[list[Tree]], d: int, k: int, parts: int) -> list[Tree]:
        """One tree per class, level by level."""
        trees = [empty_tree(self.depth) for _ in range(k)]
        open_ = {(c, 0) for c in range(k)}
        for _ in range(max(1, self.depth)):
            found = self._splits(blocks, since, trees, open_, d, k, parts)
            nodes, open_ = open_, set()
            for c, node in nodes:
                g, h, gain, feature, at, gl, hl = found.get((c, node), (0.0, 0.0, -np.inf, 0, 0, 0.0, 0.0))
                trees[c].value[node] = -g / (h + self.reg)
                if self.depth and gain > 1e-12:
                    left, right = 2 * node + 1, 2 * node + 2
                    trees[c].feature[node], trees[c].bin[node] = feature, at
                    trees[c].value[left], trees[c].value[right] = -gl / (hl + self.reg), -(g - gl) / (h - hl + self.reg)
                    open_ |= {(c, left), (c, right)}
            if not open_:
                break
        return trees

    def _splits(self, blocks, since, trees, open_, d, k, parts) -> dict[tuple[int, int], tuple]:
        """{(class, node): (g, h, gain, feature, bin, g and h left of it)} of the open nodes."""
        rate, reg, min_child, width = self.rate, self.reg, self.min_child, self.max_bins
        wanted = [sorted(n for c, n in open_ if c == i) for i in range(k)]

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = [np.zeros((len(w), d * width, 2)) for w in wanted]
            for batch in batches:
                for bins, y, margins in _unpack(batch, d, k):
                    p = softmax(_with_rounds(bins, margins, since, rate))
                    columns = bins.T.astype(np.int64, order="C")
                    for c in range(k):
                        if not wanted[c]:
                            continue
                        slot = np.full(len(trees[c].feature), -1, np.int64)
                        slot[wanted[c]] = np.arange(len(wanted[c]))
                        add_histograms(sums[c], slot[trees[c].leaf_of(bins)], columns, p[:, c] - (y == c), p[:, c] * (1 - p[:, c]), width)
            rows = [(c, n, sums[c][i].tobytes()) for c in range(k) for i, n in enumerate(wanted[c])]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(
                zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["c", "node", "sums"])

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for c, n, sums in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    new = np.frombuffer(sums, np.float64)
                    total[c, n] = total[c, n] + new if (c, n) in total else new
            out = []
            for (c, n), sums in total.items():
                g, h = np.moveaxis(sums.reshape(d, width, 2), 2, 0)
                out.append((c, n, float(g[0].sum()), float(h[0].sum()), *best_split(g, h, reg, min_child)))
            kinds = (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [()] * len(kinds), kinds, strict=True)],
                names=["c", "node", "g", "h", "gain", "feature", "bin", "gl", "hl"])

        sums = blocks.mapInArrow(gather, "c int, node int, sums binary")
        if parts > 1:
            sums = sums.repartition(max(1, min(parts, len(open_))), "c", "node")
        rows = sums.mapInArrow(
            choose, "c int, node int, g double, h double, gain double, feature int, bin int, gl double, hl double").collect()
        return {(r["c"], r["node"]): tuple(r)[2:] for r in rows}

    def fit_predict(self, train: DataFrame, others: list[DataFrame], features: str, label: str, classes: int) -> list[DataFrame]:
        model = self.fit(train, features, label, classes)
        return [model.transform(o, features) for o in others]
