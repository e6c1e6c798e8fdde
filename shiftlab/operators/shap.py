"""Mean |SHAP| feature importance of a random forest (P03), over all rows.

Path-dependent TreeSHAP (Lundberg, Erion & Lee 2018) written over leaves instead of
over recursion.  A leaf's path names features, each with the interval of values that
stay on the path and the share z of training weight that does.  Seen from the leaf, a
row is a pattern: which of the path's features it agrees with (o = 1) or not (o = 0).
Its Shapley values on that leaf depend on the pattern alone: feature j gets the leaf's
value times (o_j - z_j) times the sum, over subsets S of the other features, of
|S|! (m - |S| - 1)! / m! times the product of o in S and of z outside.

So a row needs the forest alone (a leaf table, bounded by trees x 2^depth) and its own
features: rows are dealt by their key and valued where they are, a block of rows at a
time.  A block meets the leaves one by one; a leaf's patterns are valued once a task, or
once a block where the leaf has more of them than a block has rows.  Neither the meetings
of rows and leaves nor their values are ever rows of a table, so what is shuffled is a row's
key and features, however many patterns occur.  Leaf values are class probabilities and
the forest output is their mean over trees, so per class the attributions of a row sum to
``f(x) - E[f]`` (tested).
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftlab.functions.hashing import DEFAULT_SEED
from shiftlab.operators import models as md
from shiftlab.operators.importance import forest
from shiftlab.session import ensure_checkpoint_dir, ship_package

#: Rows of a task; numbers (features x rows x classes) of a block of rows; numbers of the pattern tables that a task keeps.
TASK_ROWS, BLOCK, TABLES = 10_000, 1_000_000, 4_000_000


@dataclass
class Forest:
    """``leaves``: (tree, leaf, value per class, path); ``expected``: the forest's mean output per class."""

    leaves: list[tuple]
    expected: np.ndarray
    trees: int


def read_forest(model, spark: SparkSession) -> Forest:
    """Leaf paths of a fitted ``RandomForestClassificationModel``, from its saved node table (the model's size)."""
    path = ensure_checkpoint_dir(spark).rstrip("/") + f"/shap-model-{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    rows = (spark.read.parquet(path + "/data")
            .select("treeID", "nodeData.id", "nodeData.impurityStats", "nodeData.leftChild",
                    "nodeData.rightChild", "nodeData.split.featureIndex",
                    "nodeData.split.leftCategoriesOrThreshold", "nodeData.split.numCategories").collect())
    trees: dict[int, dict] = {}
    for r in rows:
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    leaves, expected = [], None
    for tree, nodes in sorted(trees.items()):
        cover = {i: float(sum(r["impurityStats"])) for i, r in nodes.items()}
        todo = [(0, {})]  # node and its path: feature -> (lo, hi, categories or None, z)
        while todo:
            i, held = todo.pop()
            r = nodes[i]
            if r["leftChild"] < 0:
                share = np.array(r["impurityStats"], float) / max(cover[i], 1e-300)
                steps = [(f, lo, hi, cats, z, 1 << b) for b, (f, (lo, hi, cats, z)) in enumerate(held.items())]
                leaves.append((tree, i, share.tolist(), steps))
                part = share * cover[i] / cover[0]
                expected = part if expected is None else expected + part
                continue
            f, split = r["featureIndex"], r["leftCategoriesOrThreshold"]
            lo, hi, cats, z = held.get(f, (-math.inf, math.inf, None, 1.0))
            n = r["numCategories"]
            if n is not None and n > 0:
                own = set(range(n)) if cats is None else set(cats)
                sides = [(lo, hi, sorted(map(float, own & set(split))), z), (lo, hi, sorted(map(float, own - set(split))), z)]
            else:
                sides = [(lo, min(hi, split[0]), cats, z), (max(lo, split[0]), hi, cats, z)]
            for child, side in zip((r["leftChild"], r["rightChild"]), sides, strict=True):
                todo.append((child, held | {f: (*side[:3], side[3] * cover[child] / cover[i])}))
    return Forest(leaves, expected / len(trees), len(trees))


def pattern_values(z: np.ndarray, o: np.ndarray) -> np.ndarray:
    """Per (feature of a path, pattern), (o - z) times its weight over the subsets of the other features; ``o`` is by feature, then pattern."""
    m = len(z)
    out = np.zeros(o.shape)
    weight = [math.factorial(s) * math.factorial(m - s - 1) / math.factorial(m) for s in range(m)]
    for j in range(m):
        # by[s]: the sum over subsets of size s of the others, grown one feature at a time
        by = np.zeros(o.shape)
        by[0] = 1.0
        for k in range(m):
            if k != j:
                by[1:] = by[1:] * z[k] + by[:-1] * o[k]
                by[0] *= z[k]
        out[j] = (o[j] - z[j]) * (weight @ by)
    return out


def _of_patterns(path: list[tuple], patterns: np.ndarray) -> np.ndarray:
    bits = np.array([[step[5]] for step in path])
    return pattern_values(np.array([step[4] for step in path]), (patterns & bits != 0).astype(float))


def _by_feature(x: pa.ListArray, used: Sequence[int]) -> np.ndarray:
    """The used features of rows, by feature, then row; one that a row lacks is NaN, which agrees with no interval."""
    size = pc.fill_null(pc.list_value_length(x), 0).to_numpy()
    row = np.repeat(np.arange(len(x)), size)
    at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    out = np.full((len(x), max(used[-1] + 1, size.max(initial=0))), math.nan)
    out[row, at] = x.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(out[:, used].T)


def _block_values(x: np.ndarray, found: Forest, place: dict[int, int], tables: dict[int, np.ndarray]) -> np.ndarray:
    """[feature, row, class]: the Shapley values of a block of rows; ``x`` is by feature (at its ``place``), then row."""
    out = np.zeros((*x.shape, len(found.expected)))
    for at, (_, _, own, path) in enumerate(found.leaves):
        if not path:
            continue
        pattern = np.zeros(x.shape[1], np.int64)
        for f, lo, hi, cats, _, bit in path:
            v = x[place[f]]
            pattern |= np.where((v > lo) & (v <= hi) if cats is None else np.isin(v, cats), bit, 0)
        if 1 << len(path) <= x.shape[1] or at in tables:
            values = tables[at] if at in tables else _of_patterns(path, np.arange(1 << len(path)))
            if at not in tables and sum(t.size for t in tables.values()) + values.size <= TABLES:
                tables[at] = values
        else:
            kinds, pattern = np.unique(pattern, return_inverse=True)
            values = _of_patterns(path, kinds)
        for step, value in zip(path, values, strict=True):
            out[place[step[0]]] += np.multiply.outer(value[pattern], own)
    return out / found.trees


def row_values(rows: DataFrame, found: Forest, x: str = "x", row: str = "row", n: int | None = None) -> DataFrame:
    """(row, feature, phi): every row's Shapley values, an array with a value per class; features on no path are left out.

    ``x`` is an array column; ``row`` identifies rows (values of rows that share one are added up); ``n`` is the number of rows, if known.
    """
    spark = rows.sparkSession
    ship_package(spark)
    n = rows.count() if n is None else n
    used = sorted({step[0] for leaf in found.leaves for step in leaf[3]})
    place = {f: i for i, f in enumerate(used)}
    rows = rows.select(F.col(row).alias("row"), F.col(x).alias("x"))
    rows = rows.repartition(max(spark.sparkContext.defaultParallelism, n // TASK_ROWS + 1), "row")
    first = F.row_number().over(Window.partitionBy("row").orderBy("row")) == 1  # rows that share a key follow each other
    schema = T.StructType([rows.schema["row"], T.StructField("feature", T.IntegerType()), T.StructField("phi", T.ArrayType(T.DoubleType()))])
    classes = len(found.expected)
    size = max(1, BLOCK // max(1, len(used) * classes))
    held = spark.sparkContext.broadcast(found)

    def records(keys: pa.Array, phi: np.ndarray) -> pa.RecordBatch:
        count = phi.shape[1]
        ends = pa.array(np.arange(0, phi.size + 1, classes, dtype=np.int32))
        return pa.RecordBatch.from_arrays([
            keys.take(pa.array(np.tile(np.arange(count), len(used)))), pa.array(np.repeat(np.array(used, np.int32), count)),
            pa.ListArray.from_arrays(ends, pa.array(phi.ravel()))], names=["row", "feature", "phi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        key, open_ = None, None  # the last key and the sums of its rows so far: the next block may go on with it
        for batch in batches:
            for block in (batch.slice(i, size) for i in range(0, batch.num_rows, size)):
                keys, starts = block.column(0), np.flatnonzero(block.column(2).to_numpy(zero_copy_only=False))
                phi = _block_values(_by_feature(block.column(1), used), held.value, place, tables)
                if open_ is not None:
                    keys, starts, phi = pa.concat_arrays([key, keys]), np.append(0, starts + 1), np.concatenate([open_, phi], 1)
                phi, keys = np.add.reduceat(phi, starts, 1), keys.take(pa.array(starts))
                key, open_ = keys[-1:], phi[:, -1:].copy()
                if len(keys) > 1:
                    yield records(keys[:-1], phi[:, :-1])
        if open_ is not None:
            yield records(key, open_)

    if not used:
        return spark.createDataFrame([], schema)
    return rows.withColumn("first", first).mapInArrow(run, schema)


def shap_importance(df: DataFrame, label: str, features: str, names: Sequence[str], key: Sequence[str],
                    trees: int = 100, depth: int = 10, seed: int = DEFAULT_SEED) -> DataFrame:
    """Fit the forest on all rows, return mean |SHAP| per feature over all rows and classes.

    Rows are told apart by their ``key``."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    indexer, classes = md.label_indexer(df, label)
    found = read_forest(forest(features, md.LABEL_IDX, trees, depth, seed).fit(indexer.transform(df)), spark)
    rows = df.select(F.struct(*key).alias("row"), vector_to_array(features).alias("x"))
    n = rows.count()
    size = F.aggregate("phi", F.lit(0.0), lambda a, v: a + F.abs(v)) / F.lit(float(len(classes)))
    sums = row_values(rows, found, n=n).groupBy("feature").agg(F.sum(size).alias("s"))
    all_features = spark.createDataFrame([(i, str(f)) for i, f in enumerate(names)], "feature int, name string")
    out = all_features.join(F.broadcast(sums), "feature", "left")
    return out.select(F.col("name").alias("feature"), (F.coalesce("s", F.lit(0.0)) / F.lit(float(max(n, 1)))).alias("importance")).orderBy(
        F.col("importance").desc(), "feature")
