"""Exact k nearest neighbours within classes, by a metric index with several pivots.

Rows of one class and one vector are one point with its smallest keys, so copies
are searched once.  A class of at most ``BLOCK_ROWS`` points is compared whole, in
one group.  Larger classes are indexed:

1. ``PIVOTS`` points of a class, chosen far apart in a bounded sample, are its
   pivots.  Each point stores its distances to all of them and belongs to the
   nearest one; points are range-partitioned by (class, pivot, distance) into
   blocks, so a block is a piece of a ring around a pivot.
2. The points of a block among each other give every point a radius that holds
   enough neighbours.
3. By the triangle inequality a block can only hold something nearer if, for
   every pivot, its ring meets the query's ring: the nearest pivot's ring by an
   equi-join on a grid of cells, the others by a filter on the block's bounds.
   Each (query, block) pair that is left is dealt by block; a task holds one
   block while its queries stream by.

So the neighbours are exact whatever the pivots are; only the work depends on
them.  In many dimensions without clusters distances are nearly equal, no bound
of this kind excludes much, and most blocks are searched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftlab.functions.hashing import DEFAULT_SEED
from shiftlab.operators.sampling import _maybe_broadcast
from shiftlab.session import ensure_checkpoint_dir, ship_package

#: Points of a block, and of a class that is compared whole.
BLOCK_ROWS = 2048
#: Pivots of a class, sampled points that they are chosen from, bytes of all pivots held in a task.
PIVOTS, PIVOT_SAMPLE, PIVOT_BYTES = 16, 256, 16 << 20
#: Cells of the grid over a ring, for each of its blocks.
CELLS_PER_BLOCK = 4
#: Queries that are compared with a block at a time.
QUERY_ROWS = 512
#: Rounding of a bound, relative to the distances in it.
SLACK = 1e-9

KNN_SCHEMA = "cls string, qkey string, nkey string, dist double, nn int"
_POINT = "cls string, h1 bigint, h2 bigint"
_FOUND = f"{_POINT}, dist double, keys array<string>"


def as_array(df: DataFrame, features: str) -> DataFrame:
    """``features`` as array<double>, from an MLlib vector or an array of numbers."""
    if isinstance(df.schema[features].dataType, VectorUDT):
        return df.withColumn(features, vector_to_array(features))
    return df.withColumn(features, F.col(features).cast("array<double>"))


class Block:
    """Points of one block, in the order of their first keys."""

    def __init__(self, v: np.ndarray, keys: Sequence[Sequence[str]]):
        order = np.argsort(np.array([k[0] for k in keys], dtype=object), kind="stable")
        self.v, self.keys = v[order], [keys[i] for i in order]
        self.norm = (self.v * self.v).sum(1)
        self.weight = np.array([len(k) for k in self.keys], np.int64)

    def _squares(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances by one product, and how far off they can be."""
        norm = (q * q).sum(1)
        return norm[:, None] + self.norm - 2 * (q @ self.v.T), 1e-11 * (norm + self.norm.max())

    def nearest(self, q: np.ndarray, most: int, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, point, distance) of each query's ``most`` nearest points within its radius, ties by key."""
        square, slack = self._squares(q)
        limit = np.minimum(radius * (1 + SLACK), np.finfo(float).max ** 0.5 / 4) ** 2
        if len(self.v) > most:
            limit = np.minimum(limit, np.partition(square, most - 1, axis=1)[:, most - 1])
        i, j = np.nonzero(square <= (limit + slack)[:, None])
        diff = q[i] - self.v[j]
        d = np.sqrt((diff * diff).sum(1))
        inside = d <= radius[i] * (1 + SLACK)
        i, j, d = i[inside], j[inside], d[inside]
        order = np.lexsort((j, d, i))
        i, j, d = i[order], j[order], d[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        return i[place < most], j[place < most], d[place < most]

    def radii(self, most: int) -> np.ndarray:
        """For each point of the block, a distance within which the block has ``most`` keys; infinity without so many."""
        out = np.full(len(self.v), np.inf)
        if self.weight.sum() < most:
            return out
        for at in range(0, len(self.v), QUERY_ROWS):
            q = self.v[at:at + QUERY_ROWS]
            i, j, d = self.nearest(q, min(most, len(self.v)), np.full(len(q), np.inf))
            held = np.cumsum(self.weight[j])
            before = np.concatenate([[0], held])[np.searchsorted(i, i)]
            enough = np.flatnonzero(held - before >= most)
            first, where = np.unique(i[enough], return_index=True)
            out[at + first] = d[enough[where]]
        return out


def far_apart(v: np.ndarray, n: int) -> np.ndarray:
    """``n`` points, each the farthest from those before; repeated if there are fewer distinct ones."""
    at = [int(((v - v.mean(0)) ** 2).sum(1).argmax())]
    least = ((v - v[at[0]]) ** 2).sum(1)
    while len(at) < n:
        at.append(int(least.argmax()))
        least = np.minimum(least, ((v - v[at[-1]]) ** 2).sum(1))
    return v[at]


def _points(x: DataFrame, most: int) -> DataFrame:
    """(cls, h1, h2, keys, v): distinct vectors of a class, each with its ``most`` smallest keys."""
    first = Window.partitionBy("cls", "h1", "h2").orderBy("qkey")
    few = x.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most)
    return few.groupBy("cls", "h1", "h2").agg(F.sort_array(F.collect_list("qkey")).alias("keys"), F.first("v").alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _pivots(points: DataFrame, d: int) -> dict[str | None, np.ndarray]:
    """Pivots of the largest classes, and shared ones (under None) for all others; ``PIVOT_BYTES`` in all."""
    spark = points.sparkSession
    own = max(1, PIVOT_BYTES // (8 * PIVOTS * d))
    order = Window.partitionBy("cls").orderBy("h1", "h2")
    large = points.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cls").limit(own).select("cls")
    some = points.join(F.broadcast(large), "cls").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= PIVOT_SAMPLE)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        chosen = far_apart(np.stack(pdf["v"].to_numpy()), PIVOTS)
        return pd.DataFrame({"cls": [pdf["cls"].iloc[0]] * PIVOTS, "v": list(chosen)})

    rows = some.select("cls", "v").groupBy("cls").applyInPandas(choose, "cls string, v array<double>").collect()
    out: dict[str | None, list] = {}
    for r in rows:
        out.setdefault(r["cls"], []).append(r["v"])
    shared = points.select("h1", "v").orderBy("h1").limit(PIVOT_SAMPLE).collect()
    return {c: np.array(v) for c, v in out.items()} | {None: far_apart(np.array([r["v"] for r in shared]), PIVOTS)}


def _candidates(q: DataFrame, bounds: DataFrame, parts: int, payload: list[str]) -> DataFrame:
    """(query, block) pairs whose rings meet: ``[p - r, p + r]`` of the query and ``[lo, hi]`` of the block.

    ``ring`` names a class and pivot.  The blocks of a ring are sorted ranges of the
    distance.  A grid of equal cells per ring records which block ordinals touch
    each cell (filled forward and backward over empty cells), so an interval maps to
    a contiguous range of ordinals by two equi-joins instead of a comparison with
    every block.
    """
    b = bounds.withColumn("o", F.row_number().over(Window.partitionBy("ring").orderBy("lo", "hi", "blk")) - 1)
    rings = b.groupBy("ring").agg(F.min("lo").alias("pmin"), F.max("hi").alias("pmax"), F.count(F.lit(1)).alias("nb"))
    rings = rings.withColumn("g", F.col("nb") * CELLS_PER_BLOCK).withColumn(
        "w", F.when(F.col("pmax") > F.col("pmin"), (F.col("pmax") - F.col("pmin")) / F.col("g")).otherwise(1.0))

    def cell(v):
        v = F.least(F.greatest(v, F.col("pmin")), F.col("pmax"))
        return F.least(F.floor((v - F.col("pmin")) / F.col("w")), F.col("g") - 1).cast("long")

    held = _maybe_broadcast(rings, parts)
    span = b.join(held, "ring").select("ring", "o", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("cell"))
    touched = span.groupBy("ring", "cell").agg(F.min("o").alias("omin"), F.max("o").alias("omax"))
    grid = rings.select("ring", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)).alias("cell"))
    by = Window.partitionBy("ring").orderBy("cell")
    grid = (grid.join(touched, ["ring", "cell"], "left")
            .withColumn("o_from", F.first("omin", ignorenulls=True).over(by.rowsBetween(0, Window.unboundedFollowing)))
            .withColumn("o_to", F.last("omax", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))))
    bound = parts * (CELLS_PER_BLOCK + 1)
    low = _maybe_broadcast(grid.select("ring", F.col("cell").alias("c1"), "o_from"), bound)
    high = _maybe_broadcast(grid.select("ring", F.col("cell").alias("c2"), "o_to"), bound)
    asked = q.join(held, "ring").where((F.col("p") + F.col("r") >= F.col("pmin")) & (F.col("p") - F.col("r") <= F.col("pmax")))
    asked = asked.select("ring", "p", "r", *payload, cell(F.col("p") - F.col("r")).alias("c1"), cell(F.col("p") + F.col("r")).alias("c2"))
    asked = asked.join(low, ["ring", "c1"]).join(high, ["ring", "c2"])
    some = F.when(F.col("o_from") <= F.col("o_to"), F.sequence("o_from", "o_to")).otherwise(F.array().cast("array<int>"))
    asked = asked.select("ring", "p", "r", *payload, F.explode(some).alias("o"))
    return asked.join(_maybe_broadcast(b, parts), ["ring", "o"]).where(
        (F.col("hi") >= F.col("p") - F.col("r")) & (F.col("lo") <= F.col("p") + F.col("r")))


def _scan(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Hold a block's points while its queries, which sort behind them, pass by."""
    now, parts, block = None, [], None
    for batch in batches:
        names = [batch.column(i).to_pylist() for i in range(3)]
        kind = batch.column(3).to_pylist()
        tags = list(zip(*names, kind, strict=True))
        cuts = [0, *(i for i in range(1, len(tags)) if tags[i] != tags[i - 1]), len(tags)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            if tags[a][:3] != now:
                now, parts, block = tags[a][:3], [], None
            v = _matrix(part.column(7))
            if tags[a][3] == 0:
                parts.append((v, part.column(6).to_pylist()))
                continue
            if block is None:
                if not parts:
                    continue
                block, parts = Block(np.concatenate([x for x, _ in parts]), [k for _, ks in parts for k in ks]), []
            radius = part.column(8).to_numpy()
            for at in range(0, b - a, QUERY_ROWS):
                i, j, d = block.nearest(v[at:at + QUERY_ROWS], most, radius[at:at + QUERY_ROWS])
                asked = part.take(pa.array(at + i))
                yield pa.RecordBatch.from_arrays(
                    [asked.column(0), asked.column(4), asked.column(5), pa.array(d, pa.float64()),
                     pa.array([block.keys[x] for x in j.tolist()], pa.list_(pa.string()))], names=["cls", "h1", "h2", "dist", "keys"])


def dealt(points: DataFrame, n: int, d: int, most: int) -> DataFrame:
    """The blocks' points (kind 0) and, for each block, the queries that must search it (kind 1)."""
    held = points.sparkSession.sparkContext.broadcast(_pivots(points, d))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, cls = _matrix(batch.column(4)), np.array(batch.column(0).to_pylist(), dtype=object)
            far = np.zeros((len(v), PIVOTS))
            for c in set(cls.tolist()):
                of = np.flatnonzero(cls == c)
                pivots = held.value.get(c, held.value[None])
                for j in range(PIVOTS):
                    diff = v[of] - pivots[j]
                    far[of, j] = np.sqrt((diff * diff).sum(1))
            near = far.argmin(1)
            ends = pa.array(np.arange(0, PIVOTS * len(v) + 1, PIVOTS), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(near, pa.int32()), pa.array(far[np.arange(len(v)), near]),
                 pa.ListArray.from_arrays(ends, pa.array(far.ravel()))], names=["cls", "h1", "h2", "keys", "v", "piv", "p", "far"])

    placed = points.select("cls", "h1", "h2", "keys", "v").mapInArrow(
        place, f"{_POINT}, keys array<string>, v array<double>, piv int, p double, far array<double>")
    parts = max(1, math.ceil(n / BLOCK_ROWS))
    blocks = placed.repartitionByRange(parts, "cls", "piv", "p", "h1").withColumn("blk", F.spark_partition_id()).checkpoint()

    def radii(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first", kind="stable").reset_index(drop=True)
        block = Block(np.stack(pdf["v"].to_numpy()), [list(k) for k in pdf["keys"]])
        return pd.DataFrame({"cls": pdf["cls"], "h1": pdf["h1"], "h2": pdf["h2"], "r": block.radii(most), "v": pdf["v"], "far": pdf["far"]})

    asked = (blocks.withColumn("first", F.col("keys")[0]).groupBy("cls", "piv", "blk")
             .applyInPandas(radii, f"{_POINT}, r double, v array<double>, far array<double>"))

    def ring(piv):
        return F.concat_ws("\x1f", F.col("cls"), piv.cast("string"))

    far = [F.col("far")[j] for j in range(PIVOTS)]
    bounds = blocks.groupBy("cls", "piv", "blk").agg(
        F.min("p").alias("lo"), F.max("p").alias("hi"),
        F.array(*map(F.min, far)).alias("least"), F.array(*map(F.max, far)).alias("most"))
    bounds = bounds.select(ring(F.col("piv")).alias("ring"), "piv", "blk", "lo", "hi", "least", "most")
    # The radius, wider by what the sums of distances can be off.
    wide = asked.withColumn("exact_r", F.col("r")).withColumn("r", F.col("r") + (F.col("r") + F.array_max("far")) * SLACK)
    each = wide.select("cls", "h1", "h2", "v", "far", "r", "exact_r", F.posexplode("far").alias("j", "p")).withColumn("ring", ring(F.col("j")))
    met = _candidates(each, bounds, parts, ["cls", "h1", "h2", "v", "far", "exact_r"])
    outside = F.greatest(F.array_max(F.zip_with("far", "most", lambda a, b: a - b)),
                         F.array_max(F.zip_with("far", "least", lambda a, b: b - a)))
    none = F.array().cast("array<string>")
    queries = met.where(outside <= F.col("r")).select(
        "cls", "piv", "blk", F.lit(1).alias("kind"), "h1", "h2", none.alias("keys"), "v", F.col("exact_r").alias("r"))
    rows = blocks.select("cls", "piv", "blk", F.lit(0).alias("kind"), "h1", "h2", "keys", "v", F.lit(0.0).alias("r"))
    return rows.unionByName(queries)


def _indexed(points: DataFrame, n: int, d: int, most: int) -> DataFrame:
    """``_FOUND`` for points of classes that do not fit in one block."""
    met = dealt(points, n, d, most).repartition(max(1, math.ceil(n / BLOCK_ROWS)), "cls", "piv", "blk")
    return met.sortWithinPartitions("cls", "piv", "blk", "kind").mapInArrow(lambda x: _scan(x, most), _FOUND)


def exact_knn(df: DataFrame, label: str, features: str, key: str, k: int,
              seed: int = DEFAULT_SEED) -> DataFrame:
    """``(cls, qkey, nkey, dist, nn)``: the ``k`` nearest other rows of the same class for every
    row, ``nn`` = 0-based rank by (dist, key).  Rows without class, key or vector take no part.

    ``seed`` has no influence on the (exact) result; it stays for callers that pass one.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    x = as_array(df, features).select(F.col(label).cast("string").alias("cls"), F.col(key).cast("string").alias("qkey"),
                                      F.col(features).alias("v"))
    x = x.where(F.col("cls").isNotNull() & F.col("qkey").isNotNull() & F.col("v").isNotNull())
    x = x.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    most = k + 1  # a row finds itself, too
    points = _points(x, most).checkpoint()
    sizes = points.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.where(F.col("n") > BLOCK_ROWS)
    total, classes = large.agg(F.sum("n"), F.count(F.lit(1))).first()

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first", kind="stable").reset_index(drop=True)
        block = Block(np.stack(pdf["v"].to_numpy()), [list(a) for a in pdf["keys"]])
        parts = []
        for at in range(0, len(pdf), QUERY_ROWS):
            q = block.v[at:at + QUERY_ROWS]
            i, j, d = block.nearest(q, most, np.full(len(q), np.inf))
            parts.append(pd.DataFrame({"cls": pdf["cls"].iloc[0], "h1": pdf["h1"].to_numpy()[at + i], "h2": pdf["h2"].to_numpy()[at + i],
                                       "dist": d, "keys": [block.keys[a] for a in j.tolist()]}))
        return pd.concat(parts)

    small = points
    if total:
        small = points.join(_maybe_broadcast(large.select("cls"), classes), "cls", "left_anti")
    found = small.withColumn("first", F.col("keys")[0]).groupBy("cls").applyInPandas(whole, _FOUND)
    if total:
        in_large = points.join(_maybe_broadcast(large.select("cls"), classes), "cls", "left_semi")
        d = len(points.select("v").first()["v"])
        found = found.unionByName(_indexed(in_large, int(total), d, most))
    nearer = Window.partitionBy("cls", "h1", "h2").orderBy("dist", "nkey")
    best = (found.select("cls", "h1", "h2", "dist", F.explode("keys").alias("nkey"))
            .withColumn("_n", F.row_number().over(nearer)).where(F.col("_n") <= most)
            .groupBy("cls", "h1", "h2").agg(F.sort_array(F.collect_list(F.struct("dist", "nkey"))).alias("near")))
    others = F.slice(F.filter("near", lambda n: n["nkey"] != F.col("qkey")), 1, k)
    return (x.select("cls", "h1", "h2", "qkey").join(best, ["cls", "h1", "h2"])
            .select("cls", "qkey", F.posexplode(others).alias("nn", "n"))
            .select("cls", "qkey", F.col("n.nkey").alias("nkey"), F.col("n.dist").alias("dist"), "nn"))
