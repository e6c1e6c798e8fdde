"""Approximate nearest neighbours (Euclidean) by balanced posting lists.

Rows of one vector are one class with its smallest ids, as many as a result can
show.  Centroids come from a bounded sample: it is cut in two at the median of
the line between its two means, again and again, so every leaf has as many rows;
a leaf's mean is the centroid of one posting list.  A graph over the centroids,
held in every task, finds a vector's lists: each vector goes to the list of its
nearest centroid, a boundary vector also to the next one if that is hardly
farther.  A query walks the graph for all centroids within a ratio of its
nearest one's distance.  The ratio is fitted: the least with which sample rows
reach ``RECALL`` of their exact neighbours among the sample.

Lists that follow each other in the tree are put into groups of bounded size; a
list too long for a group is dealt over several by hash.  A query goes once to
each group that holds a list it wants.  Groups and queries are dealt by group
and sorted, and a task holds one group's vectors while queries stream by, so
neither a long list nor many queries meet in memory.  Candidates are prefiltered
by a matrix product and kept by the distance computed from the differences in
double precision; ties go to the smaller id.

What is bounded: the sample (``SAMPLE_ROWS`` rows, ``SAMPLE_BYTES``) and with it
the number of lists (``SAMPLE_PER_LIST`` sample rows a list), which every task
holds.  Beyond that number lists get longer.  Every row is indexed.  On vectors
without any clusters the fitted ratio selects most lists, so the search is close
to a comparison in blocks; the recall is kept, the saving is not.

Odd rows: vectors that are null, empty, zero or hold null or non-finite numbers,
rows without id, and vectors of another length than the most frequent one take no
part, as query or candidate.  Repeated rows are candidates of their own, and of
rows that share id and vector a query leaves out one, itself; a repeated query id
gets one result a row.  Fewer candidates give fewer ranks, an empty table no rows.
Distances whose squares overflow count as infinite.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftlab.llm.store import ready, written

K = 10
#: Rows and bytes of the sample that the centroids and the ratio are fitted on.
SAMPLE_ROWS, SAMPLE_BYTES = 32_768, 32 << 20
#: Rows that a list is meant to hold, and sample rows that a list has at least.
LIST_ROWS, SAMPLE_PER_LIST = 512, 8
#: Share of the sample's exact neighbours that the fitted ratio reaches.
RECALL = 0.97
#: A vector also goes to the lists of the next centroids up to this ratio, in ``COPIES`` lists at most.
CLOSURE, COPIES = 1.03, 2
#: Neighbours of a centroid in the graph, and the candidates kept while walking it.
DEGREE, BEAM = 16, 24
#: Groups of lists at least (if there are as many lists), and bytes of a group.
GROUPS, GROUP_BYTES = 48, 32 << 20
#: Queries that are compared with a list at a time, and vectors of a list.
QUERY_BLOCK, ROW_BLOCK = 512, 4096


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of each of ``x`` to each of ``y``."""
    with np.errstate(all="ignore"):
        d = (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T)
    return np.sqrt(np.maximum(d, 0))


def balanced_leaves(x: np.ndarray, leaves: int, seed: int = 0) -> list[np.ndarray]:
    """Row numbers of ``x`` in leaves of nearly equal size, in the order of the tree."""
    rng = np.random.default_rng(seed)

    def cut(rows: np.ndarray, n: int) -> list[np.ndarray]:
        if n == 1:
            return [rows]
        own = x[rows]
        two = own[rng.choice(len(own), 2, replace=False)]
        for _ in range(4):
            near = _distances(own, two).argmin(1) == 1
            if near.all() or not near.any():
                break
            two = np.stack([own[~near].mean(0), own[near].mean(0)])
        left = n // 2
        order = np.argsort(own @ (two[1] - two[0]), kind="stable")
        middle = len(own) * left // n
        return cut(rows[order[:middle]], left) + cut(rows[order[middle:]], n - left)

    return cut(np.arange(len(x)), leaves)


class Centroids:
    """Centroids and a graph that finds the nearest of them."""

    def __init__(self, points: np.ndarray):
        self.points = points
        n = len(points)
        width = min(DEGREE, n - 1)
        links = np.zeros((n, width + 2), np.int64)
        for at in range(0, n, 1024):
            d = _distances(points[at:at + 1024], points)
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
            links[at:at + len(d), :width] = np.argsort(d, axis=1, kind="stable")[:, :width]
        links[:, width] = (np.arange(n) + 1) % n  # the tree's order keeps the graph connected
        links[:, width + 1] = (np.arange(n) - 1) % n
        self.links = links
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 8)).astype(np.int64))

    def walk(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Up to ``beam`` nearest centroids found for each of ``x``, with distances, nearest first."""
        n, m = len(x), len(self.points)
        beam = min(beam, m)
        rows = np.arange(n)
        seen = np.zeros((n, m), bool)
        seen[:, self.entries] = True
        ids = np.broadcast_to(self.entries, (n, len(self.entries))).copy()
        dist = _distances(x, self.points[self.entries])
        if len(self.entries) < beam:
            more = beam - len(self.entries)
            ids = np.concatenate([ids, np.zeros((n, more), np.int64)], 1)
            dist = np.concatenate([dist, np.full((n, more), np.inf)], 1)
        done = ~np.isfinite(dist)
        while True:
            open_ = np.where(done, np.inf, dist)
            best = open_.argmin(1)
            active = np.flatnonzero(np.isfinite(open_[rows, best]))
            if len(active) == 0:
                break
            done[active, best[active]] = True
            near = self.links[ids[active, best[active]]]
            new = ~seen[active[:, None], near]
            seen[active[:, None], near] = True
            diff = self.points[near] - x[active, None, :]
            d = np.where(new, np.sqrt(np.einsum("ijk,ijk->ij", diff, diff)), np.inf)
            all_d = np.concatenate([dist[active], d], 1)
            keep = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
            dist[active] = np.take_along_axis(all_d, keep, 1)
            ids[active] = np.take_along_axis(np.concatenate([ids[active], near], 1), keep, 1)
            done[active] = np.take_along_axis(np.concatenate([done[active], ~new], 1), keep, 1)
        order = np.lexsort((ids, dist), axis=1)
        return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)

    def lists_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list): the lists that vectors go to, a boundary vector to more than one."""
        rows, lists = [], []
        step = max(1, (1 << 20) // max(len(self.points), 2 * DEGREE * x.shape[1]))
        for at in range(0, len(x), step):
            ids, dist = self.walk(x[at:at + step], BEAM)
            near = dist[:, :COPIES] <= dist[:, :1] * CLOSURE
            near[:, 0] = True
            row, place = np.nonzero(near)
            rows.append(at + row)
            lists.append(ids[row, place])
        return np.concatenate([*rows, np.zeros(0, np.int64)]), np.concatenate([*lists, np.zeros(0, np.int64)])

    def within(self, x: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, list, distance) of all centroids up to ``ratio`` times as far as the nearest, by widening beams."""
        out, rest, beam = [], np.arange(len(x)), 4 * BEAM
        while len(rest):
            wide = []
            step = max(1, (1 << 20) // max(len(self.points), 2 * DEGREE * x.shape[1]))
            for at in range(0, len(rest), step):
                some = rest[at:at + step]
                ids, dist = self.walk(x[some], beam)
                limit = dist[:, :1] * ratio
                short = (dist[:, -1] <= limit[:, 0]) & (ids.shape[1] < len(self.points))
                wide.append(some[short])
                row, place = np.nonzero((dist <= limit) & np.isfinite(dist) & ~short[:, None] | (np.arange(dist.shape[1]) == 0) & ~short[:, None])
                out.append((some[row], ids[row, place], dist[row, place]))
            rest, beam = np.concatenate(wide), beam * 4
        row, lists, dist = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((lists, row))
        return row[order], lists[order], dist[order]


def fit(sample: np.ndarray, rows: int, k: int = K) -> tuple[Centroids, float]:
    """Centroids for a table of so many rows, and the ratio that selects lists."""
    lists = max(1, min(math.ceil(rows / LIST_ROWS), len(sample) // SAMPLE_PER_LIST))
    centroids = Centroids(np.stack([sample[leaf].mean(0) for leaf in balanced_leaves(sample, lists)]))
    if lists == 1:
        return centroids, 1.0
    row, held = centroids.lists_of(sample)
    counts = np.bincount(row, minlength=len(sample))
    start = np.cumsum(counts) - counts
    asked = np.unique(np.linspace(0, len(sample) - 1, min(len(sample), 512)).astype(np.int64))
    most, ratios = min(k, len(sample) - 1), []
    for at in range(0, len(asked), 64):
        some = asked[at:at + 64]
        d = _distances(sample[some], sample)
        d[np.arange(len(some)), some] = np.inf
        near = np.argpartition(d, most - 1, axis=1)[:, :most]
        to_lists = _distances(sample[some], centroids.points)
        reach = np.minimum(np.take_along_axis(to_lists, held[start[near]], 1),
                           np.take_along_axis(to_lists, held[start[near] + counts[near] - 1], 1))
        ratios.append(reach / np.maximum(to_lists.min(1, keepdims=True), 1e-300))
    return centroids, float(max(1.0, np.quantile(np.concatenate(ratios), RECALL)))


def usable(table: DataFrame, id_: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part, and vectors as they are stored, of one length."""
    kind = table.schema[vector].dataType
    v = F.col(vector) if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType)) else \
        F.col(vector).cast("array<double>")
    rows = table.select(F.col(id_).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    most = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.where(F.size("v") == (most["d"] if most else 0))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1) if rows else np.zeros((0, 0))


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    cut = np.flatnonzero(np.diff(values)) + 1
    yield from zip([0, *cut.tolist()], [*cut.tolist(), len(values)], strict=True)


class Group:
    """The vectors of one group of lists, by list."""

    def __init__(self, lists: np.ndarray, v: np.ndarray, ids: pa.Array, h: np.ndarray):
        order = np.argsort(lists, kind="stable")
        self.lists, self.v, self.h = lists[order], v[order], h[order]
        self.ids = ids.take(pa.array(order))
        self.first = pa.compute.list_element(self.ids, 0).to_numpy()
        with np.errstate(all="ignore"):
            self.norm = (self.v * self.v).sum(1)
        self.at = {int(self.lists[a]): (a, b) for a, b in _runs(self.lists)} if len(lists) else {}

    def nearest(self, q: np.ndarray, wanted: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, distance) of the ``k`` nearest vectors of each query in its lists."""
        row = np.repeat(np.arange(len(q)), [len(w) for w in wanted])
        lists = np.concatenate([*wanted, np.zeros(0, np.int64)])
        least = np.full(len(q), np.inf)  # the k-th smallest square so far, or a bound of it
        found = []
        with np.errstate(all="ignore"):
            norm = (q * q).sum(1)
            for name in np.unique(lists).tolist():
                if name not in self.at:
                    continue
                start, end = self.at[name]
                asks = row[lists == name]
                for a in range(start, end, ROW_BLOCK):
                    b = min(end, a + ROW_BLOCK)
                    square = norm[asks, None] + self.norm[a:b] - 2 * (q[asks] @ self.v[a:b].T)
                    slack = 1e-11 * (norm[asks] + self.norm[a:b].max())
                    if b - a >= k:
                        least[asks] = np.fmin(least[asks], np.partition(square, k - 1, axis=1)[:, k - 1])
                    i, j = np.nonzero(~(square > (least[asks] + slack)[:, None]))
                    diff = q[asks[i]] - self.v[a + j]
                    found.append((asks[i], a + j, np.sqrt((diff * diff).sum(1))))
        if not found:
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        i, j, d = (np.concatenate(x) for x in zip(*found, strict=True))
        d = np.where(np.isnan(d), np.inf, d)
        order = np.lexsort((self.h[j, 1], self.h[j, 0], self.first[j], d, i))
        i, j, d = i[order], j[order], d[order]
        again = np.zeros(len(i), bool)  # a class of two lists
        again[1:] = (i[1:] == i[:-1]) & (self.h[j[1:]] == self.h[j[:-1]]).all(1)
        i, j, d = i[~again], j[~again], d[~again]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        return i[place < k], j[place < k], d[place < k]


def _scan(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Hold a group's vectors while its queries, which sort behind them, pass by."""
    now, parts, group = None, [], None
    for batch in batches:
        grp, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for a, b in _runs(grp * 2 + kind):
            part = batch.slice(a, b - a)
            if grp[a] != now:
                now, parts, group = grp[a], [], None
            v = _matrix(part.column(6), b - a)
            h = np.stack([part.column(3).to_numpy(), part.column(4).to_numpy()], 1)
            if kind[a] == 0:
                parts.append((part.column(2).flatten().to_numpy(), v, part.column(5), h))
                continue
            if group is None:
                if not parts:
                    continue
                lists, vs, ids, hs = zip(*parts, strict=True)
                group = Group(np.concatenate(lists), np.concatenate(vs), pa.concat_arrays(ids), np.concatenate(hs))
                parts = []
            ends = part.column(2).offsets.to_numpy()
            flat = part.column(2).flatten().to_numpy()
            wanted = [flat[x - ends[0]:y - ends[0]] for x, y in zip(ends[:-1], ends[1:], strict=True)]
            for at in range(0, b - a, QUERY_BLOCK):
                i, j, d = group.nearest(v[at:at + QUERY_BLOCK], wanted[at:at + QUERY_BLOCK], k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[at + i, 0]), pa.array(h[at + i, 1]), pa.array(group.h[j, 0]), pa.array(group.h[j, 1]), pa.array(d),
                     group.ids.take(pa.array(j))], names=["h1", "h2", "c1", "c2", "score", "ids"])


def _groups(counts: dict[int, int], lists: int, d: int) -> tuple[np.ndarray, np.ndarray]:
    """The first group and the number of groups of each list, in the order of the tree."""
    total = sum(counts.values())
    room = max(1, min(math.ceil(total / GROUPS), GROUP_BYTES // (8 * d)))
    first, pieces, at, held = np.zeros(lists, np.int64), np.ones(lists, np.int64), 0, 0
    for name in range(lists):
        n = counts.get(name, 0)
        if held and held + n > room:
            at, held = at + 1, 0
        first[name] = at
        if n > room:
            pieces[name] = math.ceil(n / room)
            at, held = at + int(pieces[name]), 0
        else:
            held += n
    return first, pieces


def nearest(table: DataFrame, id_: str, vector: str, asks: Column, k: int = K) -> DataFrame:
    """(query_id, rank, <id_>, score): the ``k`` nearest other rows of each row whose ``asks`` holds.

    ``asks`` is a condition on the column ``id``, the rows' id (an integer).
    """
    spark = table.sparkSession
    ready(spark)
    rows = usable(table.withColumn(id_, F.col(id_).cast("bigint")), id_, vector)
    rows = rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    first = Window.partitionBy("h1", "h2").orderBy("id")
    few = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    classes = written(few.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("v").alias("v")), "vectors")
    n = classes.count()
    if n == 0:
        return spark.createDataFrame([], f"query_id bigint, rank int, {id_} bigint, score double")
    d = len(classes.select("v").first()["v"])
    size = min(SAMPLE_ROWS, max(64, SAMPLE_BYTES // (8 * d)))
    share = F.lit(size / n * 2.0**63) if n > size else F.lit(2.0**63)
    sample = classes.where(F.shiftrightunsigned("h1", 1).cast("double") <= share).select("h1", "h2", "v").toArrow()
    sample = sample.sort_by([("h1", "ascending"), ("h2", "ascending")])["v"].combine_chunks()
    centroids, ratio = fit(_matrix(sample, len(sample)), n, k)
    lists = len(centroids.points)
    model = spark.sparkContext.broadcast(centroids)
    element = classes.schema["v"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, name = model.value.lists_of(_matrix(batch.column(3), batch.num_rows))
            yield pa.RecordBatch.from_arrays([pa.array(name), *batch.take(pa.array(row)).columns], names=["list", "h1", "h2", "ids", "v"])

    placed = written(classes.select("h1", "h2", "ids", "v").mapInArrow(
        assign, f"list bigint, h1 bigint, h2 bigint, ids array<bigint>, v {element}"), "lists")
    counts = {r["list"]: r["n"] for r in placed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each list
    first_of, pieces = _groups(counts, lists, d)
    where = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(first_of, pieces, strict=True))],
                                  "list bigint, first bigint, pieces bigint")
    held = placed.join(F.broadcast(where), "list").select(
        (F.col("first") + F.pmod("h2", "pieces")).alias("grp"), F.lit(0).alias("kind"), F.array("list").alias("lists"), "h1", "h2", "ids", "v")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(2), batch.num_rows)
            row, name, _ = model.value.within(v, ratio)
            spread = pieces[name]
            row, name = np.repeat(row, spread), np.repeat(name, spread)
            grp = first_of[name] + np.arange(len(name)) - np.repeat(np.cumsum(spread) - spread, spread)
            order = np.lexsort((name, grp, row))
            row, name, grp = row[order], name[order], grp[order]
            new = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(grp, prepend=-1) != 0))
            took = batch.take(pa.array(row[new]))
            wanted = pa.ListArray.from_arrays(pa.array([*new.tolist(), len(row)], pa.int32()), pa.array(name))
            none = pa.array([[]] * len(new), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(grp[new]), pa.array(np.ones(len(new), np.int32)), wanted, took.column(0), took.column(1), none, took.column(2)],
                names=["grp", "kind", "lists", "h1", "h2", "ids", "v"])

    asked = written(rows.where(asks).select("id", "h1", "h2"), "asked")
    which = classes.join(asked.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").select("h1", "h2", "v")
    queries = which.mapInArrow(ask, f"grp bigint, kind int, lists array<bigint>, h1 bigint, h2 bigint, ids array<bigint>, v {element}")
    groups = int((first_of + pieces).max())
    met = held.unionByName(queries).repartition(groups, "grp").sortWithinPartitions("grp", "kind")
    found = met.mapInArrow(lambda x: _scan(x, k + 1), "h1 bigint, h2 bigint, c1 bigint, c2 bigint, score double, ids array<bigint>")
    nearer = Window.partitionBy("h1", "h2").orderBy("score", "id")
    best = (written(found, "found").dropDuplicates(["h1", "h2", "c1", "c2"]).select("h1", "h2", "score", F.explode("ids").alias("id"))
            .withColumn("n", F.row_number().over(nearer)).where(F.col("n") <= k + 1)
            .groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("score", "id"))).alias("near")))
    own = F.struct(F.lit(0.0).alias("score"), F.col("asker").alias("id"))
    place = F.array_position("near", own).cast("int")
    others = F.filter("near", lambda x, i: i + 1 != place)
    done = asked.withColumnRenamed("id", "asker").join(best, ["h1", "h2"]).select(
        F.col("asker").alias("query_id"), F.posexplode(F.slice(others, 1, k)).alias("rank", "x"))
    return done.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias(id_), F.col("x.score").alias("score"))
