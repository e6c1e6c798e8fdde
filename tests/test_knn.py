"""Exact neighbours from the metric index equal brute force, also with copies and ties."""

import numpy as np
import pytest

from shiftlab.operators import knn
from shiftlab.operators.smote import smote


def brute(rows, k):
    by, out = {}, set()
    for i, c, v in rows:
        by.setdefault(c, []).append((str(i), np.array(v)))
    for c, held in by.items():
        keys, x = np.array([a for a, _ in held]), np.stack([v for _, v in held])
        for i in range(len(held)):
            d = np.sqrt(((x[i] - x) ** 2).sum(1))
            out |= {(c, keys[i], keys[j], n) for n, j in enumerate([j for j in np.lexsort((keys, d)) if j != i][:k])}
    return out


def points(n, kind, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 5))
    if kind == "clusters":
        x = rng.normal(size=(25, 5))[rng.integers(0, 25, n)] * 6 + 0.2 * x
    if kind == "copies":  # a third of the rows is one vector
        x = np.round(x)
        x[::3] = 1.0
    return [(i, "abc"[min(2, i % 7)], v.tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("kind", ["clusters", "copies"])
def test_index_equals_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(knn, "BLOCK_ROWS", 60)
    rows = points(700, kind)
    df = spark.createDataFrame(rows, "id long, c string, v array<double>")
    got = {(r.cls, r.qkey, r.nkey, r.nn) for r in knn.exact_knn(df, "c", "v", "id", 4).collect()}
    assert got == brute(rows, 4)


def test_index_excludes_most_blocks_of_clustered_points(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK_ROWS", 40)
    rows = [(i, "a", v) for i, _, v in points(2000, "clusters", 1)]
    x = spark.createDataFrame(rows, "id long, c string, v array<double>").selectExpr(
        "c AS cls", "CAST(id AS STRING) AS qkey", "v", "xxhash64(v) AS h1", "xxhash64(1, v) AS h2")
    met = knn.dealt(knn._points(x, 5).checkpoint(), 2000, 5, 5).groupBy("blk", "piv").agg({"kind": "sum", "*": "count"}).collect()
    compared = sum(r["sum(kind)"] * (r["count(1)"] - r["sum(kind)"]) for r in met)
    assert compared < 2000 * 2000 / 5


def test_small_classes_and_rows_that_take_no_part(spark):
    rows = [(1, "a", [1.0, 1.0]), (2, "a", [1.0, 1.0]), (3, "b", [0.0, 0.0]), (4, None, [1.0, 1.0]), (5, "a", None)]
    df = spark.createDataFrame(rows, "id long, c string, v array<double>")
    assert [(r.cls, r.qkey, r.nkey, r.dist, r.nn) for r in knn.exact_knn(df, "c", "v", "id", 3).orderBy("qkey").collect()] == [
        ("a", "1", "2", 0.0, 0), ("a", "2", "1", 0.0, 0)]
    assert knn.exact_knn(df.limit(0), "c", "v", "id", 3).count() == 0


def test_smote_with_a_single_row_class_copies_at_random(spark):
    rows = [(i, "big", [float(i), 0.0]) for i in range(12)] + [(20, "one", [5.0, 5.0])]
    out = smote(spark.createDataFrame(rows, "id long, c string, v array<double>"), "v", "c", 1.0, ["id"]).collect()
    one = [r for r in out if r.c == "one"]
    assert len(out) == 24 and len(one) == 12 and {tuple(r.v) for r in one} == {(5.0, 5.0)} and len({r.row_key for r in out}) == 24
