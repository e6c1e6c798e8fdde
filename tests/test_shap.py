"""SHAP over leaves: sums to f(x) - E[f], and equals the Shapley values by their definition."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from shiftlab.operators import models as md
from shiftlab.operators import shap as sh
from shiftlab.operators.importance import forest


def data(spark, n=300, copies=1):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(n):
        x = rng.normal(size=5)
        rows += [(i * 10 + c, str(int(x[0] + 0.5 * x[1] > 0) + int(x[2] > 1)), [float(v) for v in x]) for c in range(copies)]
    df = spark.createDataFrame(rows, "id long, label string, f array<double>")
    return df.select("id", "label", array_to_vector("f").alias("features"))


def shapley(found, x, features):
    """Shapley values by their definition: a feature outside a coalition passes a leaf with share z."""
    def value(known):
        out = 0
        for _, _, own, path in found.leaves:
            w = 1.0
            for f, lo, hi, cats, z, _ in path:
                inside = lo < x[f] <= hi if cats is None else x[f] in cats
                w *= float(inside) if f in known else z
            out = out + w * np.array(own)
        return out / found.trees

    phi = []
    for j in range(features):
        rest = [f for f in range(features) if f != j]
        phi.append(sum(factorial(len(s)) * factorial(features - len(s) - 1) / factorial(features) * (value({*s, j}) - value(set(s)))
                       for size in range(features) for s in combinations(rest, size)))
    return np.array(phi)


def test_values_equal_the_definition(spark):
    df = data(spark)
    indexer, classes = md.label_indexer(df, "label")
    model = forest("features", md.LABEL_IDX, 6, 4, 42).fit(indexer.transform(df))
    found = sh.read_forest(model, spark)
    some = df.limit(12)
    got = {}
    for r in sh.row_values(some.select(F.struct("id").alias("row"), vector_to_array("features").alias("x")), found).collect():
        got.setdefault(r["row"]["id"], np.zeros((5, len(classes))))[r["feature"]] = r["phi"]
    for r in model.transform(some).select("id", "probability", "features").collect():
        assert np.allclose(got[r["id"]].sum(0), r["probability"].toArray() - found.expected, atol=1e-9)
        assert np.allclose(got[r["id"]], shapley(found, r["features"].toArray(), 5), atol=1e-9)


@pytest.mark.parametrize("copies", [1, 3])
def test_importance_over_all_rows(spark, copies):
    imp = sh.shap_importance(data(spark, 200, copies), "label", "features", [f"x{i}" for i in range(5)], ["id"], trees=7, depth=4).collect()
    assert {r["feature"] for r in imp[:3]} == {"x0", "x1", "x2"} and len(imp) == 5
    assert all(r["importance"] > 0 for r in imp)


def test_values_are_added_up_where_their_rows_are(spark):
    import re

    df = data(spark, 120, 2)
    df = df.unionByName(df.limit(5))  # keys may repeat
    indexer, _ = md.label_indexer(df, "label")
    found = sh.read_forest(forest("features", md.LABEL_IDX, 4, 3, 42).fit(indexer.transform(df)), spark)
    got = sh.row_values(df.select(F.struct("id").alias("row"), vector_to_array("features").alias("x")), found)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(row" in plan and not re.search(r"hashpartitioning\([^)]*feature", plan)
    assert got.count() == got.select("row", "feature").distinct().count()
    assert {r["row"]["id"] for r in got.collect()} == {r["id"] for r in df.collect()}


def test_many_patterns_are_not_shuffled(spark):
    """More patterns than may be broadcast: values still stay where their rows are, and only rows are shuffled."""
    rng = np.random.default_rng(1)
    rows = [(i, str(rng.integers(3)), [float(v) for v in rng.normal(size=8)]) for i in range(250)]
    df = spark.createDataFrame(rows, "id long, label string, f array<double>").select("id", "label", array_to_vector("f").alias("features"))
    indexer, _ = md.label_indexer(df, "label")
    model = forest("features", md.LABEL_IDX, 30, 8, 42).fit(indexer.transform(df))
    found = sh.read_forest(model, spark)
    assert len(found.leaves) * 250 > 200_000  # meetings of a row and a leaf, most of them a pattern of their own
    got = sh.row_values(df.select("id", vector_to_array("features").alias("x")), found, row="id")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(row" in plan and "hashpartitioning(tree" not in plan and "Join" not in plan
    sums = np.zeros((250, 3))
    for r in got.collect():
        sums[r["row"]] += r["phi"]
    for r in model.transform(df).select("id", "probability").collect():
        assert np.allclose(sums[r["id"]], r["probability"].toArray() - found.expected, atol=1e-9)


@pytest.mark.parametrize("block", [1, 60, 1_000_000])
def test_rows_that_share_a_key_are_added_up_over_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(sh, "BLOCK", block)
    df = data(spark, 90)
    indexer, _ = md.label_indexer(df, "label")
    found = sh.read_forest(forest("features", md.LABEL_IDX, 3, 3, 42).fit(indexer.transform(df)), spark)
    key = F.when(F.col("id") % 30 < 20, F.col("id") % 7)  # a third of the rows has none
    rows = df.select("id", key.alias("key"), vector_to_array("features").alias("x"))
    single = sh.row_values(rows, found, row="id").join(rows.select(F.col("id").alias("row"), "key"), "row")
    want = {}
    for r in single.collect():
        want[r["key"], r["feature"]] = want.get((r["key"], r["feature"]), 0) + np.array(r["phi"])
    got = {(r["row"], r["feature"]): r["phi"] for r in sh.row_values(rows, found, row="key").collect()}
    assert set(got) == set(want) and {k for k, _ in got} == {None, *range(7)}
    assert all(np.allclose(got[k], want[k], atol=1e-12) for k in want)


def test_features_that_a_row_lacks_agree_with_no_interval():
    import pyarrow as pa

    got = sh._by_feature(pa.array([[1.0, 2.0, 3.0], None, [4.0], [5.0, None, 6.0, 7.0]]).slice(0, 4), [0, 2])
    assert np.array_equal(got, [[1.0, np.nan, 4.0, 5.0], [3.0, np.nan, np.nan, 6.0]], equal_nan=True)
