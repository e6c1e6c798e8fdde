"""Exact medians on odd columns, rows without label, NaN text, failing sweep steps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftlab.functions.scalar import coerce_double
from shiftlab.operators import split as sp
from shiftlab.operators import sweep as sw
from shiftlab.operators.quantile import exact_median, exact_quantile
from shiftlab.operators.smote import smote


def test_median_of_odd_columns(spark):
    half = spark.range(100_000).select((F.col("id") % 2).cast("double").alias("v"))
    assert exact_median(half, "v") == 0.5
    odd = half.unionByName(spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "v double"))
    assert exact_median(odd, "v") == 1.0
    wide = spark.createDataFrame([(-1.7e308,), (1.7e308,), (1e-300,), (2e-300,), (float("-inf"),)], "v double")
    assert exact_median(wide, "v") == 1e-300
    assert exact_median(spark.createDataFrame([(float("-inf"),)] * 3, "v double"), "v") == float("-inf")
    assert exact_median(half.limit(0), "v") is None
    x = np.random.RandomState(0).lognormal(0, 9, 5001)
    d = spark.createDataFrame([(float(v),) for v in x], "v double")
    for p in (0.0, 0.1, 0.5, 0.99, 1.0):
        assert np.isclose(exact_quantile(d, "v", p), np.quantile(x, p))


def labelled(spark, n=1000):
    return spark.range(n).select("id", F.when(F.col("id") % 10 != 0, (F.col("id") % 3).cast("string")).alias("y"))


@pytest.mark.parametrize("most,rows", [(500, 500), (900, 900), (2000, 900)])
def test_subsample_without_labels(spark, most, rows):
    got = sp.stratified_subsample(labelled(spark), "y", most, ["id"])
    assert got.count() == rows and got.where("y IS NULL").count() == 0


def test_split_without_labels(spark):
    got = sp.train_test_split(labelled(spark), "y", ["id"])
    assert {r["split"]: r["count"] for r in got.groupBy("split").count().collect()} == {"test": 180, "train": 720}


def test_smote_null_is_no_class(spark):
    rows = [(k, "A", [float(k), 1.0]) for k in range(20)] + [(k, "B", [float(k), 5.0]) for k in range(20, 30)]
    rows += [(30, None, [1.0, 1.0]), (31, None, [2.0, 2.0])]
    df = spark.createDataFrame(rows, "id bigint, y string, x array<double>")
    got = {r["y"]: r["count"] for r in smote(df, "x", "y", 1.0, ["id"]).groupBy("y").count().collect()}
    assert got == {"A": 20, "B": 20}


def test_nan_text_gets_the_default(spark):
    df = spark.createDataFrame([("nan",), ("NaN",), ("2.5",), ("x",), (None,)], "v string")
    assert [r[0] for r in df.select(coerce_double("v")).collect()] == [0.0, 0.0, 2.5, 0.0, 0.0]


def test_gap_verdict_needs_a_baseline(spark):
    gaps = spark.createDataFrame([(0.5, "a", 0.9, 0.8, 0.1)],
                                 "slider double, algo string, train_f1 double, val_f1 double, gap double")
    assert sw.gap_verdict(gaps).count() == 0


def test_failing_steps_are_noted(spark):
    df = labelled(spark, 300).where("y IS NOT NULL")
    calls = []

    def every_second(x):
        calls.append(1)
        if len(calls) % 2 == 0:
            raise ValueError("no score")
        return {"a": 0.5 + 0.01 * len(calls)}

    failures = []
    steps, _ = sw.run_sweep(df, "y", "target", every_second, ["id"], [0.0, 0.3, 0.6], failures=failures)
    assert steps.count() == 1 and [f[1] for f in failures] == [0, 2]

    def only_baseline(x):
        calls.append(1)
        if len(calls) > start + 1:
            raise ValueError("no score")
        return {"a": 0.5}

    start = len(calls)
    with pytest.raises(RuntimeError):
        sw.run_sweep(df, "y", "target", only_baseline, ["id"], [0.0, 0.3])
