"""Gap verdict, top-k membership and rank aggregation on small hand-made tables."""

import pytest

from shiftlab.operators import importance as im
from shiftlab.operators import sweep as sw


def test_gap_verdict_missing_baseline_counts_zero(spark):
    g = spark.createDataFrame([(0.0, "a", 0.9, 0.85, 0.05), (0.5, "a", 0.95, 0.8, 0.15),
                               (0.5, "b", 0.9, 0.895, 0.005)],
                              "slider double, algo string, train_f1 double, val_f1 double, gap double")
    r = {x["algo"]: x for x in sw.gap_verdict(g).collect()}
    assert r["a"]["widening"] is True and r["a"]["baseline_gap"] == pytest.approx(0.05)
    assert r["b"]["baseline_gap"] == 0.0 and r["b"]["widening"] is False


def test_in_top_k_and_rank_aggregation(spark):
    imp = spark.createDataFrame(
        [("gini", "f1", 0.5), ("gini", "f2", 0.3), ("gini", "f3", 0.2),
         ("perm", "f2", 0.4), ("perm", "f1", 0.1)],
        "method string, feature string, importance double")
    top = {r["method"]: r["in_top_k"] for r in sw.in_top_k(imp, "f2", 1).collect()}
    assert top == {"gini": False, "perm": True}
    rows = im.top_features(imp, 10).collect()
    # f3 is missing from perm -> rank = longest list (3); mean ranks f1 1.5, f2 1.5, f3 3
    got = [(r["feature"], r["avg_rank"]) for r in rows]
    assert got == [("f1", 1.5), ("f2", 1.5), ("f3", 3.0)]
