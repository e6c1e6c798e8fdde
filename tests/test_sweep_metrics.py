"""Exit rule, fit diagnosis and metric worked examples."""

import pytest
from pyspark.sql import functions as F

from shiftlab.operators import metrics as mt
from shiftlab.operators import sweep as sw


def _steps(spark, scores):
    rows = [("r", i, float(i), "a", float(s), 10) for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, sw.STEP_SCHEMA)


@pytest.mark.parametrize("scores,reason,kept,opt", [
    ([.50, .60, .58, .55, .54], "peak_detected", 4, 1),
    ([.50, .60, .6000, .6000, .6000, .7], "plateau", 5, 1),
    ([.50, .55, .60, .65], "complete", 4, 3),
    ([.60, .50, .55, .65], "complete", 4, 3),
])
def test_exit_rule_cases(spark, scores, reason, kept, opt):
    steps = _steps(spark, scores)
    traj = sw.trajectory(steps).collect()
    assert len(traj) == kept
    assert {r["exit_reason"] for r in traj} == {reason}
    base = spark.createDataFrame([("r", "a", 0.5)], "run_id string, algorithm string, score double")
    o = sw.optimum(steps, base).first()
    assert o["optimal_value"] == float(opt)


def test_driver_loop_uses_same_rule(spark):
    seq = iter([.50, .50, .60, .58, .55, .54, .9])

    def scorer(df):
        return {"a": next(seq)}

    d = spark.range(5).withColumnRenamed("id", "k")
    steps, base = sw.run_sweep(d, "k", "none", scorer, ["k"], grid=[0.1, 0.2, 0.3, 0.4, 0.5, 0.6])
    assert steps.count() == 4  # .50 .60 .58 .55 then peak


@pytest.mark.parametrize("train,val,status", [
    (.99, .90, "overfit"), (.60, .55, "underfit"), (.80, .79, "optimal"),
    (.90, .85, "slight_overfit"), (.71, .69, "acceptable"),
])
def test_fit_diagnosis(spark, train, val, status):
    m = spark.createDataFrame([("x", train, val, 0.5, 0.1)],
                              "algorithm string, train_f1 double, val_f1 double, cv_mean double, cv_std double")
    r = sw.fit_diagnosis(m).first()
    assert r["status"] == status
    assert r["explanation"]


def test_worked_confusion_example(spark):
    # truth/pred pairs: A A, A B, B B, B B, C A, C C
    rows = [("A", "A"), ("A", "B"), ("B", "B"), ("B", "B"), ("C", "A"), ("C", "C")]
    p = spark.createDataFrame(rows, "t string, p string")
    cm = {(r["y_true"], r["y_pred"]): r["n"] for r in mt.confusion(p, "t", "p", ["A", "B", "C"]).collect()}
    assert cm[("A", "A")] == 1 and cm[("A", "B")] == 1 and cm[("C", "A")] == 1 and cm[("B", "C")] == 0
    pc = {r["class"]: r for r in mt.per_class(mt.confusion(p, "t", "p", ["A", "B", "C"])).collect()}
    assert pc["A"]["precision"] == 0.5 and pc["A"]["recall"] == 0.5
    assert pc["B"]["precision"] == pytest.approx(2 / 3) and pc["B"]["recall"] == 1.0
    assert pc["C"]["precision"] == 1.0 and pc["C"]["recall"] == 0.5
    assert pc["A"]["specificity"] == pytest.approx(3 / 4)
    s = mt.summary(mt.per_class(mt.confusion(p, "t", "p", ["A", "B", "C"]))).first()
    f1 = [0.5, 0.8, 2 / 3]
    assert s["f1_macro"] == pytest.approx(sum(f1) / 3)
    assert s["accuracy"] == pytest.approx(4 / 6)


def test_auc_matches_bruteforce(spark):
    import random

    random.seed(1)
    rows = [(random.choice(["a", "b", "c"]), [round(random.random(), 2) for _ in range(3)]) for _ in range(300)]
    p = spark.createDataFrame(rows, "t string, s array<double>")
    long = mt.scores_long(p, "t", "s", ["a", "b", "c"])
    got = {r["class"]: r["auc"] for r in mt.auc_per_class(long).collect()}
    for ci, c in enumerate(["a", "b", "c"]):
        pos = [s[ci] for t, s in rows if t == c]
        neg = [s[ci] for t, s in rows if t != c]
        u = sum((x > y) + 0.5 * (x == y) for x in pos for y in neg)
        assert got[c] == pytest.approx(u / (len(pos) * len(neg)))


def test_macro_auc_null_for_two_classes(spark):
    p = spark.createDataFrame([("a", [0.2, 0.8]), ("b", [0.6, 0.4])], "t string, s array<double>")
    r = mt.macro_auc(mt.scores_long(p, "t", "s", ["a", "b"]), 2).first()
    assert r["roc_auc"] is None
    assert F is not None


def test_auc_of_piled_up_scores(spark):
    """Distinct scores that crowd at 0 and 1 fall into buckets of equal depth; the AUC is that of all pairs."""
    import numpy as np

    from shiftlab.operators import metrics as mt

    rng = np.random.default_rng(0)
    n = 4000
    score = np.where(rng.random(n) < 0.5, rng.random(n) * 1e-9, 1 - rng.random(n) * 1e-9)
    score[::7] = 0.5
    y = rng.random(n) < 0.3 + 0.4 * score
    long = spark.createDataFrame([("a", bool(t), float(v)) for t, v in zip(y, score)] + [("b", True, 0.1)], "class string, y boolean, score double")
    got = {r["class"]: r["auc"] for r in mt.auc_per_class(long).collect()}
    pos, neg = score[y], score[~y]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert abs(got["a"] - want) < 1e-12 and got["b"] is None
    hist = long.where("class = 'a'").groupBy("class", "score").count()
    sizes = [r["count"] for r in mt.score_buckets(hist).groupBy("b").count().collect()]
    assert max(sizes) <= 2 * np.mean(sizes) and len(sizes) > 200
