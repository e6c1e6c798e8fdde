"""Softmax boosting, early stopping, calibrated probabilities, overlapped chains of jobs, isolated failures."""

import time

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from shiftlab.operators import boosting as bo
from shiftlab.operators import calibrate as ca
from shiftlab.operators import models as md
from shiftlab.operators import sweep as sw
from shiftlab.operators.overlap import Overlapped, overlapped


def frame(spark, x, y):
    rows = [(i, [float(a) for a in v], float(c)) for i, (v, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, x array<double>, y double").withColumn("features", array_to_vector("x"))


def test_boosting_two_rounds_by_hand(spark):
    """x splits the classes: each round moves a leaf by 0.1 * sum(y - p) / (sum p (1 - p) + 1)."""
    df = frame(spark, [[0], [0], [1], [1]], [0, 0, 1, 1])
    model = bo.SoftmaxBoost(rounds=2, depth=1, min_child=0.1).fit(df, "features", "y", 2)
    m = 0.1 * (2 * 0.5) / (2 * 0.25 + 1)
    p = 1 / (1 + np.exp(2 * m))  # of the other class
    m += 0.1 * (2 * p) / (2 * p * (1 - p) + 1)
    got = [list(r["rawPrediction"]) for r in model.transform(df, "features").orderBy("id").collect()]
    assert np.allclose(got, [[m, -m], [m, -m], [-m, m], [-m, m]], atol=1e-12)


def naive_boost(x, y, k, rounds, depth, reg=1.0, min_child=1.0, rate=0.1):
    margins = np.zeros((len(x), k))

    def grow(rows, g, h, level):
        best = (1e-12, None)
        for f in range(x.shape[1]) if level else []:
            for cut in np.unique(x[rows, f])[:-1]:
                left = x[rows, f] <= cut
                hl, hr = h[rows][left].sum(), h[rows][~left].sum()
                if hl < min_child or hr < min_child:
                    continue
                gain = (g[rows][left].sum() ** 2 / (hl + reg) + g[rows][~left].sum() ** 2 / (hr + reg)
                        - g[rows].sum() ** 2 / (h[rows].sum() + reg))
                if gain > best[0] + 1e-10 * max(1.0, abs(best[0])):
                    best = (gain, rows[left], rows[~left])
        if best[1] is None:
            return [(rows, -g[rows].sum() / (h[rows].sum() + reg))]
        return grow(best[1], g, h, level - 1) + grow(best[2], g, h, level - 1)

    for _ in range(rounds):
        p = bo.softmax(margins)
        step = np.zeros_like(margins)
        for c in range(k):
            for rows, value in grow(np.arange(len(x)), p[:, c] - (y == c), p[:, c] * (1 - p[:, c]), depth):
                step[rows, c] = value
        margins = margins + rate * step
    return margins


def test_boosting_over_several_blocks_equals_naive(spark, monkeypatch):
    monkeypatch.setattr(bo, "BLOCK_ROWS", 40)
    monkeypatch.setattr(bo, "REFRESH", 2)
    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, (150, 4)).astype(float)
    y = (x[:, 0] + x[:, 1] > 11).astype(int) + (x[:, 2] > 6)
    df = frame(spark, x, y).repartition(4)
    model = bo.SoftmaxBoost(rounds=5, depth=3).fit(df, "features", "y", 3)
    got = np.array([list(r["rawPrediction"]) for r in model.transform(df, "features").orderBy("id").collect()])
    assert np.allclose(got, naive_boost(x, y, 3, 5, 3), atol=1e-9)
    out = model.transform(df, "features").selectExpr("prediction", "y", "probability").collect()
    assert np.mean([r.prediction == r.y for r in out]) > 0.9 and all(abs(sum(r.probability) - 1) < 1e-12 for r in out)


@pytest.mark.parametrize(("block_rows", "refreshed"), [(20, 5), (1000, 2)])
def test_boosting_adds_a_rounds_trees_once(spark, monkeypatch, block_rows, refreshed):
    """Tasks of several blocks get each round's trees once; the deepest leaves need no job; results are those of one block."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 12, (150, 4)).astype(float)
    y = (x[:, 0] + x[:, 1] > 11).astype(int) + (x[:, 2] > 6)
    df = frame(spark, x, y).coalesce(1)
    monkeypatch.setattr(bo, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(bo, "REFRESH", 2)
    seen = {"_refreshed": [], "_splits": []}
    for name, calls in seen.items():
        plain = getattr(bo.SoftmaxBoost, name)
        monkeypatch.setattr(bo.SoftmaxBoost, name, lambda self, blocks, since, *rest, plain=plain, calls=calls:
                            calls.append(len(since)) or plain(self, blocks, since, *rest))
    model = bo.SoftmaxBoost(rounds=6, depth=3).fit(df, "features", "y", 3)
    assert len(seen["_refreshed"]) == refreshed and sum(seen["_refreshed"]) == (5 if refreshed == 5 else 4)
    assert len(seen["_splits"]) <= 6 * 3 and max(seen["_splits"]) == (0 if refreshed == 5 else 1)
    assert np.allclose(model.margins(x), naive_boost(x, y, 3, 6, 3), atol=1e-9)


def test_boosting_bins():
    x = np.array([[np.nan, 1.0], [2.0, 1.0], [3.0, 1.0], [np.inf, 1.0]])
    edges = bo.quantile_edges(x, 8)
    assert [e.tolist() for e in edges] == [[2.0], []]
    assert bo.to_bins(x, edges).tolist() == [[1, 0], [0, 0], [1, 0], [1, 0]]
    wide = np.arange(1000.0)[:, None]
    assert max(np.bincount(bo.to_bins(wide, bo.quantile_edges(wide, 16))[:, 0])) <= 64


def blobs(n, k=3, spread=0.6, seed=1):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, k, n)
    return rng.normal(size=(k, 4))[y] * 1.5 + spread * rng.normal(size=(n, 4)), y


def test_net_stops_early_and_runs_out(spark):
    x, y = blobs(200, spread=0.1)
    df = frame(spark, x, y)
    net = md.EarlyStoppedNet(hidden=(6,), max_iter=200, slice_iter=4, patience=3)
    model = net.fit(df, "features", "y", 4, 3)
    best = int(np.argmax(net.history))
    assert len(net.history) == best + 4 < 50  # three slices without a gain
    assert model.transform(df).where("prediction = y").count() > 190
    short = md.EarlyStoppedNet(hidden=(6,), max_iter=8, slice_iter=4, patience=3)
    short.fit(df, "features", "y", 4, 3)
    assert len(short.history) == 2
    few = md.EarlyStoppedNet(hidden=(2,), max_iter=4)
    assert few.fit(df.limit(3), "features", "y", 4, 3) is not None


def test_coupling_recovers_consistent_probabilities():
    p = np.random.default_rng(0).dirichlet(np.ones(5), 40)
    pairs = p[:, :, None] / (p[:, :, None] + p[:, None, :])
    assert np.allclose(ca.couple(pairs), p, atol=1e-5)


def test_sigmoids_find_the_odds(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(size=4000) * 2
    own = rng.random(4000) < 1 / (1 + np.exp(-(1.5 * z - 0.4)))
    rows = [(0.0 if o else 1.0, [float(v), 0.0]) for v, o in zip(z, own)]
    s = ca.fit_sigmoids(spark.createDataFrame(rows, "y double, raw array<double>"), "y", "raw", 2)
    assert abs(s.a[0, 1] + 1.5) < 0.15 and abs(s.b[0, 1] - 0.4) < 0.12
    one = ca.fit_sigmoids(spark.createDataFrame(rows[:1] * 5, "y double, raw array<double>"), "y", "raw", 2)
    assert np.isfinite(one.pairs(np.zeros((1, 2)))).all()


def test_svm_probabilities_are_calibrated(spark):
    x, y = blobs(400, spread=1.3)
    df = frame(spark, x, y)
    train, test = df.where("id % 5 < 3"), df.where("id % 5 >= 3")
    (out,) = md.RFFSVM(max_iter=12, n_components=32).fit_predict(train, [test], "features", "y", 3)
    rows = out.select("probability", "y").collect()
    p = np.array([list(r.probability) for r in rows])
    own = np.array([r.y for r in rows], int)
    assert np.allclose(p.sum(1), 1, atol=1e-9)
    top, hit = p.max(1), p.argmax(1) == own
    bins = np.minimum((top * 5).astype(int), 4)
    error = sum(abs(hit[bins == b].mean() - top[bins == b].mean()) * (bins == b).mean() for b in range(5) if (bins == b).any())
    assert error < 0.12 and hit.mean() > 0.6


def test_overlapped_calls(spark):
    def fails():
        raise ValueError("no")

    got = overlapped(spark, [lambda: spark.range(10).count(), fails, lambda: spark.range(20).count()], 2)
    assert got[0] == 10 and isinstance(got[1], ValueError) and got[2] == 20


def test_cancelled_call_ends_its_jobs(spark):
    @F.udf("long")
    def slow(v):
        time.sleep(60)
        return v

    start = time.time()
    with Overlapped(spark, [lambda: spark.range(0, 4, 1, 2).select(slow("id")).collect(), lambda: 5], 2) as running:
        running.start(0)
        assert running.result(1) == 5
        group = running.groups[0]
        while not spark.sparkContext.statusTracker().getJobIdsForGroup(group):
            time.sleep(0.05)
    assert time.time() - start < 30
    tracker = spark.sparkContext.statusTracker()
    assert not set(tracker.getJobIdsForGroup(group)) & set(tracker.getActiveJobsIds())


def test_speculative_sweep_has_the_same_steps(spark):
    df = spark.range(600).select("id", F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("y"))
    grid = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7]
    scores = {}

    def scorer(x):  # rises, then falls: leaves after two declines
        n = x.where("y = 'a'").count()
        return {"m": scores.setdefault(n, 0.9 - abs(n - 250) / 1000)}

    def run(speculate):
        steps, _ = sw.run_sweep(df, "y", "target", scorer, ["id"], grid, speculate=speculate)
        return sorted(map(tuple, steps.collect()))

    plain = run(1)
    assert len(plain) < len(grid) and run(3) == plain


def test_multi_sweep_keeps_failures(spark):
    df = spark.range(100).select("id", (F.col("id") % 2).cast("string").alias("y"), F.col("id").cast("double").alias("v"))
    seen = []

    def scorer(x):
        seen.append(1)
        if len(seen) == 3:
            raise ValueError("third")
        return {"m": 0.5}

    failures = []
    steps, _ = sw.run_multi(df, [("y", "target"), ("v", "continuous")], scorer, ["id"], grid=[0.0, 0.3], failures=failures)
    assert [(f[0], f[1]) for f in failures] == [("y", 1)] and steps.groupBy("run_id").count().count() == 2
    assert sw.failure_table(spark, failures).first()["error"] == "ValueError: third"


def test_failing_cv_keeps_the_algorithm(spark, monkeypatch):
    def broken(*_, **__):
        raise ValueError("no folds")

    monkeypatch.setattr(md, "cross_validate", broken)
    df = spark.range(200).select("id", (F.col("id") % 3).cast("string").alias("y"), (F.col("id") % 6).alias("v"))
    algos = md.value_majority("by_v", F.col("v")) | {"bad": md.Algo("bad", lambda *_: 1 / 0)}
    got = md.run_loop(df, "y", None, ["id"], algos, cv_folds=3)
    values = {r.metric: r.value for r in got.metrics.collect()}
    assert values["f1_macro"] == 1.0 and values["cv_mean"] == 0.0 and set(got.failed) == {"by_v: CV", "bad"}
    assert got.confusion.count() == 9 and got.per_class.count() == 3


@pytest.mark.parametrize("most", [30, 10_000])
def test_only_the_fit_is_bounded(spark, most):
    """A bound on the training rows leaves every test row in the scores."""
    df = spark.range(500).select("id", (F.col("id") % 2).cast("string").alias("y"), (F.col("id") % 4).alias("v"))
    got = md.run_loop(df, "y", None, ["id"], md.value_majority("m", F.col("v")), cv_folds=0, max_train=most)
    assert got.confusion.agg(F.sum("n")).first()[0] == 100


def test_curve_fits_run_side_by_side_and_score_once(spark, monkeypatch):
    """A fit's training and validation rows are scored in one pass; the registered curve overlaps its fits."""
    from shiftlab.plans import q_models

    calls, counted = [], md._counted
    monkeypatch.setattr(md, "_counted", lambda *a, **k: calls.append(1) or counted(*a, **k))
    df = spark.range(300).select("id", (F.col("id") % 2).cast("string").alias("y"), (F.col("id") % 4).alias("v"))
    got = md.run_loop(df, "y", None, ["id"], md.value_majority("m", F.col("v")), cv_folds=0, learning_curves=True, parallel=4)
    rows = got.curve.collect()
    assert not got.failed and len(calls) == 8 * 3 and len(rows) == 8 * 3 * 2
    assert {r.split for r in rows} == {"train", "val"} and all(r.f1 == 1.0 for r in rows if r.train_size > 100)
    used = []
    monkeypatch.setattr(q_models, "_loop", lambda *_, **kw: used.append(kw["parallel"]) or got)
    q_models.m09(spark, "")
    assert used == [md.FITS_AT_ONCE]


def test_svm_steps_run_few_tasks(spark, monkeypatch):
    """The fits of the classes fill the cores: a step of one has as many tasks as the rows need, not one a core."""
    x, y = blobs(120)
    df = frame(spark, x, y).repartition(6).cache()
    seen, plain = [], md.RFFSVM._fit
    monkeypatch.setattr(md.RFFSVM, "_fit", lambda self, rows, label: seen.append(rows.rdd.getNumPartitions()) or plain(self, rows, label))
    svm = md.RFFSVM(max_iter=3, n_components=8, probability=False)
    (out,) = svm.fit_predict(df, [df], "features", "y", 3)
    assert out.count() == 120 and seen == [1]
    monkeypatch.setattr(md, "FIT_ROWS", 50)
    svm.fit_predict(df, [df], "features", "y", 3)
    assert seen == [1, 3]


def broken_query(spark, monkeypatch, query, broken):
    """A registered query over 60 rows of three classes, its algorithms stood in for by value-majority models, of which some cannot be fitted."""
    from shiftlab.plans import q_models

    df = frame(spark, *blobs(60)).selectExpr("id as vec_id", "cast(int(y) as string) as label", "features")
    monkeypatch.setattr(q_models, "embeddings", lambda *_: df)
    algos = {n: md.Algo(n, lambda *_: 1 / 0) if n in broken else md.value_majority(n, F.col("vec_id") % 4)[n] for n in q_models.ALL}
    monkeypatch.setattr(md, "default_algorithms", lambda **_: algos)
    return getattr(q_models, query)(spark, "")


def test_boosted_trees_that_fail_are_an_error(spark, monkeypatch):
    with pytest.raises(RuntimeError, match="^Boosted Trees: ZeroDivisionError: division by zero$"):
        broken_query(spark, monkeypatch, "m02", ["Boosted Trees"])
    assert broken_query(spark, monkeypatch, "m02", []).count() == 11


@pytest.mark.parametrize("part", ["", ": AUC"])
def test_an_svm_or_its_auc_that_fails_is_an_error(spark, monkeypatch, part):
    if part:
        monkeypatch.setattr(md.mt, "macro_auc", lambda *_: 1 / 0)
    with pytest.raises(RuntimeError, match=f"^SVM{part}: ZeroDivisionError: division by zero$"):
        broken_query(spark, monkeypatch, "m05", [] if part else ["SVM"])


def test_a_quick_loop_does_not_score_a_failure(spark, monkeypatch):
    with pytest.raises(RuntimeError, match="^MLP: ZeroDivisionError: division by zero; SVM: ZeroDivisionError: division by zero$"):
        broken_query(spark, monkeypatch, "m07_all", ["MLP", "SVM"])
    assert broken_query(spark, monkeypatch, "m07_all", []).where("f1_macro > 0").count() == 4
