"""Classifiers and the train/evaluate loop.

MLlib estimators stand in for the single-machine ones:

* boosted trees -> ``boosting.SoftmaxBoost`` (MLlib GBT is binary only);
* neural net    -> ``MultilayerPerceptronClassifier`` (128, 64 hidden), trained in
  warm-started slices until a watch set no longer improves;
* random forest -> ``RandomForestClassifier`` (100 trees, depth 10);
* RBF SVM       -> random Fourier features + ``OneVsRest(LinearSVC)``
  (Rahimi & Recht 2007; MLlib has no kernel SVM), with probabilities calibrated
  on out-of-fold margins;
* ``ValueMajority`` -> the most frequent label per value of one column, a
  pure DataFrame model whose predictions are exact SQL (used as the oracle
  scorer of sweeps).

Every result is a DataFrame: metrics ``(algorithm, metric, value)``, confusion
``(algorithm, y_true, y_pred, n)``, per-class, CV folds and learning curves.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    LinearSVC,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftlab.functions.hashing import DEFAULT_SEED
from shiftlab.operators import calibrate as ca
from shiftlab.operators import metrics as mt
from shiftlab.operators import split as sp
from shiftlab.operators.boosting import SoftmaxBoost
from shiftlab.operators.overlap import overlapped
from shiftlab.session import ensure_checkpoint_dir, ship_package

#: Rows of a partition of a training table, at least a partition a core (but for SVMs): iterative fits run a task a partition and step.
FIT_ROWS = 100_000
#: One-vs-rest models that are fitted side by side.
FITS_AT_ONCE = 8
LABEL_IDX, PRED_IDX = "_label_idx", "prediction"


# --- M01: label encoding ----------------------------------------------------

def label_indexer(df: DataFrame, label: str):
    """Alphabetical class ids over the classes present; returns (model, classes)."""
    m = StringIndexer(inputCol=label, outputCol=LABEL_IDX, stringOrderType="alphabetAsc",
                      handleInvalid="skip").fit(df)
    return m, list(m.labels)


def decode(df: DataFrame, classes: Sequence[str], col: str = PRED_IDX, out: str = "y_pred") -> DataFrame:
    return IndexToString(inputCol=col, outputCol=out, labels=list(classes)).transform(df)


# --- random Fourier features for the RBF kernel -----------------------------

class RandomFourierFeatures:
    """``z(x) = sqrt(2/D) cos(W x + b)`` with ``W ~ N(0, 2 gamma)``, ``b ~ U(0, 2 pi)``.

    ``gamma='scale'`` is ``1 / (n_features * var(X))`` like the kernel SVM
    default.  The projection is a dense matmul per Arrow batch.
    """

    def __init__(self, n_components: int = 256, gamma: float | str = "scale", seed: int = DEFAULT_SEED):
        self.n_components, self.gamma, self.seed = n_components, gamma, seed

    def fit(self, df: DataFrame, features: str) -> "RandomFourierFeatures":
        arr = vector_to_array(features)
        first = df.select(F.size(arr).alias("d")).first()
        d = int(first["d"]) if first else 0
        if self.gamma == "scale":
            # var over all entries of X = E[x^2] - E[x]^2, one aggregate pass.
            r = df.select(F.explode(arr).alias("v")).agg(F.avg("v"), F.avg(F.col("v") * F.col("v"))).first()
            var = float(r[1] or 0.0) - float(r[0] or 0.0) ** 2
            gamma = 1.0 / (d * var) if d and var > 0 else 1.0
        else:
            gamma = float(self.gamma)
        rng = np.random.default_rng(self.seed)
        self.w = rng.normal(0.0, math.sqrt(2.0 * gamma), size=(d, self.n_components))
        self.b = rng.uniform(0.0, 2.0 * math.pi, size=self.n_components)
        return self

    def transform(self, df: DataFrame, features: str, out: str) -> DataFrame:
        ship_package(df.sparkSession)
        w, b, scale = self.w, self.b, math.sqrt(2.0 / self.n_components)

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def rff(col: pd.Series) -> pd.Series:
            x = np.stack(col.to_numpy()) if len(col) else np.zeros((0, w.shape[0]))
            z = scale * np.cos(x @ w + b)
            return pd.Series(list(z))

        return df.withColumn(out, array_to_vector(rff(vector_to_array(features))))


class RFFSVM:
    """Kernel-approximating SVM: RFF transform then one-vs-rest linear SVM.

    With ``probability`` the margins of ``folds`` models, each on the rows that it did not
    see, calibrate pairwise sigmoids; rows fall into folds by a hash of their features, so
    copies of a row stay together.
    """

    def __init__(self, max_iter: int = 100, reg: float = 0.0, n_components: int = 256,
                 seed: int = DEFAULT_SEED, probability: bool = True, folds: int = 3):
        self.max_iter, self.reg, self.n_components, self.seed = max_iter, reg, n_components, seed
        self.probability, self.folds = probability, folds

    def _fit(self, rows: DataFrame, label: str):
        return OneVsRest(classifier=LinearSVC(maxIter=self.max_iter, regParam=self.reg), featuresCol="_rff", labelCol=label,
                         parallelism=FITS_AT_ONCE).fit(rows)

    def _out_of_fold(self, rows: DataFrame, features: str, label: str, classes: int) -> DataFrame:
        """(label, raw): every row's margins by the model of the other folds; a class that they lack gets none of its margin."""
        fold = F.pmod(F.xxhash64(vector_to_array(features), F.lit(self.seed)), F.lit(self.folds))
        rows = rows.withColumn("_fold", fold)
        out = None
        for f in range(self.folds):
            model = self._fit(rows.where(F.col("_fold") != f), label)
            raw = vector_to_array("rawPrediction")
            got = model.transform(rows.where(F.col("_fold") == f)).select(
                label, *[F.get(raw, F.lit(c)).alias(f"_m{c}") for c in range(classes)])
            got = got.select(label, F.array(*[F.coalesce(f"_m{c}", F.lit(-1.0)) for c in range(classes)]).alias("raw"))
            out = got if out is None else out.unionByName(got)
        return out

    def fit_predict(self, train, others, features, label, classes=None):
        rff = RandomFourierFeatures(self.n_components, seed=self.seed).fit(train, features)
        # The fits of the classes fill the cores side by side: a task a core in each of their hundreds of steps
        # would only send the driver as many more results.
        tr = rff.transform(train.coalesce(train.count() // FIT_ROWS + 1), features, "_rff").persist()
        model = self._fit(tr, label)
        out = [model.transform(rff.transform(o, features, "_rff")).drop("_rff") for o in others]
        if self.probability:
            k = classes or len(model.models)
            sigmoids = ca.fit_sigmoids(self._out_of_fold(tr, features, label, k), label, "raw", k)
            out = [ca.with_probability(o, sigmoids) for o in out]
        tr.unpersist()
        return out


# --- M03: the neural net with early stopping ----------------------------------

class EarlyStoppedNet:
    """``MultilayerPerceptronClassifier`` in warm-started slices of ``slice_iter`` iterations.

    A stratified share ``watch`` of the training rows is kept out; after each slice the
    net is scored on it, and training ends when ``patience`` slices in a row bring no more
    than ``tolerance``, or at ``max_iter``.  The weights of the best slice are kept.  With
    too few rows for a watch set, or ``watch=0``, the net trains through.  ``history`` has the scores.
    """

    def __init__(self, hidden: Sequence[int] = (128, 64), max_iter: int = 300, slice_iter: int = 10, patience: int = 10,
                 watch: float = 0.1, tolerance: float = 1e-4, seed: int = DEFAULT_SEED, n_features: int | None = None):
        self.n_features = n_features
        self.hidden, self.max_iter, self.slice_iter, self.patience = list(hidden), max_iter, slice_iter, patience
        self.watch, self.tolerance, self.seed = watch, tolerance, seed
        self.history: list[float] = []

    def fit(self, train: DataFrame, features: str, label: str, n_features: int, classes: int) -> Model:
        if self.watch <= 0:
            return MultilayerPerceptronClassifier(layers=[n_features, *self.hidden, classes], maxIter=self.max_iter, seed=self.seed,
                                                  featuresCol=features, labelCol=label).fit(train)
        row = train.withColumn("_row", F.xxhash64(vector_to_array(features)))
        cut = sp.train_test_split(row, label, ["_row"], self.watch, self.seed, split_col="_watch").persist()
        fit_rows, held = cut.where(F.col("_watch") == "train"), cut.where(F.col("_watch") == "test")
        sizes = {r["_watch"]: r["count"] for r in cut.groupBy("_watch").count().collect()}
        watched = len(sizes) == 2
        fit_rows = _fit_partitions(fit_rows if watched else cut, sum(sizes.values()))
        held = _fit_partitions(held, sizes.get("test", 0))
        self.history, best, best_model, weights, waited, done = [], -1.0, None, None, 0, 0
        while done < self.max_iter:
            step = min(self.slice_iter if watched else self.max_iter, self.max_iter - done)
            net = MultilayerPerceptronClassifier(layers=[n_features, *self.hidden, classes], maxIter=step, seed=self.seed,
                                                 featuresCol=features, labelCol=label)
            if weights is not None:
                net.setInitialWeights(weights)
            model = net.fit(fit_rows)
            weights, done = model.weights, done + step
            if not watched:
                best_model = model
                break
            hit = (F.col(PRED_IDX) == F.col(label)).cast("double")
            score = float(model.transform(held).agg(F.avg(hit)).first()[0])
            self.history.append(score)
            if score > best + self.tolerance:
                best, best_model, waited = score, model, 0
            else:
                waited += 1
                if waited >= self.patience:
                    break
        cut.unpersist()
        return best_model

    def fit_predict(self, train, others, features, label, classes=None):
        d = self.n_features or n_features_of(train, features)
        model = self.fit(train, features, label, d, classes)
        return [model.transform(o) for o in others]


def _fit_partitions(df: DataFrame, rows: int) -> DataFrame:
    """A (cached) training table of so many rows without the many near-empty partitions that splits leave."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, rows // FIT_ROWS + 1))


# --- M02-M05: algorithm factory ---------------------------------------------

@dataclass
class Algo:
    """``make(features, label, n_features, n_classes)`` returns an Estimator, or
    an object with ``fit_predict(train, [frames], features, label, n_classes)``."""

    name: str
    make: Callable


def default_algorithms(gbt_rounds: int = 100, mlp_iter: int = 300, rf_trees: int = 100,
                       svm_iter: int = 5000, seed: int = DEFAULT_SEED, rf_depth: int = 10,
                       gbt_depth: int = 6, mlp_watch: float = 0.1, svm_probability: bool = True) -> dict[str, Algo]:
    """The reference's four models with its hyper-parameters; ``mlp_watch=0`` trains the net through."""
    return {
        "Boosted Trees": Algo("Boosted Trees", lambda f, l, d, k: SoftmaxBoost(rounds=gbt_rounds, depth=gbt_depth)),
        "MLP": Algo("MLP", lambda f, l, d, k: EarlyStoppedNet(max_iter=mlp_iter, seed=seed, n_features=d, watch=mlp_watch)),
        "Random Forest": Algo("Random Forest", lambda f, l, d, k: RandomForestClassifier(
            numTrees=rf_trees, maxDepth=rf_depth, seed=seed, featuresCol=f, labelCol=l)),
        "SVM": Algo("SVM", lambda f, l, d, k: RFFSVM(max_iter=svm_iter, seed=seed, probability=svm_probability)),
    }


ALIASES = {"XGBoost": "Boosted Trees"}


def select_algorithms(algos: dict[str, Algo], selected: Sequence[str] | None) -> dict[str, Algo]:
    if not selected:
        return algos
    want = {ALIASES.get(s, s) for s in selected}
    return {k: v for k, v in algos.items() if k in want}


def fit_predict(algo: Algo, train: DataFrame, frames: list[DataFrame], features: str, label: str,
                n_features: int, n_classes: int) -> tuple[list[DataFrame], Model | None]:
    est = algo.make(features, label, n_features, n_classes)
    if isinstance(est, Estimator):
        model = est.fit(train)
        return [model.transform(f) for f in frames], model
    return est.fit_predict(train, frames, features, label, n_classes), None


def n_features_of(df: DataFrame, features: str | None) -> int:
    if features is None:
        return 0
    r = df.select(F.size(vector_to_array(features)).alias("d")).first()
    return int(r["d"]) if r else 0


# --- ValueMajority: exact, SQL-expressible model ----------------------------

class ValueMajority:
    """Predict the most frequent training label among rows with the same value
    of ``column`` (ties: smallest label); unseen values use the class prior.
    ``score`` is the array of class shares in class order."""

    def __init__(self, column: str, label: str, classes: Sequence[str]):
        self.column, self.label, self.classes = column, label, [str(c) for c in classes]

    def fit(self, train: DataFrame, class_counts: dict | None = None) -> "ValueMajority":
        """``class_counts`` (training rows per class), when already known, saves
        the job that computes the prior."""
        c, lab, cls = self.column, self.label, self.classes
        cnt = train.groupBy(c, F.col(lab).cast("string").alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
        wide = cnt.groupBy(c).pivot("_l", cls).agg(F.sum("_n"))
        tot = sum((F.coalesce(F.col(f"`{k}`"), F.lit(0)) for k in cls), F.lit(0))
        self.table = wide.select(c, F.array(*[F.coalesce(F.col(f"`{k}`"), F.lit(0)) / tot for k in cls])
                                 .alias("_vs"))
        if class_counts is None:
            prior = train.groupBy(F.col(lab).cast("string").alias("_l")).agg(F.count(F.lit(1)).alias("_n")).collect()
            counts = {r["_l"]: r["_n"] for r in prior}
        else:
            counts = {str(k): int(v) for k, v in class_counts.items() if k is not None}
        n = sum(counts.values())
        self.prior = [counts.get(k, 0) / n if n else 0.0 for k in cls]
        return self

    def transform(self, df: DataFrame, score: str = "score", pred: str = "y_pred") -> DataFrame:
        prior = F.array(*[F.lit(float(p)) for p in self.prior])
        j = df.join(self.table, self.column, "left")
        j = j.withColumn(score, F.coalesce(F.col("_vs"), prior)).drop("_vs")
        arr = F.array(*[F.lit(k) for k in self.classes])
        return j.withColumn(pred, F.element_at(arr, F.array_position(F.col(score), F.array_max(F.col(score)))
                                               .cast("int")))


class ValueMajorityAlgorithm:
    """:class:`ValueMajority` by the value of ``of`` (a column), as an algorithm of the loop."""

    def __init__(self, of: Column):
        self.of = of

    def fit_predict(self, train, others, features, label, classes=None):
        names = [str(float(c)) for c in range(classes)]
        keyed = train.withColumn("_value", self.of).withColumn("_class", F.col(label).cast("string"))
        model = ValueMajority("_value", "_class", names).fit(keyed)
        return [model.transform(o.withColumn("_value", self.of), "_score", "_pred")
                .withColumn("probability", array_to_vector("_score")).withColumn(PRED_IDX, F.col("_pred").cast("double"))
                .drop("_value", "_score", "_pred") for o in others]


def value_majority(name: str, of: Column) -> dict[str, Algo]:
    return {name: Algo(name, lambda f, l, d, k: ValueMajorityAlgorithm(of))}


# --- M06-M10: the training loop ---------------------------------------------

@dataclass
class LoopResult:
    metrics: DataFrame      # algorithm, metric, value
    confusion: DataFrame    # algorithm, y_true, y_pred, n
    per_class: DataFrame    # algorithm, class, precision, recall, f1, specificity, support
    cv: DataFrame | None    # algorithm, fold, f1
    curve: DataFrame | None  # algorithm, train_size, fold, split, f1
    failed: dict


def _scored(pred: DataFrame, classes: list[str]) -> DataFrame:
    return decode(pred, classes)


def _f1_value(pred: DataFrame, truth: str, classes) -> float:
    r = mt.macro_f1(pred, truth, "y_pred", classes).first()
    return float(r["f1_macro"]) if r and r["f1_macro"] is not None else 0.0


def _score_array(pred: DataFrame) -> str | None:
    if "probability" in pred.columns:
        return "probability"
    if "rawPrediction" in pred.columns:
        return "rawPrediction"
    return None


def run_loop(df: DataFrame, label: str, features: str | None, key: Sequence[str],
             algorithms: dict[str, Algo] | None = None, selected: Sequence[str] | None = None,
             test_size: float = 0.2, seed: int = DEFAULT_SEED, cv_folds: int = 5,
             learning_curves: bool = False, quick: bool = False, max_train: int | None = None,
             parallel: int = 1, resample: Callable[[DataFrame], DataFrame] | None = None, strict: bool = False) -> LoopResult:
    """M06 (and M07 with ``quick``): stratified split, fit each algorithm, score
    test and train, optional stratified CV (M08) and learning curves (M09).

    ``resample`` changes the training part only, after the split, so that no copy of a test row
    is trained on.  ``max_train`` bounds the rows that are fitted on (a stratified sample of the training
    part, after the split); every test row is scored.  Up to ``parallel`` algorithms, and
    fits of a CV or curve, run side by side.

    Failures stay where they happen: an algorithm that cannot be fitted is in ``failed`` and
    has no metrics (quick mode scores it 0.0, as the quick loop does); a CV, curve or AUC
    that fails is in ``failed`` as ``<algorithm>: <part>``, scores 0 or null, and the
    algorithm's other results stay.  With ``strict``, for callers that do not look at ``failed``,
    any failure is an error once the other parts have ended.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    algos = select_algorithms(default_algorithms(seed=seed) if algorithms is None else algorithms, selected)
    indexer, classes = label_indexer(df, label)
    data = indexer.transform(df)
    data, info = sp.train_test_split_info(data, label, key, test_size, seed)
    data = data.cache()
    train = data.where(F.col("split") == "train")
    test = data.where(F.col("split") == "test")
    if info:  # the number of rows is known
        rows = sum(info["train_counts"].values())
        train, test = _fit_partitions(train, rows), _fit_partitions(test, rows)
    if resample is not None:
        train = resample(train)
    if max_train is not None:
        train = sp.stratified_subsample(train, label, max_train, key, seed)
    if resample is not None or max_train is not None:
        train = train.cache()
    d, k = n_features_of(data, features), len(classes)
    failed: dict[str, str] = {}
    errors: list[Exception] = []

    def attempt(name: str, call: Callable, otherwise=None):
        try:
            return call()
        except Exception as e:  # noqa: BLE001 - noted; the other parts go on
            failed[name] = f"{type(e).__name__}: {e}"
            errors.append(e)
            return otherwise

    def one(name: str, algo: Algo) -> dict:
        t0 = time.time()
        (p_test, p_train), _ = fit_predict(algo, train, [test, train], features, LABEL_IDX, d, k)
        elapsed = time.time() - t0
        p_test = _scored(p_test, classes).cache()
        cm = mt.confusion(p_test, label, "y_pred", classes)
        cm = cm if quick else cm.checkpoint()
        pc = mt.per_class(cm)
        summ = mt.summary(pc).first().asDict()
        out = {"row": {"f1_macro": summ["f1_macro"]}, "confusion": cm, "per_class": pc}
        if not quick:
            row = dict(summ, roc_auc=None, train_f1=_f1_value(_scored(p_train, classes), label, classes),
                       val_f1=summ["f1_macro"], train_time=elapsed, cv_mean=0.0, cv_std=0.0)
            sc = _score_array(p_test)
            if sc is not None and k > 2:
                long = mt.scores_long(p_test.withColumn("_s", vector_to_array(sc)), label, "_s", classes)
                row["roc_auc"] = attempt(f"{name}: AUC", lambda: mt.macro_auc(long, k).first()["roc_auc"])
            if cv_folds and cv_folds > 1:
                out["cv"] = attempt(f"{name}: CV", lambda: cross_validate(
                    algo, train, label, features, key, classes, cv_folds, seed, d, k, parallel))
                vals = sorted(r["f1"] for r in out["cv"].collect()) if out["cv"] is not None else []
                if vals:
                    row["cv_mean"], row["cv_std"] = float(np.mean(vals)), float(np.std(vals))
            if learning_curves:
                out["curve"] = attempt(f"{name}: learning curve", lambda: learning_curve(
                    algo, train, label, features, key, classes, seed, d, k, parallel=parallel))
            out["row"] = row
        p_test.unpersist()
        return out

    results = overlapped(spark, [lambda n=n, a=a: one(n, a) for n, a in algos.items()], parallel)
    metric_rows, frames = [], {"confusion": [], "per_class": [], "cv": [], "curve": []}
    for name, got in zip(algos, results, strict=True):
        if isinstance(got, Exception):
            failed[name] = f"{type(got).__name__}: {got}"
            errors.append(got)
            if quick:
                metric_rows.append((name, "f1_macro", 0.0))
            continue
        metric_rows += [(name, m, None if v is None else float(v)) for m, v in got["row"].items()]
        for part, found in frames.items():
            if got.get(part) is not None:
                found.append(got[part].withColumn("algorithm", F.lit(name)))
    if resample is not None or max_train is not None:
        train.unpersist()
    data.unpersist()
    if strict and failed:
        raise RuntimeError("; ".join(f"{part}: {error}" for part, error in failed.items())) from errors[0]
    metrics = spark.createDataFrame(metric_rows, "algorithm string, metric string, value double")

    def union(found: list[DataFrame]) -> DataFrame | None:
        out = None
        for f in found:
            out = f if out is None else out.unionByName(f)
        return out

    return LoopResult(metrics, *(union(frames[x]) for x in ("confusion", "per_class", "cv", "curve")), failed)


def quick_scores(df: DataFrame, label: str, features: str, key: Sequence[str],
                 algorithms: dict[str, Algo] | None = None, selected: Sequence[str] | None = None,
                 test_size: float = 0.2, seed: int = DEFAULT_SEED, max_train: int | None = None, parallel: int = 1,
                 resample: Callable[[DataFrame], DataFrame] | None = None, strict: bool = True) -> DataFrame:
    """``(algorithm, f1_macro)`` only; a failing algorithm is an error, without ``strict`` it scores 0.0."""
    res = run_loop(df, label, features, key, algorithms, selected, test_size, seed, cv_folds=0, quick=True,
                   max_train=max_train, parallel=parallel, resample=resample, strict=strict)
    return res.metrics.select("algorithm", F.col("value").alias("f1_macro"))


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _counted(preds: DataFrame, tags: dict, by: Sequence[str] = ()) -> DataFrame:
    """A fit's predictions as (tags, ``by``, truth, prediction, n), written at once, so that the model and its plan can go."""
    counts = preds.groupBy(*by, LABEL_IDX, PRED_IDX).agg(F.count(F.lit(1)).alias("n")).coalesce(1)
    return counts.select(*(F.lit(v).alias(t) for t, v in tags.items()), *by, LABEL_IDX, PRED_IDX, "n").checkpoint()


def _all(results: list) -> list:
    """The results of overlapped fits; the first failure is raised."""
    for r in results:
        if isinstance(r, Exception):
            raise r
    return results


def cross_validate(algo: Algo, train: DataFrame, label: str, features: str | None, key: Sequence[str],
                   classes: list[str], folds: int, seed: int, d: int, k: int, parallel: int = 1) -> DataFrame:
    """Stratified k folds over the training split; macro F1 per fold.

    Up to ``parallel`` fits (each a chain of jobs) run side by side; all fold scores come
    from one grouped aggregation over the fits' counts of (truth, prediction)."""
    spark = train.sparkSession
    folded, kk = sp.stratified_folds(train, label, key, folds, seed)
    if kk < 2:
        return spark.createDataFrame([], "fold int, f1 double")
    folded = folded.cache()

    def one(f: int) -> DataFrame:
        tr, va = folded.where(F.col("fold") != f), folded.where(F.col("fold") == f)
        (pv,), _ = fit_predict(algo, tr, [va], features, LABEL_IDX, d, k)
        return _counted(pv, {"fold": f})

    ensure_checkpoint_dir(spark)
    counts = _union(_all(overlapped(spark, [lambda f=f: one(f) for f in range(kk)], parallel)))
    out = mt.grouped_macro_f1(counts, ["fold"], LABEL_IDX, PRED_IDX, n="n").checkpoint()
    folded.unpersist()
    return out.select(F.col("fold").cast("int").alias("fold"), "f1")


def learning_curve(algo: Algo, train: DataFrame, label: str, features: str | None, key: Sequence[str],
                   classes: list[str], seed: int, d: int, k: int, max_folds: int = 3, parallel: int = 1) -> DataFrame:
    """train/validation macro F1 per (training size, fold) on nested
    prefixes.  Up to ``parallel`` fits run side by side, each scores its two parts in one
    pass; one grouped aggregation scores every fit."""
    spark = train.sparkSession
    folded, kk = sp.stratified_folds(train, label, key, max_folds, seed)
    if kk < 2:
        return spark.createDataFrame([], "train_size int, fold int, split string, f1 double")
    folded = folded.cache()
    pos = sp.fold_train_positions(folded, "fold", kk, key, seed).cache()
    n_max = pos.where(F.col("cv_fold") == 0).count()

    def one(size: int, f: int) -> DataFrame:
        tr = pos.where((F.col("cv_fold") == f) & (F.col("pos") < size)).drop("cv_fold", "pos")
        va = folded.where(F.col("fold") == f)
        both = _union([x.withColumn("split", F.lit(split)) for split, x in (("train", tr), ("val", va))])
        (scored,), _ = fit_predict(algo, tr, [both], features, LABEL_IDX, d, k)
        return _counted(scored, {"train_size": size, "fold": f}, ["split"])

    ensure_checkpoint_dir(spark)
    fits = [(size, f) for size in sp.learning_curve_sizes(n_max) for f in range(kk)]
    counts = _union(_all(overlapped(spark, [lambda x=x: one(*x) for x in fits], parallel)))
    out = mt.grouped_macro_f1(counts, ["train_size", "fold", "split"], LABEL_IDX, PRED_IDX, n="n").checkpoint()
    pos.unpersist()
    folded.unpersist()
    return out.select(F.col("train_size").cast("int").alias("train_size"), F.col("fold").cast("int").alias("fold"),
                      "split", "f1")


def train_val_gap(metrics: DataFrame) -> DataFrame:
    """Per algorithm train F1, validation F1 and their gap."""
    w = metrics.groupBy("algorithm").pivot("metric", ["train_f1", "val_f1", "cv_mean", "cv_std"]).agg(
        F.first("value"))
    return w.withColumn("gap", F.col("train_f1") - F.col("val_f1"))

