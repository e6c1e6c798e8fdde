"""Distribution search and fit diagnosis.

The sweep itself (O02) is a driver loop because early exit makes each step
depend on the ones before; every step is one chain of Spark jobs over the
(cached) base table.  Everything computed *from* sweeps is a DataFrame
function over a long step table ``(run_id, step, slider, algorithm, score)``,
windowed by ``run_id``, so it works equally on one run or on a history of
thousands of runs.
"""

from __future__ import annotations

import copy
import dataclasses
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftlab.operators import features as fe
from shiftlab.operators import metrics as mt
from shiftlab.operators import models as md
from shiftlab.operators import rebalance as rb
from shiftlab.operators import smote as sm
from shiftlab.operators import split as sp
from shiftlab.operators.overlap import Overlapped
from shiftlab.session import ensure_checkpoint_dir

# Fixed values of the search and the diagnosis rules.
DEFAULT_THRESHOLD = 0.001
PEAK_DECLINES = 2
PLATEAU_DECLINES = 3
WIDENING_MARGIN = 0.01
OVERFIT_TRAIN, OVERFIT_GAP = 0.95, 0.05
UNDERFIT_LEVEL = 0.7
OPTIMAL_GAP, OPTIMAL_VAL = 0.03, 0.7
SLIGHT_GAP = 0.03

STEP_SCHEMA = "run_id string, step int, slider double, algorithm string, score double, n_samples long"


def slider_grid(lo: float = -1.0, hi: float = 1.0, step: float = 0.05) -> list[float]:
    """``lo..hi`` inclusive by ``step``, rounded to 3 decimals."""
    return [float(v) for v in np.round(np.arange(lo, hi + step / 2, step), 3)]


# --- O03 / O04: bookkeeping and the exit rule over a step table ---------------

def step_summary(steps: DataFrame) -> DataFrame:
    """Per step: mean score over algorithms, best algorithm (ties: name) and its score."""
    return steps.groupBy("run_id", "step", "slider").agg(
        F.avg("score").alias("avg_score"),
        F.min_by("algorithm", F.struct(-F.col("score"), F.col("algorithm"))).alias("best_algo"),
        F.max("score").alias("best_score"),
        F.max("n_samples").alias("n_samples"),
    )


def bookkeeping(summary: DataFrame) -> DataFrame:
    """Delta to the previous step, new-best flag (strict), steps since the last best."""
    w = Window.partitionBy("run_id").orderBy("step")
    prev_best = F.max("avg_score").over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = (summary
         .withColumn("delta", F.coalesce(F.col("avg_score") - F.lag("avg_score").over(w), F.lit(0.0)))
         .withColumn("is_best", F.col("avg_score") > F.coalesce(prev_best, F.lit(-1.0)))
         .withColumn("_grp", F.sum(F.col("is_best").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
         .withColumn("_i", F.row_number().over(w)))
    wg = Window.partitionBy("run_id", "_grp").orderBy("step")
    x = x.withColumn("declines", F.when(F.col("_grp") > 0, F.row_number().over(wg) - 1)
                     .otherwise(F.row_number().over(wg)))
    return x.drop("_grp")


def _exits(later, delta, size, declines, threshold: float):
    """(peak, plateau): the two conditions of the exit rule, of columns or of numbers; ``size`` is |delta|."""
    return (later & (delta < -threshold) & (declines >= PEAK_DECLINES),
            later & (size < threshold) & (declines >= PLATEAU_DECLINES))


def exit_rule(threshold: float = DEFAULT_THRESHOLD) -> Column:
    """O04 condition on a bookkept step (never on the first step of a run)."""
    peak, plateau = _exits(F.col("_i") > 1, F.col("delta"), F.abs(F.col("delta")), F.col("declines"), float(threshold))
    return F.when(peak, F.lit("peak_detected")).when(plateau, F.lit("plateau"))


def apply_exit(booked: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Keep steps up to the first exit; add ``exit_reason`` per run."""
    w = Window.partitionBy("run_id")
    x = booked.withColumn("_why", exit_rule(threshold))
    x = x.withColumn("_cut", F.min(F.when(F.col("_why").isNotNull(), F.col("step"))).over(w))
    x = x.withColumn("exit_reason", F.coalesce(
        F.first(F.when(F.col("step") == F.col("_cut"), F.col("_why")), ignorenulls=True).over(w),
        F.lit("complete")))
    return x.where(F.col("_cut").isNull() | (F.col("step") <= F.col("_cut"))).drop("_why", "_cut", "_i")


def trajectory(steps: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """O03 + O04 on a long step table."""
    return apply_exit(bookkeeping(step_summary(steps)), threshold)


def optimum(steps: DataFrame, baseline: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Per run the optimal slider (first strict best among kept steps), its
    best algorithm and F1, exit reason, and per-algorithm gain over baseline
    (0 when the baseline score is not positive).

    ``baseline`` has (run_id, algorithm, score).
    """
    traj = trajectory(steps, threshold)
    w = Window.partitionBy("run_id").orderBy(F.col("avg_score").desc(), F.col("step").asc())
    best = traj.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).select(
        "run_id", F.col("step").alias("opt_step"), F.col("slider").alias("optimal_value"),
        F.col("best_algo").alias("best_algorithm"), F.col("best_score").alias("best_f1"), "exit_reason")
    at = steps.join(best, "run_id").where(F.col("step") == F.col("opt_step"))
    b = baseline.select("run_id", "algorithm", F.col("score").alias("base"))
    gains = at.join(b, ["run_id", "algorithm"], "left").select(
        "run_id", "algorithm", F.when(F.col("base") > 0, F.col("score") - F.col("base")).otherwise(F.lit(0.0))
        .alias("gain"))
    g = gains.groupBy("run_id").agg(F.avg("gain").alias("mean_gain"),
                                    F.map_from_entries(F.collect_list(F.struct("algorithm", "gain")))
                                    .alias("gain_by_algorithm"))
    return best.join(g, "run_id", "left").drop("opt_step")


def trajectory_table(steps: DataFrame, algorithms: Sequence[str],
                     threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """One row per kept step with ``<algorithm>_f1`` columns."""
    traj = trajectory(steps, threshold)
    wide = steps.groupBy("run_id", "step").pivot("algorithm", list(algorithms)).agg(F.first("score"))
    for a in algorithms:
        wide = wide.withColumnRenamed(a, f"{a}_f1")
    return traj.select("run_id", "step", "slider", "n_samples", "delta", "best_algo", "best_score").join(
        wide, ["run_id", "step"])


# --- O02 / O06: the sweep loop -------------------------------------------------

Scorer = Callable[[DataFrame], dict]


def _row_key(df: DataFrame, key: Sequence[str]) -> list[str]:
    """What identifies a row of a step's table: SMOTE's key, or ``key`` with the number of the copy."""
    if sm.ROW_KEY in df.columns:
        return [sm.ROW_KEY]
    return [*key, rb.COPY] if rb.COPY in df.columns else list(key)


def _with_copies(prep: fe.FeaturePrep, df: DataFrame) -> fe.FeaturePrep:
    """The prep, keeping the number of the copy."""
    return dataclasses.replace(prep, keep=[*prep.keep, rb.COPY]) if rb.COPY in df.columns else prep


def value_majority_scorer(column: str, label: str, key: Sequence[str], test_size: float = 0.2,
                          seed: int = 42, of: Column | None = None) -> Scorer:
    """Exact scorer: stratified split, predict the majority label per ``column``
    value learnt on train, macro F1 on test.  One algorithm, ``by_<column>``.
    The score is rounded to 12 decimals in Spark, so that strict "new best"
    comparisons do not depend on the order of a floating-point sum.  ``of`` computes
    ``column`` where the scored tables do not have it.  ``resample`` changes the training part only."""
    def score(df: DataFrame, resample=None) -> dict:
        df = df if of is None else df.withColumn(column, of)
        s, info = sp.train_test_split_info(df, label, _row_key(df, key), test_size, seed)
        s = s.cache()
        classes = info["classes"] if info else mt.class_list(df, label)
        tr, te = s.where(F.col("split") == "train"), s.where(F.col("split") == "test")
        counts = info["train_counts"] if info and resample is None else None
        tr = tr if resample is None else resample(tr)
        p = md.ValueMajority(column, label, classes).fit(tr, counts).transform(te)
        r = mt.macro_f1(p, label, "y_pred", classes).select(F.round("f1_macro", 12).alias("f")).first()
        s.unpersist()
        return {f"by_{column}": float(r["f"] or 0.0)}
    return score


def mllib_scorer(prep: fe.FeaturePrep, key: Sequence[str], algorithms=None, selected=None,
                 max_samples: int = 10_000, seed: int = 42) -> Scorer:
    """M07 as a scorer: fit the feature prep on the step's table, split it, quick-train
    every algorithm on at most ``max_samples`` training rows (a stratified sample),
    and score every test row.  A table with a vector column ``prep.features_col``, as
    SMOTE in the encoded space leaves it, is taken as prepared."""
    def score(df: DataFrame, resample=None) -> dict:
        x = df if prep.features_col in df.columns else _with_copies(prep, df).fit(df).transform(df, assemble=True, wide=False)
        if isinstance(x.schema[prep.features_col].dataType, T.ArrayType):
            x = sm.as_vectors(x, prep.features_col)
        q = md.quick_scores(x, prep.label, prep.features_col, _row_key(x, key), algorithms, selected, seed=seed,
                            max_train=max_samples, resample=resample, strict=False)
        return {r["algorithm"]: float(r["f1_macro"]) for r in q.collect()}
    return score


def _encoded(df: DataFrame, column: str, key: Sequence[str], prep: fe.FeaturePrep | None, features: str | None,
             seed: int) -> sm.PreparedSmote:
    """SMOTE's base: the table encoded once by ``prep`` (which must keep ``key``), or its vector column ``features``."""
    if prep is not None:
        ensure_checkpoint_dir(df.sparkSession)
        df, features = prep.fit(df).transform(df, assemble=True, wide=False).checkpoint(), prep.features_col
    if features is None:
        raise ValueError("SMOTE needs a feature prep or a vector column")
    return sm.PreparedSmote(df, features, column, key, seed)


def run_sweep(df: DataFrame, column: str, kind: str, scorer: Scorer, key: Sequence[str],
              grid: Sequence[float] | None = None, threshold: float = DEFAULT_THRESHOLD,
              run_id: str | None = None, use_smote: bool = False, smote_features: str | None = None,
              prep: fe.FeaturePrep | None = None, seed: int = 42, failures: list | None = None,
              speculate: int = 1, resample_scope: str = "all"):
    """Baseline, then rebalance/score every slider until the exit rule fires.

    Returns ``(steps, baseline)`` DataFrames; feed them to :func:`optimum`.
    A failing step is skipped and noted in ``failures`` as (run_id, step, slider,
    error); when every step fails, the first error is raised.

    With ``use_smote`` (target columns) the table is encoded once, by ``prep`` or as it is in
    ``smote_features``, and every step resamples the encoded rows: SMOTE upwards, random
    under-sampling downwards.  The scorer then sees label, vector, ``row_key`` and ``synthetic``.

    With ``resample_scope="all"`` a step's table is resampled and then split, so copies of a row, told
    apart by ``rebalance.COPY``, fall on both sides, as in the reference.  With ``"train"`` the base is split
    and only its training part resampled (the scorer is called with ``resample``); the step's size
    is then that of the base.

    ``speculate`` steps run side by side; those after the exit are cancelled, so the step
    table is the same as one by one.
    """
    failures = [] if failures is None else failures
    noted = len(failures)
    spark = df.sparkSession
    grid = slider_grid() if grid is None else list(grid)
    run_id = run_id or f"{column}:{kind}"
    smoted = _encoded(df, column, key, prep, smote_features, seed) if kind == "target" and use_smote else None
    base = (df if smoted is None else smoted.at(0.0)).cache()
    base.count()
    baseline = scorer(base)
    # Slider-independent work (counts, median, majority, group sizes, neighbours) once per sweep.
    if resample_scope not in ("all", "train"):
        raise ValueError("resample_scope is 'all' or 'train'")
    ready = rb.prepare_rebalance(base, column, kind, key, seed) if smoted is None and resample_scope == "all" else None

    def step(s: float) -> tuple[dict, int]:
        if resample_scope == "train":
            n = base.count()
            if abs(s) < rb.IDENTITY_EPS:
                return scorer(base), n
            if smoted is not None:
                def again(tr: DataFrame) -> DataFrame:
                    return sm.smote(tr, smoted.features, column, s, [sm.ROW_KEY], seed).drop("synthetic")
            else:
                def again(tr: DataFrame) -> DataFrame:
                    return rb.rebalance(tr, column, kind, s, key, seed)
            return scorer(base, resample=again), n
        own = copy.copy(ready)  # its size is noted per step
        if abs(s) < rb.IDENTITY_EPS:
            mod = base
        elif smoted is not None:
            mod = smoted.at(s)
        else:
            if own is not None:
                own.last_size = None
            mod = rb.rebalance(base, column, kind, s, key, seed, prepared=own, copy_col=rb.COPY)
        if mod is not base:
            mod = mod.cache()
        try:
            scores = scorer(mod)
            known = own.last_size if own is not None and mod is not base else None
            return scores, int(known if known is not None else mod.count())
        finally:
            if mod is not base:
                mod.unpersist()

    rows, last, best, declines = [], None, -1.0, 0
    running = Overlapped(spark, [lambda s=s: step(s) for s in grid], speculate)
    try:
        for i, s in enumerate(grid):
            for ahead in range(i, i + speculate if speculate > 1 else i):
                running.start(ahead)
            try:
                scores, n = running.result(i) if speculate > 1 else step(s)
            except Exception as e:  # noqa: BLE001 - the other steps go on
                failures.append((run_id, i, float(s), e))
                continue
            avg = float(np.mean(list(scores.values()))) if scores else 0.0
            delta, later, last = (avg - last if last is not None else 0.0), last is not None, avg
            if avg > best:
                best, declines = avg, 0
            else:
                declines += 1
            rows += [(run_id, i, float(s), a, float(v), n) for a, v in scores.items()]
            if any(_exits(later, delta, abs(delta), declines, threshold)):
                break
    finally:
        running.close()
    if ready is not None:
        ready.release()
    base.unpersist()
    if grid and not rows and len(failures) > noted:
        raise RuntimeError(f"every step of sweep {run_id} failed") from failures[noted][3]
    steps = spark.createDataFrame(rows, STEP_SCHEMA)
    base_df = spark.createDataFrame([(run_id, a, float(v)) for a, v in baseline.items()],
                                    "run_id string, algorithm string, score double")
    return steps, base_df


def failure_table(spark, failures: list) -> DataFrame:
    """(run_id, step, slider, error) of noted failures."""
    return spark.createDataFrame([(r, int(i), float(s), f"{type(e).__name__}: {e}") for r, i, s, e in failures],
                                 "run_id string, step int, slider double, error string")


def run_multi(df: DataFrame, columns: Sequence[tuple[str, str]], scorer: Scorer, key: Sequence[str],
              grid=None, threshold: float = DEFAULT_THRESHOLD, failures: list | None = None, **options):
    """One sweep per (column, kind); steps and baselines unioned by run_id, failed steps in ``failures``.

    A column of which every step fails is left out, unless all columns are like that.
    """
    failures = [] if failures is None else failures
    steps, bases, error = None, None, None
    for col, kind in columns:
        try:
            s, b = run_sweep(df, col, kind, scorer, key, grid, threshold, run_id=col, failures=failures, **options)
        except RuntimeError as e:  # its steps are noted; the other columns go on
            error = e
            continue
        steps = s if steps is None else steps.unionByName(s)
        bases = b if bases is None else bases.unionByName(b)
    if steps is None and error is not None:
        raise error
    return steps, bases


# --- O08-O12: gaps, diagnosis, checklist ---------------------------------------

def gap_analysis(df: DataFrame, column: str, kind: str, prep: fe.FeaturePrep, key: Sequence[str],
                 sliders: Sequence[float], algorithms=None, selected=None, max_samples: int = 10_000,
                 seed: int = 42, failures: list | None = None, use_smote: bool = False, cv_folds: int = 3,
                 parallel: int = 1) -> DataFrame:
    """Train and validation macro F1 per (slider, algorithm), 3-fold CV.

    Models are fitted on at most ``max_samples`` training rows; every test row is scored.  With
    ``use_smote`` (target columns) the table is encoded once and resampled in the encoded space.
    Failing sliders are noted in ``failures`` as (slider, error); when all fail, the first error is
    raised.  Parts that fail inside a loop are noted as (slider, "part: error").
    """
    spark = df.sparkSession
    failures = [] if failures is None else failures
    smoted = _encoded(df, column, key, prep, None, seed) if kind == "target" and use_smote else None
    rows = []
    for s in sliders:
        try:
            if smoted is not None:
                x, by = sm.as_vectors(smoted.at(s), prep.features_col), [sm.ROW_KEY]
            else:
                mod = df if abs(s) < rb.IDENTITY_EPS else rb.rebalance(df, column, kind, s, key, seed, copy_col=rb.COPY)
                x = _with_copies(prep, mod).fit(mod).transform(mod, assemble=True, wide=False)
                by = _row_key(x, key)
            res = md.run_loop(x, prep.label, prep.features_col, by, algorithms, selected, seed=seed, cv_folds=cv_folds,
                              max_train=max_samples, parallel=parallel)
            failures += [(float(s), f"{part}: {error}") for part, error in res.failed.items()]
            for r in md.train_val_gap(res.metrics).collect():
                rows.append((float(s), r["algorithm"], r["train_f1"], r["val_f1"], r["gap"]))
        except Exception as e:  # noqa: BLE001 - the other sliders go on
            failures.append((float(s), e))
    if not rows and failures:
        first = failures[0][1]
        raise RuntimeError("every slider of the gap analysis failed") from (first if isinstance(first, Exception) else RuntimeError(first))
    return spark.createDataFrame(rows, "slider double, algo string, train_f1 double, val_f1 double, gap double")


def gap_verdict(gaps: DataFrame) -> DataFrame:
    """Per algorithm with up-sampled steps, mean gap at slider > 0 vs = 0
    (missing baseline counts as 0); widening when it grows by more than 0.01.
    Without any row at slider 0 there is nothing to compare with: no verdicts."""
    if not gaps.where(F.col("slider") == 0).limit(1).count():
        gaps = gaps.limit(0)
    up = gaps.where(F.col("slider") > 0).groupBy("algo").agg(F.avg("gap").alias("upsample_gap"))
    bz = gaps.where(F.col("slider") == 0).groupBy("algo").agg(F.avg("gap").alias("baseline_gap"))
    j = up.join(bz, "algo", "left").withColumn("baseline_gap", F.coalesce("baseline_gap", F.lit(0.0)))
    return j.withColumn("widening", F.col("upsample_gap") > F.col("baseline_gap") + F.lit(WIDENING_MARGIN))


def _fmt(c: str) -> Column:
    return F.format_string("%.4f", F.col(c))


def fit_diagnosis(metrics: DataFrame) -> DataFrame:
    """Status and explanation from (algorithm, train_f1, val_f1, cv_mean, cv_std)."""
    x = metrics.withColumn("gap", F.col("train_f1") - F.col("val_f1"))
    status = (F.when((F.col("train_f1") > OVERFIT_TRAIN) & (F.col("gap") > OVERFIT_GAP), F.lit("overfit"))
              .when((F.col("train_f1") < UNDERFIT_LEVEL) & (F.col("val_f1") < UNDERFIT_LEVEL), F.lit("underfit"))
              .when((F.col("gap") < OPTIMAL_GAP) & (F.col("val_f1") > OPTIMAL_VAL), F.lit("optimal"))
              .when(F.col("gap") > SLIGHT_GAP, F.lit("slight_overfit"))
              .otherwise(F.lit("acceptable")))
    x = x.withColumn("status", status)
    tf, vf, gp, cm, cs = _fmt("train_f1"), _fmt("val_f1"), _fmt("gap"), _fmt("cv_mean"), _fmt("cv_std")
    scores = F.concat(F.lit("train "), tf, F.lit(", validation "), vf, F.lit(", difference "), gp)
    folds = F.concat(F.lit("; folds "), cm, F.lit(" +/- "), cs)
    advice = (F.when(F.col("status") == "overfit", F.lit("fits its training rows far better than new ones"))
              .when(F.col("status") == "underfit", F.lit("fits neither training rows nor new ones well"))
              .when(F.col("status") == "optimal", F.lit("does as well on new rows as in training"))
              .when(F.col("status") == "slight_overfit", F.lit("loses a little on new rows"))
              .otherwise(F.lit("holds up on new rows")))
    expl = F.concat(advice, F.lit(": "), scores, folds)
    return x.withColumn("explanation", expl)


def checklist(curves: DataFrame | None, cv: DataFrame | None, diagnosis: DataFrame,
              gaps: DataFrame | None) -> DataFrame:
    """Learning curves present, CV present, any gap > 0.05, gap analysis run."""
    spark = diagnosis.sparkSession
    has_curve = curves is not None and bool(curves.limit(1).collect())
    has_cv = cv is not None and bool(cv.limit(1).collect())
    return diagnosis.agg(F.coalesce(F.max((F.col("gap") > OVERFIT_GAP).cast("int")), F.lit(0))
                         .cast("boolean").alias("any_gap_over_005")).select(
        F.lit(has_curve).alias("has_learning_curves"), F.lit(has_cv).alias("has_cv"),
        "any_gap_over_005", F.lit(gaps is not None).alias("has_gap_analysis")) if spark else None


def in_top_k(importance: DataFrame, feature: str, k: int = 5, method: str | None = None) -> DataFrame:
    """Whether ``feature`` is among the top ``k`` of each method."""
    w = Window.partitionBy("method").orderBy(F.col("importance").desc(), F.col("feature").asc())
    imp = importance if method is None else importance.where(F.col("method") == method)
    r = imp.withColumn("rank", F.row_number().over(w))
    return r.groupBy("method").agg(F.max((F.col("feature") == feature) & (F.col("rank") <= k)).alias("in_top_k"))
