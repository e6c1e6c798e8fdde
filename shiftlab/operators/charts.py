"""The data behind every chart (V01-V15); drawing is left to the caller.

Each function reduces a result table (confusion counts, per-class metrics,
step tables, learning curves, fold scores) to the rows a plot needs.  All are
aggregations or windows over small result tables, except the histogram (V06),
which is one distributed aggregation over the data column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftlab.operators import sweep as sw

GAP_RED, GAP_GREEN = 0.05, 0.03
BOX_QUANTILES = [0.0, 0.25, 0.5, 0.75, 1.0]
RADAR_METRICS = ["f1_macro", "accuracy", "precision_macro", "recall_macro", "roc_auc"]


def normalized_confusion(cm: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Each count divided by its true-class row total (empty rows stay 0)."""
    w = Window.partitionBy(*group, "y_true")
    tot = F.sum("n").over(w)
    return cm.withColumn("rate", F.col("n") / F.when(tot == 0, F.lit(1)).otherwise(tot))


def class_metrics_chart(per_class: DataFrame, digits: int = 4) -> DataFrame:
    """Sensitivity, specificity, precision, F1 per class (and algorithm)."""
    keep = [c for c in ("algorithm",) if c in per_class.columns]
    return per_class.select(*keep, "class",
                            F.round("recall", digits).alias("sensitivity"),
                            F.round("specificity", digits).alias("specificity"),
                            F.round("precision", digits).alias("precision"),
                            F.round("f1", digits).alias("f1"))


def baseline_vs_current(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Per algorithm macro F1 before/after (missing -> 0) and the delta.

    Both inputs have (algorithm, f1_macro)."""
    b = baseline.select("algorithm", F.col("f1_macro").alias("baseline"))
    c = current.select("algorithm", F.col("f1_macro").alias("current"))
    j = b.join(c, "algorithm", "full_outer").fillna(0.0, ["baseline", "current"])
    return j.withColumn("delta", F.col("current") - F.col("baseline"))


def class_counts_before_after(before: DataFrame, after: DataFrame, column: str,
                              order: Sequence[str]) -> DataFrame:
    """Counts per class in the given label order, zero-filled."""
    spark = before.sparkSession
    cls = spark.createDataFrame([(str(c), i) for i, c in enumerate(order)], "class string, ord int")
    b = before.groupBy(F.col(column).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("before"))
    a = after.groupBy(F.col(column).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("after"))
    return (cls.join(b, "class", "left").join(a, "class", "left").fillna(0, ["before", "after"])
            .orderBy("ord"))


def top_importances(imp: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` largest importances (ties: feature)."""
    return imp.orderBy(F.col("importance").desc(), F.col("feature").asc()).limit(n)


def histogram(df: DataFrame, column: str, bins: int | None = None) -> DataFrame:
    """V06 (numeric): equal-width bins over the column's own [min, max], last bin
    closed, NULLs dropped; ``bins = min(50, max(10, rows // 100))`` by default.
    Returns every bin with its edges and count (zero-filled)."""
    v = F.col(column).cast("double")
    d = df.select(v.alias("v")).where(F.col("v").isNotNull())
    st = d.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    n, lo, hi = int(st["n"]), st["lo"], st["hi"]
    spark = df.sparkSession
    if n == 0:
        return spark.createDataFrame([], "bin int, lo double, hi double, count long")
    k = bins or min(50, max(10, n // 100))
    width = (hi - lo) if hi > lo else 1.0
    b = F.least(F.floor((F.col("v") - F.lit(lo)) / F.lit(width) * F.lit(k)), F.lit(k - 1)).cast("int")
    counts = d.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    edges = spark.range(k).select(F.col("id").cast("int").alias("bin"))
    edges = edges.select("bin", (F.lit(lo) + F.col("bin") * F.lit(width) / F.lit(k)).alias("lo"),
                         (F.lit(lo) + (F.col("bin") + 1) * F.lit(width) / F.lit(k)).alias("hi"))
    return edges.join(counts, "bin", "left").fillna(0, ["count"]).orderBy("bin")


def distribution_before_after(before: DataFrame, after: DataFrame, column: str,
                              numeric: bool, bins: int | None = None) -> DataFrame:
    """Value counts (categorical) or histograms (numeric) for both tables."""
    if numeric:
        return (histogram(before, column, bins).withColumn("which", F.lit("before"))
                .unionByName(histogram(after, column, bins).withColumn("which", F.lit("after"))))
    vb = before.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")) \
        .agg(F.count(F.lit(1)).alias("count")).withColumn("which", F.lit("before"))
    va = after.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")) \
        .agg(F.count(F.lit(1)).alias("count")).withColumn("which", F.lit("after"))
    return vb.unionByName(va)


def radar(metrics_wide: DataFrame) -> DataFrame:
    """Five metrics per algorithm as long rows; a missing AUC is 0."""
    cols = [F.coalesce(F.col(m), F.lit(0.0)).alias(m) for m in RADAR_METRICS]
    return metrics_wide.select("algorithm", *cols).unpivot(["algorithm"], RADAR_METRICS, "metric", "value")


def sweep_chart(steps: DataFrame, baseline: DataFrame, threshold: float = sw.DEFAULT_THRESHOLD) -> DataFrame:
    """Kept steps with the optimum flagged and the run's mean baseline."""
    traj = sw.trajectory(steps, threshold)
    opt = sw.optimum(steps, baseline, threshold).select("run_id", "optimal_value")
    base = baseline.groupBy("run_id").agg(F.avg("score").alias("baseline_avg"))
    return (traj.join(opt, "run_id").join(base, "run_id", "left")
            .withColumn("is_optimum", F.col("slider") == F.col("optimal_value"))
            .select("run_id", "step", "slider", "avg_score", "is_optimum", "baseline_avg"))


def step_deltas(steps: DataFrame, threshold: float = sw.DEFAULT_THRESHOLD) -> DataFrame:
    """Per kept step the delta and its sign."""
    traj = sw.trajectory(steps, threshold)
    sign = F.when(F.col("delta") > 0, F.lit("up")).when(F.col("delta") < 0, F.lit("down")).otherwise(F.lit("flat"))
    return traj.select("run_id", "step", "slider", "delta", sign.alias("direction"))


def learning_curve_bands(curve: DataFrame) -> DataFrame:
    """Mean and population sd of F1 per (algorithm, size, split), plus the
    train - validation gap at the largest size."""
    g = curve.groupBy("algorithm", "train_size", "split").agg(
        F.avg("f1").alias("mean"), F.stddev_pop("f1").alias("std"))
    w = Window.partitionBy("algorithm")
    last = g.withColumn("_max", F.max("train_size").over(w)).where(F.col("train_size") == F.col("_max"))
    gap = last.groupBy("algorithm").agg(
        (F.max(F.when(F.col("split") == "train", F.col("mean")))
         - F.max(F.when(F.col("split") == "val", F.col("mean")))).alias("final_gap"))
    return g.join(gap, "algorithm", "left")


def train_val_bands(gaps: DataFrame) -> DataFrame:
    """Train vs validation F1 with a colour band by gap (> .05 red, < .03 green)."""
    gap = F.col("train_f1") - F.col("val_f1")
    band = F.when(gap > GAP_RED, F.lit("red")).when(gap < GAP_GREEN, F.lit("green")).otherwise(F.lit("orange"))
    return gaps.select("algorithm", "train_f1", "val_f1", gap.alias("gap"), band.alias("band"))


def fold_box(cv: DataFrame) -> DataFrame:
    """Min, quartiles, max (linear interpolation) and mean of fold scores."""
    q = F.percentile(F.col("f1"), F.array(*[F.lit(x) for x in BOX_QUANTILES]))
    g = cv.groupBy("algorithm").agg(q.alias("_q"), F.avg("f1").alias("mean"))
    names = ["min", "q1", "median", "q3", "max"]
    return g.select("algorithm", *[F.col("_q")[i].alias(nm) for i, nm in enumerate(names)], "mean")


def diagnosis_bars(diag: DataFrame) -> DataFrame:
    """Train, validation and CV mean per algorithm as long rows."""
    return diag.select("algorithm", "train_f1", "val_f1", "cv_mean").unpivot(
        ["algorithm"], ["train_f1", "val_f1", "cv_mean"], "metric", "value")


def gap_lines(gaps: DataFrame) -> DataFrame:
    """Gap per (algorithm, slider), ordered, flagged above the .05 line."""
    return gaps.select("algo", "slider", "gap", (F.col("gap") > GAP_RED).alias("above_threshold")) \
        .orderBy("algo", "slider")


def optimum_summary(steps: DataFrame, baseline: DataFrame, threshold: float = sw.DEFAULT_THRESHOLD) -> DataFrame:
    """Per run the optimum, best F1 and algorithm, and the best baseline score."""
    opt = sw.optimum(steps, baseline, threshold)
    best_base = baseline.groupBy("run_id").agg(F.max("score").alias("baseline_best"))
    return opt.join(best_base, "run_id", "left").select(
        "run_id", "optimal_value", "best_f1", "best_algorithm", "exit_reason", "baseline_best",
        (F.col("best_f1") - F.col("baseline_best")).alias("improvement"))
