"""Classification metrics from a prediction table.

Everything derives from the confusion counts ``(y_true, y_pred, n)``, a table
of at most K*K rows built by one partial aggregation over the predictions, so
the metric suite costs one pass over the data whatever its size.  Macro
averages run over the given class list (zero-division gives 0), matching
"macro over the classes present in the labelled data".

ROC AUC is the one-vs-rest rank-sum statistic computed on per-class score
histograms: rows collapse to ``(class, score) -> (pos, neg)``, negatives below
each score are accumulated per bucket (a small table) plus a window inside each
bucket, so no window ever spans a whole class.  The buckets of a class are cut at
quantiles of its distinct scores, so they are of equal depth wherever scores pile up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftlab.session import ensure_checkpoint_dir

MAX_CLASSES = 10_000
AUC_BUCKETS = 256


def class_list(df: DataFrame, column: str) -> list:
    """Distinct non-NULL values, ascending (bounded)."""
    rows = (df.where(F.col(column).isNotNull()).select(column).distinct()
            .limit(MAX_CLASSES + 1).collect())
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    return sorted(r[0] for r in rows)


def confusion(preds: DataFrame, truth: str, pred: str, classes: Sequence) -> DataFrame:
    """``(y_true, y_pred, n)`` for every class pair in ``classes``, zero-filled.

    A pivot on the fixed class list gives the zero cells without a class x class
    join; labels outside the list are ignored.
    """
    classes = list(classes)
    counts = preds.groupBy(F.col(truth).alias("y_true"), F.col(pred).alias("y_pred")) \
        .agg(F.count(F.lit(1)).alias("n"))
    wide = counts.groupBy("y_true").pivot("y_pred", classes).agg(F.sum("n"))
    spark = preds.sparkSession
    cls = spark.createDataFrame([(c,) for c in classes], ["y_true"]) if classes else None
    wide = cls.join(wide.where(F.col("y_true").isin(*classes)), "y_true", "left")
    cols = [F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("bigint").alias(str(c)) for c in classes]
    wide = wide.select(F.col("y_true"), *cols)
    return wide.unpivot(["y_true"], [str(c) for c in classes], "y_pred", "n")


def per_class(cm: DataFrame) -> DataFrame:
    """E02 + E03: tp, fp, fn, tn, support, precision, recall, f1, specificity per class.

    ``f1 = 2tp / (2tp + fp + fn)``; every ratio is 0 when its denominator is 0.
    """
    cmc = cm.select(F.col("y_true").cast("string").alias("t"), F.col("y_pred").cast("string").alias("p"), "n")
    rows = cmc.groupBy(F.col("t").alias("class")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"))
    cols = cmc.groupBy(F.col("p").alias("class")).agg(F.sum("n").alias("predicted"))
    d = rows.join(cols, "class").withColumn("total", F.sum("support").over(Window.partitionBy()))
    d = d.select(
        "class", F.col("tp").cast("bigint").alias("tp"),
        (F.col("predicted") - F.col("tp")).cast("bigint").alias("fp"),
        (F.col("support") - F.col("tp")).cast("bigint").alias("fn"),
        (F.col("total") - F.col("support") - F.col("predicted") + F.col("tp")).cast("bigint").alias("tn"),
        F.col("support").cast("bigint").alias("support"))

    def ratio(num: Column, den: Column) -> Column:
        return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))

    return d.select(
        "class", "tp", "fp", "fn", "tn", "support",
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
        ratio(F.col("tn"), F.col("tn") + F.col("fp")).alias("specificity"))


def summary(pc: DataFrame) -> DataFrame:
    """Macro precision/recall/F1, weighted F1 and accuracy (one row)."""
    return pc.agg(
        F.avg("f1").alias("f1_macro"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        F.when(F.sum("support") > 0, F.sum(F.col("f1") * F.col("support")) / F.sum("support"))
        .otherwise(F.lit(0.0)).alias("f1_weighted"),
        F.when(F.sum("support") > 0, F.sum("tp") / F.sum("support")).otherwise(F.lit(0.0)).alias("accuracy"))


def macro_f1(preds: DataFrame, truth: str, pred: str, classes: Sequence) -> DataFrame:
    """Macro F1 only (the quick loop's score) as a one-row frame."""
    return summary(per_class(confusion(preds, truth, pred, classes))).select("f1_macro")


def grouped_macro_f1(preds: DataFrame, groups: Sequence[str], truth: str, pred: str,
                     n_classes: int | None = None, n: str | None = None) -> DataFrame:
    """Macro F1 per group in one aggregation; ``n`` is how often a row counts (once without it).  With ``n_classes`` the mean runs
    over that many classes (absent ones count 0); without it, over the classes
    present in the group's truth or predictions (the scorer convention)."""
    g = list(groups)
    c = preds.groupBy(*g, F.col(truth).alias("_y"), F.col(pred).alias("_p")).agg(F.sum(F.col(n) if n else F.lit(1)).alias("_n"))
    by_y = c.groupBy(*g, F.col("_y").alias("_c")).agg(
        F.sum("_n").alias("_sup"), F.sum(F.when(F.col("_y") == F.col("_p"), F.col("_n")).otherwise(0)).alias("_tp"))
    by_p = c.groupBy(*g, F.col("_p").alias("_c")).agg(F.sum("_n").alias("_prd"))
    j = by_y.join(by_p, [*g, "_c"], "full_outer").fillna(0, ["_sup", "_tp", "_prd"])
    f1 = F.when(F.col("_sup") + F.col("_prd") > 0, 2.0 * F.col("_tp") / (F.col("_sup") + F.col("_prd"))) \
        .otherwise(F.lit(0.0))
    den = F.lit(float(n_classes)) if n_classes else F.count(F.lit(1)).cast("double")
    return j.groupBy(*g).agg((F.sum(f1) / den).alias("f1"))


def class_report(pc: DataFrame) -> DataFrame:
    """Per-class rows plus accuracy, macro avg and weighted avg rows."""
    per = pc.select(F.col("class").alias("row"), "precision", "recall", "f1", "support")
    tot = pc.agg(
        F.sum("support").alias("s"), F.sum("tp").alias("tp"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        F.sum(F.col("precision") * F.col("support")).alias("wp"),
        F.sum(F.col("recall") * F.col("support")).alias("wr"),
        F.sum(F.col("f1") * F.col("support")).alias("wf"))

    def w(c):
        return F.when(F.col("s") > 0, F.col(c) / F.col("s")).otherwise(F.lit(0.0))

    acc = tot.select(F.lit("accuracy").alias("row"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"), w("tp").alias("f1"), F.col("s").alias("support"))
    mac = tot.select(F.lit("macro avg").alias("row"), F.col("mp").alias("precision"),
                     F.col("mr").alias("recall"), F.col("mf").alias("f1"), F.col("s").alias("support"))
    wtd = tot.select(F.lit("weighted avg").alias("row"), w("wp").alias("precision"),
                     w("wr").alias("recall"), w("wf").alias("f1"), F.col("s").alias("support"))
    return per.unionByName(acc).unionByName(mac).unionByName(wtd)


def scores_long(preds: DataFrame, truth: str, score_col: str, classes: Sequence) -> DataFrame:
    """(class, y, score) rows from an array score column aligned with ``classes``."""
    arr = F.array(*[F.lit(str(c)) for c in classes])
    x = preds.select(F.col(truth).cast("string").alias("_t"), F.posexplode(score_col).alias("_i", "score"))
    return x.select(F.element_at(arr, F.col("_i") + 1).alias("class"),
                    (F.col("_t") == F.element_at(arr, F.col("_i") + 1)).alias("y"),
                    F.col("score").cast("double").alias("score"))


def score_buckets(hist: DataFrame, buckets: int = AUC_BUCKETS) -> DataFrame:
    """``hist`` (one row per class and score) with the number ``b`` of its bucket: as many distinct scores in each.

    The splitters, at most ``buckets`` a class, come from one mergeable sketch per class; they are fixed
    on the driver, so that every use of a bucket sees the same ones."""
    at = F.percentile_approx("score", [i / buckets for i in range(1, buckets)], 20 * buckets)
    rows = [(r["class"], sorted(set(r["s"]))) for r in hist.groupBy("class").agg(at.alias("s")).collect()]
    splits = hist.sparkSession.createDataFrame(rows, "class string, s array<double>")
    return (hist.join(F.broadcast(splits), "class")
            .withColumn("b", F.size(F.filter("s", lambda v: v < F.col("score")))).drop("s"))


def auc_per_class(long: DataFrame) -> DataFrame:
    """E05 per class: P(score of a positive > a negative) + 0.5 P(tie).

    ``long`` has (class, y boolean, score).  Classes without positives or
    negatives get NULL.
    """
    hist = long.groupBy("class", "score").agg(
        F.sum(F.col("y").cast("long")).alias("pos"), F.sum((~F.col("y")).cast("long")).alias("neg"))
    ensure_checkpoint_dir(long.sparkSession)
    hb = score_buckets(hist.checkpoint())
    per_b = hb.groupBy("class", "b").agg(F.sum("neg").alias("bneg"))
    wb = Window.partitionBy("class").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    per_b = per_b.withColumn("neg_before_b", F.coalesce(F.sum("bneg").over(wb), F.lit(0))).drop("bneg")
    wi = Window.partitionBy("class", "b").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    x = hb.join(per_b, ["class", "b"]).withColumn(
        "neg_below", F.col("neg_before_b") + F.coalesce(F.sum("neg").over(wi), F.lit(0)))
    agg = x.groupBy("class").agg(
        F.sum("pos").alias("P"), F.sum("neg").alias("N"),
        F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") * F.lit(0.5))).alias("u"))
    return agg.select("class", F.when((F.col("P") > 0) & (F.col("N") > 0),
                                      F.col("u") / (F.col("P").cast("double") * F.col("N"))).alias("auc"))


def macro_auc(long: DataFrame, n_classes: int) -> DataFrame:
    """Mean one-vs-rest AUC; NULL for two classes or fewer."""
    a = auc_per_class(long)
    if n_classes <= 2:
        return a.agg(F.lit(None).cast("double").alias("roc_auc"))
    return a.agg(F.avg("auc").alias("roc_auc"))


SUMMARY_COLUMNS = ["f1_macro", "f1_weighted", "accuracy", "precision_macro", "recall_macro",
                   "roc_auc", "train_f1", "val_f1", "cv_mean", "cv_std", "train_time"]


def results_summary(metrics_long: DataFrame, digits: int | None = 4) -> DataFrame:
    """One row per algorithm from ``(algorithm, metric, value)``; AUC NULL if absent/0."""
    wide = metrics_long.groupBy("algorithm").pivot("metric", SUMMARY_COLUMNS).agg(F.first("value"))
    cols = [F.col("algorithm")]
    for m in SUMMARY_COLUMNS:
        v = F.col(m)
        if m == "roc_auc":
            v = F.when(v != 0, v)
        if digits is not None:
            v = F.round(v, 2 if m == "train_time" else digits)
        cols.append(v.alias(m))
    return wide.select(*cols)
