"""Registered queries for the training loop (M06-M10) with the value-majority model.

Its fits are exact SQL, so the loop around them (split, scores, folds, nested
prefixes, gaps) is held against DuckDB as a whole.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftlab.operators import models as md
from shiftlab.operators.split import LEARNING_CURVE_FRACTIONS
from shiftlab.plans.q_metrics import _AUC, metric_sql, preds_sql
from shiftlab.plans.q_split import _FOLDS, _SPLIT
from shiftlab.plans.registry import register
from shiftlab.plans.sqlgen import dbl, rank
from shiftlab.sources.tables import TABLE_KEYS, load_table

DOC_KEY = TABLE_KEYS["documents"]
DIGITS = 9


def _loop(spark, sf, **options):
    docs = load_table(spark, sf, "documents").select("doc_id", "lang", "source")
    return md.run_loop(docs, "lang", None, DOC_KEY, md.value_majority("by_source", F.col("source")), **options)


def _grouped_f1_sql(train: str, scored: str) -> str:
    """CTE ``gf`` (g, part, f1): of models fitted per ``g`` on ``train`` (g, source, lang), macro F1 of each
    (g, part) of ``scored`` (g, part, doc_id, source, lang) over the classes in its truth or predictions."""
    return f"""
gtr AS ({train}), gte AS ({scored}),
gcls AS (SELECT DISTINCT lang AS class FROM documents WHERE lang IS NOT NULL),
gcnt AS (SELECT g, source AS v, lang AS class, count(*) AS c FROM gtr GROUP BY ALL),
gtot AS (SELECT g, v, sum(c) AS nv FROM gcnt GROUP BY ALL),
gall AS (SELECT g, count(*) AS n FROM gtr GROUP BY g),
gpri AS (SELECT gtr.g, lang AS class, count(*) / any_value(n) AS p FROM gtr JOIN gall ON gall.g = gtr.g GROUP BY gtr.g, lang),
gsc AS (SELECT x.g, part, doc_id, x.lang AS y_true, k.class,
               CASE WHEN t.nv IS NULL THEN coalesce(p.p, 0.0) ELSE coalesce(c.c, 0) / t.nv END AS score
        FROM gte x JOIN gcls k ON TRUE LEFT JOIN gtot t ON t.g = x.g AND t.v = x.source
        LEFT JOIN gcnt c ON c.g = x.g AND c.v = x.source AND c.class = k.class LEFT JOIN gpri p ON p.g = x.g AND p.class = k.class),
gpr AS (SELECT g, part, doc_id, y_true, first(class ORDER BY score DESC, class) AS y_pred FROM gsc GROUP BY g, part, doc_id, y_true),
gy AS (SELECT g, part, y_true AS c, count(*) AS sup, sum(CASE WHEN y_true = y_pred THEN 1 ELSE 0 END) AS tp FROM gpr GROUP BY ALL),
gp AS (SELECT g, part, y_pred AS c, count(*) AS prd FROM gpr GROUP BY ALL),
gf AS (SELECT g, part, sum(CAST(2 AS DOUBLE) * coalesce(tp, 0) / (coalesce(sup, 0) + coalesce(prd, 0))) / count(*) AS f1
       FROM gy FULL JOIN gp USING (g, part, c) GROUP BY g, part)"""


_CV = f"""folds AS (SELECT f.*, d.source FROM ({_FOLDS}) f JOIN documents d USING (doc_id)),
{_grouped_f1_sql("SELECT n.fold AS g, f.source, f.lang FROM folds f JOIN (SELECT DISTINCT fold FROM folds) n ON f.fold <> n.fold",
                 "SELECT fold AS g, 'val' AS part, doc_id, source, lang FROM folds")}"""


@register("m08_cv_value_majority", f"""WITH {_CV}
SELECT 'by_source' AS algorithm, g AS fold, round(f1, {DIGITS}) AS f1 FROM gf""")
def m08(spark, sf):
    """Five stratified folds of the training part, two fits at a time."""
    cv = _loop(spark, sf, cv_folds=5, parallel=2).cv
    return cv.select("algorithm", "fold", F.round("f1", DIGITS).alias("f1"))


_FRACTIONS = ", ".join(dbl(f) for f in LEARNING_CURVE_FRACTIONS)
_CURVE = f"""s AS ({_SPLIT}),
t AS (SELECT * FROM s WHERE split = 'train'),
k AS (SELECT least(3, min(n)) AS k FROM (SELECT lang, count(*) AS n FROM t GROUP BY lang)),
f AS (SELECT doc_id, lang, source, ({rank(["lang"], DOC_KEY)} % (SELECT k FROM k))::INTEGER AS fold FROM t),
x AS (SELECT f.*, cv.cv_fold FROM f, (SELECT range::INTEGER AS cv_fold FROM range((SELECT k FROM k))) cv WHERE cv.cv_fold <> f.fold),
p AS (SELECT x.*, {rank(["cv_fold"], DOC_KEY)} AS pos FROM x),
sizes AS (SELECT DISTINCT floor(u.f * (SELECT count(*) FROM p WHERE cv_fold = 0))::INTEGER AS size
          FROM (SELECT unnest([{_FRACTIONS}]) AS f) u),
fits AS (SELECT size, cv_fold, size * 10 + cv_fold AS g FROM sizes, (SELECT DISTINCT cv_fold FROM p) WHERE size > 0),
{_grouped_f1_sql("SELECT g, source, lang FROM p JOIN fits USING (cv_fold) WHERE pos < size",
                 "SELECT g, 'train' AS part, doc_id, source, lang FROM p JOIN fits USING (cv_fold) WHERE pos < size UNION ALL "
                 "SELECT g, 'val', doc_id, source, lang FROM f JOIN fits ON fits.cv_fold = f.fold")}"""


@register("m09_curve_value_majority", f"""WITH {_CURVE}
SELECT 'by_source' AS algorithm, g // 10 AS train_size, g % 10 AS fold, part AS split, round(f1, {DIGITS}) AS f1 FROM gf""")
def m09(spark, sf):
    """Train and validation scores on eight nested prefixes of three folds."""
    curve = _loop(spark, sf, cv_folds=0, learning_curves=True, parallel=4).curve
    return curve.select("algorithm", "train_size", "fold", "split", F.round("f1", DIGITS).alias("f1"))


# Scores of the test rows and of the training rows by the same model.
_TEST = "WITH " + metric_sql(preds_sql()).lstrip()
_TRAIN_F1 = f"({_TEST.replace('FROM te JOIN cls', 'FROM tr te JOIN cls')} SELECT f1_macro FROM summ)"
_CV_STATS = f"(WITH {_CV} SELECT avg(f1) AS cv_mean, stddev_pop(f1) AS cv_std FROM gf)"


@register("m06_loop_value_majority", f"""{_TEST}{_AUC},
w AS (SELECT f1_macro, precision_macro, recall_macro, f1_weighted, accuracy, (SELECT avg(auc) FROM auc) AS roc_auc,
             {_TRAIN_F1} AS train_f1, f1_macro AS val_f1, v.cv_mean, v.cv_std FROM summ, {_CV_STATS} v)
SELECT 'by_source' AS algorithm, metric, round(value, {DIGITS}) AS value FROM w UNPIVOT (value FOR metric IN
  (f1_macro, precision_macro, recall_macro, f1_weighted, accuracy, roc_auc, train_f1, val_f1, cv_mean, cv_std))""")
def m06(spark, sf):
    """Every metric of the loop but the fit's time, AUC from probabilities and CV included."""
    metrics = _loop(spark, sf, cv_folds=5, parallel=2).metrics.where("metric <> 'train_time'")
    return metrics.select("algorithm", "metric", F.round("value", DIGITS).alias("value"))


@register("m06_per_class_value_majority", f"""{_TEST}
SELECT 'by_source' AS algorithm, class, tp, fp, fn, tn, support, precision, recall, f1, specificity FROM pc""")
def m06_per_class(spark, sf):
    return _loop(spark, sf, cv_folds=0).per_class


@register("m07_quick_value_majority", f"{_TEST} SELECT 'by_source' AS algorithm, round(f1_macro, {DIGITS}) AS f1_macro FROM summ")
def m07(spark, sf):
    docs = load_table(spark, sf, "documents").select("doc_id", "lang", "source")
    got = md.quick_scores(docs, "lang", None, DOC_KEY, md.value_majority("by_source", F.col("source")))
    return got.select("algorithm", F.round("f1_macro", DIGITS).alias("f1_macro"))


@register("m10_gap_value_majority", f"""{_TEST}
SELECT 'by_source' AS algorithm, round({_TRAIN_F1}, {DIGITS}) AS train_f1, round(f1_macro, {DIGITS}) AS val_f1,
       round(cv_mean, {DIGITS}) AS cv_mean, round(cv_std, {DIGITS}) AS cv_std, round({_TRAIN_F1} - f1_macro, {DIGITS}) AS gap
FROM summ, {_CV_STATS} v""")
def m10(spark, sf):
    """Training against validation score, from the loop's metrics."""
    gap = md.train_val_gap(_loop(spark, sf, cv_folds=5, parallel=2).metrics)
    return gap.select("algorithm", *(F.round(c, DIGITS).alias(c) for c in ("train_f1", "val_f1", "cv_mean", "cv_std", "gap")))
