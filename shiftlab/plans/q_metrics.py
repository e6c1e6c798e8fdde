"""Registered queries for metrics (E01-E07) on exact, SQL-reproducible predictions.

Predictions come from ``ValueMajority``: split ``documents`` by language
(S02), learn the language mix per ``source`` on the training part, predict the
test part.  A second, rule-based prediction on ``labels`` covers two classes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftlab.operators import metrics as mt
from shiftlab.operators import split as sp
from shiftlab.operators.models import ValueMajority
from shiftlab.plans.q_split import _SPLIT
from shiftlab.plans.registry import register
from shiftlab.sources.tables import TABLE_KEYS, load_table

DOC_KEY = TABLE_KEYS["documents"]


def doc_predictions(spark, sf, column: str = "source"):
    d = load_table(spark, sf, "documents")
    s, info = sp.train_test_split_info(d, "lang", DOC_KEY)
    classes = info["classes"] if info else mt.class_list(d, "lang")
    train, test = s.where(F.col("split") == "train"), s.where(F.col("split") == "test")
    m = ValueMajority(column, "lang", classes).fit(train, info["train_counts"] if info else None)
    return m.transform(test), classes


def preds_sql(column: str = "source") -> str:
    """CTEs ``cls`` (class list), ``sc`` (doc, y_true, class, score), ``pr`` (doc, y_true, y_pred)."""
    return f"""
s AS ({_SPLIT}),
tr AS (SELECT * FROM s WHERE split = 'train'),
te AS (SELECT * FROM s WHERE split = 'test'),
cls AS (SELECT DISTINCT lang AS class FROM documents WHERE lang IS NOT NULL),
cnt AS (SELECT {column} AS v, lang AS class, count(*) AS c FROM tr GROUP BY ALL),
tot AS (SELECT v, sum(c) AS nv FROM cnt GROUP BY v),
pri AS (SELECT lang AS class, count(*) / (SELECT count(*) FROM tr) AS p FROM tr GROUP BY lang),
sc AS (SELECT te.doc_id, te.lang AS y_true, cls.class,
              CASE WHEN tot.nv IS NULL THEN coalesce(pri.p, 0.0) ELSE coalesce(cnt.c, 0) / tot.nv END AS score
       FROM te JOIN cls ON TRUE LEFT JOIN tot ON tot.v = te.{column}
       LEFT JOIN cnt ON cnt.v = te.{column} AND cnt.class = cls.class
       LEFT JOIN pri ON pri.class = cls.class),
pr AS (SELECT doc_id, y_true, first(class ORDER BY score DESC, class) AS y_pred FROM sc GROUP BY doc_id, y_true)"""


def metric_sql(pred_ctes: str) -> str:
    """CTEs ``cm`` (confusion), ``pc`` (per class), ``summ`` (one row) over ``cls`` and ``pr``."""
    return f"""{pred_ctes},
cm AS (SELECT a.class AS y_true, b.class AS y_pred, count(pr.y_true) AS n
       FROM cls a JOIN cls b ON TRUE LEFT JOIN pr ON pr.y_true = a.class AND pr.y_pred = b.class GROUP BY ALL),
rws AS (SELECT y_true AS class, sum(n) AS support, sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END) AS tp
        FROM cm GROUP BY 1),
cols AS (SELECT y_pred AS class, sum(n) AS predicted FROM cm GROUP BY 1),
pc0 AS (SELECT class, tp::BIGINT AS tp, (predicted - tp)::BIGINT AS fp, (support - tp)::BIGINT AS fn,
               ((SELECT sum(n) FROM cm) - support - predicted + tp)::BIGINT AS tn, support::BIGINT AS support
        FROM rws JOIN cols USING (class)),
pc AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
              CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
              CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1,
              CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0.0 END AS specificity FROM pc0),
summ AS (SELECT avg(f1) AS f1_macro, avg(precision) AS precision_macro, avg(recall) AS recall_macro,
                CASE WHEN sum(support) > 0 THEN sum(f1 * support) / sum(support) ELSE 0.0 END AS f1_weighted,
                CASE WHEN sum(support) > 0 THEN sum(tp) / sum(support) ELSE 0.0 END AS accuracy FROM pc)"""


_AUC = """,
hist AS (SELECT class, score, sum(CASE WHEN y_true = class THEN 1 ELSE 0 END) AS pos,
                sum(CASE WHEN y_true = class THEN 0 ELSE 1 END) AS neg FROM sc GROUP BY ALL),
cum AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY class ORDER BY score
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below FROM hist),
auc AS (SELECT class, CASE WHEN sum(pos) > 0 AND sum(neg) > 0
                THEN CAST(sum(pos * (neg_below + neg * CAST(0.5 AS DOUBLE))) AS DOUBLE) / (sum(pos) * sum(neg))
                END AS auc FROM cum GROUP BY class)"""

DOC_METRICS = "WITH " + metric_sql(preds_sql()).lstrip()


@register("m01_value_majority_predictions", f"WITH {preds_sql().lstrip()} SELECT doc_id, y_true, y_pred FROM pr")
def m01v(spark, sf):
    p, _ = doc_predictions(spark, sf)
    return p.select("doc_id", F.col("lang").alias("y_true"), "y_pred")


@register("e01_confusion_matrix", f"{DOC_METRICS} SELECT y_true, y_pred, n FROM cm")
def e01(spark, sf):
    p, classes = doc_predictions(spark, sf)
    return mt.confusion(p, "lang", "y_pred", classes)


@register("e02_per_class_metrics", f"""{DOC_METRICS}
SELECT class, tp, fp, fn, tn, support, precision, recall, f1, specificity FROM pc""")
def e02(spark, sf):
    p, classes = doc_predictions(spark, sf)
    return mt.per_class(mt.confusion(p, "lang", "y_pred", classes))


@register("e03_specificity", f"{DOC_METRICS} SELECT class, specificity FROM pc")
def e03(spark, sf):
    p, classes = doc_predictions(spark, sf)
    return mt.per_class(mt.confusion(p, "lang", "y_pred", classes)).select("class", "specificity")


@register("e04_summary_metrics", f"{DOC_METRICS} SELECT * FROM summ")
def e04(spark, sf):
    p, classes = doc_predictions(spark, sf)
    return mt.summary(mt.per_class(mt.confusion(p, "lang", "y_pred", classes)))


_BIN = """
pr AS (SELECT d.doc_id, CAST(l.toxic AS VARCHAR) AS y_true, CAST(1 - l.quality AS VARCHAR) AS y_pred
       FROM labels l JOIN documents d USING (doc_id)),
cls AS (SELECT DISTINCT CAST(toxic AS VARCHAR) AS class FROM labels WHERE toxic IS NOT NULL)"""


@register("e04_summary_metrics_binary", f"WITH {metric_sql(_BIN).lstrip()} SELECT * FROM summ")
def e04b(spark, sf):
    lab = load_table(spark, sf, "labels").join(load_table(spark, sf, "documents").select("doc_id"), "doc_id")
    p = lab.select(F.col("toxic").cast("string").alias("y_true"),
                   (F.lit(1) - F.col("quality")).cast("string").alias("y_pred"))
    classes = mt.class_list(p, "y_true")
    return mt.summary(mt.per_class(mt.confusion(p, "y_true", "y_pred", classes)))


@register("e05_roc_auc_per_class", f"{DOC_METRICS}{_AUC} SELECT class, auc FROM auc")
def e05c(spark, sf):
    p, classes = doc_predictions(spark, sf)
    return mt.auc_per_class(mt.scores_long(p, "lang", "score", classes))


@register("e05_roc_auc_macro", f"{DOC_METRICS}{_AUC} SELECT avg(auc) AS roc_auc FROM auc")
def e05(spark, sf):
    p, classes = doc_predictions(spark, sf)
    return mt.macro_auc(mt.scores_long(p, "lang", "score", classes), len(classes))


@register("e06_classification_report", f"""{DOC_METRICS}
SELECT class AS "row", precision, recall, f1, support FROM pc
UNION ALL SELECT 'accuracy', NULL, NULL, sum(tp) / sum(support), sum(support) FROM pc
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM pc
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                 sum(f1 * support) / sum(support), sum(support) FROM pc""")
def e06(spark, sf):
    p, classes = doc_predictions(spark, sf)
    return mt.class_report(mt.per_class(mt.confusion(p, "lang", "y_pred", classes)))


@register("e07_results_summary", f"""{DOC_METRICS}{_AUC}
SELECT 'by_source' AS algorithm, round(f1_macro, 4) AS f1_macro, round(f1_weighted, 4) AS f1_weighted,
       round(accuracy, 4) AS accuracy, round(precision_macro, 4) AS precision_macro,
       round(recall_macro, 4) AS recall_macro, round((SELECT avg(auc) FROM auc), 4) AS roc_auc,
       CAST(NULL AS DOUBLE) AS train_f1, round(f1_macro, 4) AS val_f1, CAST(NULL AS DOUBLE) AS cv_mean,
       CAST(NULL AS DOUBLE) AS cv_std, CAST(NULL AS DOUBLE) AS train_time FROM summ""")
def e07(spark, sf):
    p, classes = doc_predictions(spark, sf)
    summ = mt.summary(mt.per_class(mt.confusion(p, "lang", "y_pred", classes)))
    auc = mt.macro_auc(mt.scores_long(p, "lang", "score", classes), len(classes))
    ms = ["f1_macro", "f1_weighted", "accuracy", "precision_macro", "recall_macro"]
    pairs = [(m, F.col(m)) for m in ms] + [("val_f1", F.col("f1_macro"))]
    kv = F.array(*[F.struct(F.lit(m).alias("metric"), c.alias("value")) for m, c in pairs])
    long = summ.select(F.explode(kv).alias("kv"))
    long = long.select(F.lit("by_source").alias("algorithm"), "kv.metric", "kv.value")
    long = long.unionByName(auc.select(F.lit("by_source").alias("algorithm"), F.lit("roc_auc").alias("metric"),
                                       F.col("roc_auc").alias("value")))
    return mt.results_summary(long)
