"""Registered queries for the chart tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftlab.operators import charts as ch
from shiftlab.operators import metrics as mt
from shiftlab.operators import rebalance as rb
from shiftlab.plans.q_metrics import DOC_METRICS, _AUC, doc_predictions
from shiftlab.plans.q_models import _IMP, doc_importances
from shiftlab.plans.q_rebalance import _MED, _target_down_sql, _two_group_sql
from shiftlab.plans.q_sweep import (
    _BAND_SQL,
    _BASE_SQL,
    _DIAG_SRC,
    GAP_SQL,
    STEPS_SQL,
    _band,
    diag_metrics,
    event_baseline,
    event_steps,
    gap_table,
)
from shiftlab.plans.registry import register
from shiftlab.plans.sqlgen import dbl
from shiftlab.sources.tables import TABLE_KEYS, load_table

DOC_KEY = TABLE_KEYS["documents"]
LANG_ORDER = ["en", "fr", "de", "es"]


def _doc_pc(spark, sf):
    p, classes = doc_predictions(spark, sf)
    return p, classes, mt.per_class(mt.confusion(p, "lang", "y_pred", classes))


@register("v01_normalized_confusion", f"""{DOC_METRICS},
tt AS (SELECT y_true, sum(n) AS tot FROM cm GROUP BY y_true)
SELECT y_true, y_pred, n, n / CASE WHEN tot = 0 THEN 1 ELSE tot END AS rate FROM cm JOIN tt USING (y_true)""")
def v01(spark, sf):
    p, classes = doc_predictions(spark, sf)
    return ch.normalized_confusion(mt.confusion(p, "lang", "y_pred", classes))


@register("v02_class_metrics_chart", f"""{DOC_METRICS}
SELECT class, round(recall, 4) AS sensitivity, round(specificity, 4) AS specificity,
       round(precision, 4) AS precision, round(f1, 4) AS f1 FROM pc""")
def v02(spark, sf):
    return ch.class_metrics_chart(_doc_pc(spark, sf)[2])


_V03 = f"""
b AS (SELECT {_BAND_SQL} AS algorithm, round(avg(value) / 100.0, 9) AS f1_macro FROM events
      WHERE event_type = 'click' GROUP BY ALL),
c AS (SELECT * FROM (SELECT {_BAND_SQL} AS algorithm, round(avg(value) / 100.0, 9) AS f1_macro FROM events
      WHERE event_type = 'view' GROUP BY ALL) WHERE algorithm <> 'night')"""


@register("v03_baseline_vs_current", f"""WITH {_V03}
SELECT coalesce(b.algorithm, c.algorithm) AS algorithm, coalesce(b.f1_macro, 0.0) AS baseline,
       coalesce(c.f1_macro, 0.0) AS current, coalesce(c.f1_macro, 0.0) - coalesce(b.f1_macro, 0.0) AS delta
FROM b FULL OUTER JOIN c ON b.algorithm = c.algorithm""")
def v03(spark, sf):
    e = load_table(spark, sf, "events")

    def agg(t):
        return e.where(F.col("event_type") == t).groupBy(_band().alias("algorithm")).agg(
            F.round(F.avg("value") / F.lit(100.0), 9).alias("f1_macro"))

    return ch.baseline_vs_current(agg("click"), agg("view").where(F.col("algorithm") != "night"))


@register("v04_class_counts_before_after", f"""
WITH a AS ({_target_down_sql("documents", "lang", DOC_KEY, -0.5)}),
o AS (SELECT * FROM (VALUES ('en', 0), ('fr', 1), ('de', 2), ('es', 3)) t(class, ord)),
bb AS (SELECT lang AS class, count(*) AS before FROM documents GROUP BY lang),
aa AS (SELECT lang AS class, count(*) AS after FROM a GROUP BY lang)
SELECT o.class, o.ord, coalesce(before, 0) AS before, coalesce(after, 0) AS after
FROM o LEFT JOIN bb USING (class) LEFT JOIN aa USING (class)""")
def v04(spark, sf):
    d = load_table(spark, sf, "documents")
    return ch.class_counts_before_after(d, rb.rebalance_target(d, "lang", -0.5, DOC_KEY), "lang", LANG_ORDER)


@register("v05_top_importances", f"""WITH {_IMP}
SELECT method, feature, importance FROM imp WHERE method = 'en' ORDER BY importance DESC, feature LIMIT 10""")
def v05(spark, sf):
    return ch.top_importances(doc_importances(spark, sf).where(F.col("method") == "en"), 10)


def _hist_sql(src: str) -> str:
    return f"""(WITH d AS (SELECT CAST(value AS DOUBLE) AS v FROM ({src}) WHERE value IS NOT NULL),
st AS (SELECT count(*) AS n, min(v) AS lo, max(v) AS hi FROM d),
k AS (SELECT least(50, greatest(10, n // 100)) AS k, lo, CASE WHEN hi > lo THEN hi - lo ELSE 1.0 END AS w FROM st),
c AS (SELECT least(floor((v - lo) / w * k), k - 1)::INTEGER AS bin, count(*) AS cnt FROM d, k GROUP BY 1),
e AS (SELECT range::INTEGER AS bin, lo + range * w / k AS blo, lo + (range + 1) * w / k AS bhi
      FROM k, range((SELECT k FROM k)))
SELECT e.bin, e.blo AS lo, e.bhi AS hi, coalesce(c.cnt, 0) AS count FROM e LEFT JOIN c USING (bin))"""


_AFTER = _two_group_sql("events", f"value > {_MED}", f"value <= {_MED}", ["event_id"],
                        f"greatest(floor({{g}} * (1 - {dbl(0.5)} * 0.8))::BIGINT, 1)", False)


@register("v06_histogram_before_after", f"""
SELECT *, 'before' AS which FROM {_hist_sql("SELECT * FROM events")}
UNION ALL SELECT *, 'after' AS which FROM {_hist_sql(_AFTER)}""")
def v06(spark, sf):
    e = load_table(spark, sf, "events")
    after = rb.rebalance_continuous(e, "value", -0.5, ["event_id"])
    return ch.distribution_before_after(e, after, "value", numeric=True)


@register("v06_value_counts_before_after", f"""
WITH a AS ({_target_down_sql("documents", "lang", DOC_KEY, -0.5)})
SELECT lang AS value, count(*) AS count, 'before' AS which FROM documents WHERE lang IS NOT NULL GROUP BY lang
UNION ALL SELECT lang, count(*), 'after' FROM a WHERE lang IS NOT NULL GROUP BY lang""")
def v06c(spark, sf):
    d = load_table(spark, sf, "documents")
    return ch.distribution_before_after(d, rb.rebalance_target(d, "lang", -0.5, DOC_KEY), "lang", numeric=False)


@register("v07_radar", f"""{DOC_METRICS}{_AUC},
w AS (SELECT 'by_source' AS algorithm, f1_macro, accuracy, precision_macro, recall_macro,
             coalesce((SELECT avg(auc) FROM auc), 0.0) AS roc_auc FROM summ)
UNPIVOT w ON f1_macro, accuracy, precision_macro, recall_macro, roc_auc INTO NAME metric VALUE value""")
def v07(spark, sf):
    p, classes, pc = _doc_pc(spark, sf)
    summ = mt.summary(pc).withColumn("algorithm", F.lit("by_source"))
    auc = mt.macro_auc(mt.scores_long(p, "lang", "score", classes), len(classes))
    wide = summ.withColumn("roc_auc", F.lit(auc.first()["roc_auc"]).cast("double"))
    return ch.radar(wide)


@register("v08_sweep_chart", f"""WITH {STEPS_SQL}, {_BASE_SQL},
best AS (SELECT run_id, slider AS optimal_value FROM kept
         QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY avg_score DESC, step) = 1),
ba AS (SELECT run_id, avg(score) AS baseline_avg FROM base GROUP BY run_id)
SELECT kept.run_id, step, slider, avg_score, slider = optimal_value AS is_optimum, baseline_avg
FROM kept JOIN best USING (run_id) LEFT JOIN ba USING (run_id)""")
def v08(spark, sf):
    return ch.sweep_chart(event_steps(spark, sf), event_baseline(spark, sf))


@register("v09_step_deltas", f"""WITH {STEPS_SQL}
SELECT run_id, step, slider, delta,
       CASE WHEN delta > 0 THEN 'up' WHEN delta < 0 THEN 'down' ELSE 'flat' END AS direction FROM kept""")
def v09(spark, sf):
    return ch.step_deltas(event_steps(spark, sf))


def curve_table(spark, sf):
    e = load_table(spark, sf, "events")
    d0 = e.agg(F.min(F.to_date("ts"))).first()[0]
    size = ((F.datediff(F.to_date("ts"), F.lit(d0)) + 1) * 10).cast("int")
    split = F.when(F.col("value") >= 50, F.lit("train")).otherwise(F.lit("val"))
    return e.groupBy(_band().alias("algorithm"), size.alias("train_size"), F.col("event_type").alias("fold"),
                     split.alias("split")).agg(F.round(F.avg("value") / F.lit(100.0), 9).alias("f1"))


_CURVE = f"""cv AS (SELECT {_BAND_SQL} AS algorithm,
    ((datediff('day', (SELECT min(CAST(ts AS DATE)) FROM events), CAST(ts AS DATE)) + 1) * 10)::INTEGER AS train_size,
    event_type AS fold, CASE WHEN value >= 50 THEN 'train' ELSE 'val' END AS split,
    round(avg(value) / 100.0, 9) AS f1 FROM events GROUP BY ALL)"""


@register("v10_learning_curve_bands", f"""WITH {_CURVE},
g AS (SELECT algorithm, train_size, split, avg(f1) AS mean, stddev_pop(f1) AS std FROM cv GROUP BY ALL),
l AS (SELECT * FROM g QUALIFY train_size = max(train_size) OVER (PARTITION BY algorithm)),
gp AS (SELECT algorithm, max(CASE WHEN split = 'train' THEN mean END) - max(CASE WHEN split = 'val' THEN mean END)
              AS final_gap FROM l GROUP BY algorithm)
SELECT algorithm, train_size, split, round(mean, 9) AS mean, round(std, 9) AS std, round(final_gap, 9) AS final_gap
FROM g LEFT JOIN gp USING (algorithm)""")
def v10(spark, sf):
    b = ch.learning_curve_bands(curve_table(spark, sf))
    return b.select("algorithm", "train_size", "split", *[F.round(c, 9).alias(c) for c in ("mean", "std", "final_gap")])


@register("v11_train_val_bands", f"""WITH {_DIAG_SRC}
SELECT algorithm, train_f1, val_f1, train_f1 - val_f1 AS gap,
       CASE WHEN train_f1 - val_f1 > 0.05 THEN 'red' WHEN train_f1 - val_f1 < 0.03 THEN 'green' ELSE 'orange' END
         AS band FROM dm""")
def v11(spark, sf):
    return ch.train_val_bands(diag_metrics(spark, sf))


@register("v12_fold_box", f"""WITH {_CURVE},
f AS (SELECT algorithm, fold, round(avg(f1), 9) AS f1 FROM cv GROUP BY ALL)
SELECT algorithm, quantile_cont(f1, 0.0) AS min, quantile_cont(f1, 0.25) AS q1, quantile_cont(f1, 0.5) AS median,
       quantile_cont(f1, 0.75) AS q3, quantile_cont(f1, 1.0) AS max, avg(f1) AS mean FROM f GROUP BY algorithm""")
def v12(spark, sf):
    c = curve_table(spark, sf).groupBy("algorithm", "fold").agg(F.round(F.avg("f1"), 9).alias("f1"))
    return ch.fold_box(c)


@register("v13_diagnosis_bars", f"""WITH {_DIAG_SRC}
SELECT algorithm, metric, value FROM (UNPIVOT (SELECT algorithm, train_f1, val_f1, cv_mean FROM dm)
ON train_f1, val_f1, cv_mean INTO NAME metric VALUE value)""")
def v13(spark, sf):
    return ch.diagnosis_bars(diag_metrics(spark, sf))


@register("v14_gap_lines", f"""WITH {GAP_SQL}
SELECT algo, slider, gap, gap > 0.05 AS above_threshold FROM gp""")
def v14(spark, sf):
    return ch.gap_lines(gap_table(spark, sf))


@register("v15_optimum_summary", f"""WITH {STEPS_SQL}, {_BASE_SQL},
best AS (SELECT run_id, slider AS optimal_value, best_score AS best_f1, best_algo AS best_algorithm, exit_reason
         FROM kept QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY avg_score DESC, step) = 1),
bb AS (SELECT run_id, max(score) AS baseline_best FROM base GROUP BY run_id)
SELECT best.*, baseline_best, best_f1 - baseline_best AS improvement FROM best LEFT JOIN bb USING (run_id)""")
def v15(spark, sf):
    return ch.optimum_summary(event_steps(spark, sf), event_baseline(spark, sf))
