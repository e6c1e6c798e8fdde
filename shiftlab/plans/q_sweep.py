"""Registered queries for the sweep bookkeeping, exit rule, optimum and
diagnosis operators (O02-O12).

Step tables are derived from ``events`` so both engines see the same numbers:
run = event type, step = day index, algorithm = hour band, score = mean value
/ 100 (rounded to 9 decimals to make the float sums engine-independent).
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from shiftlab.operators import models as md
from shiftlab.operators import sweep as sw
from shiftlab.operators.features import FeaturePrep
from shiftlab.operators.smote import ROW_KEY
from shiftlab.plans.q_models import _IMP, EMB_KEY, SMOTE_BASE_SQL, doc_importances, smote_sql
from shiftlab.plans.registry import register
from shiftlab.plans.sqlgen import dbl
from shiftlab.sources.tables import TABLE_KEYS, load_table

BANDS = ["day", "evening", "night"]
DOC_KEY = TABLE_KEYS["documents"]


def _band():
    h = F.hour("ts")
    return F.when(h < 8, F.lit("night")).when(h < 16, F.lit("day")).otherwise(F.lit("evening"))


def event_steps(spark, sf):
    e = load_table(spark, sf, "events")
    d0 = e.agg(F.min(F.to_date("ts"))).first()[0]
    step = F.datediff(F.to_date("ts"), F.lit(d0)).cast("int")
    s = e.groupBy(F.col("event_type").alias("run_id"), step.alias("step"), _band().alias("algorithm")).agg(
        F.round(F.avg("value") / F.lit(100.0), 9).alias("score"), F.count(F.lit(1)).alias("n_samples"))
    return s.withColumn("slider", F.col("step").cast("double") / F.lit(20.0) - F.lit(1.0)).select(
        "run_id", "step", "slider", "algorithm", "score", "n_samples")


def event_baseline(spark, sf):
    e = load_table(spark, sf, "events")
    return e.groupBy(F.col("event_type").alias("run_id"), _band().alias("algorithm")).agg(
        F.round(F.avg("value") / F.lit(100.0), 9).alias("score"))


_BAND_SQL = "CASE WHEN hour(ts) < 8 THEN 'night' WHEN hour(ts) < 16 THEN 'day' ELSE 'evening' END"
STEPS_SQL = f"""
st AS (SELECT event_type AS run_id,
              datediff('day', (SELECT min(CAST(ts AS DATE)) FROM events), CAST(ts AS DATE))::INTEGER AS step,
              {_BAND_SQL} AS algorithm, round(avg(value) / 100.0, 9) AS score, count(*) AS n_samples
       FROM events GROUP BY ALL),
st2 AS (SELECT run_id, step, CAST(step AS DOUBLE) / 20.0 - 1.0 AS slider, algorithm, score, n_samples FROM st),
sm AS (SELECT run_id, step, slider, avg(score) AS avg_score, first(algorithm ORDER BY score DESC, algorithm) AS best_algo,
              max(score) AS best_score, max(n_samples) AS n_samples FROM st2 GROUP BY run_id, step, slider),
bk AS (SELECT *, coalesce(avg_score - lag(avg_score) OVER (PARTITION BY run_id ORDER BY step), 0.0) AS delta,
              avg_score > coalesce(max(avg_score) OVER (PARTITION BY run_id ORDER BY step
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1.0) AS is_best,
              row_number() OVER (PARTITION BY run_id ORDER BY step) AS i FROM sm),
bg AS (SELECT *, sum(is_best::INTEGER) OVER (PARTITION BY run_id ORDER BY step ROWS UNBOUNDED PRECEDING) AS grp FROM bk),
bd AS (SELECT * EXCLUDE (grp), CASE WHEN grp > 0 THEN row_number() OVER (PARTITION BY run_id, grp ORDER BY step) - 1
              ELSE row_number() OVER (PARTITION BY run_id, grp ORDER BY step) END AS declines FROM bg),
ex AS (SELECT *, CASE WHEN i > 1 AND delta < -0.001 AND declines >= 2 THEN 'peak_detected'
                      WHEN i > 1 AND abs(delta) < 0.001 AND declines >= 3 THEN 'plateau' END AS why FROM bd),
cut AS (SELECT run_id, min(step) FILTER (WHERE why IS NOT NULL) AS cut_step,
               coalesce(first(why ORDER BY step) FILTER (WHERE why IS NOT NULL), 'complete') AS exit_reason
        FROM ex GROUP BY run_id),
kept AS (SELECT ex.* EXCLUDE (why, i), cut.exit_reason FROM ex JOIN cut USING (run_id)
         WHERE cut.cut_step IS NULL OR ex.step <= cut.cut_step)"""

_BASE_SQL = f"""base AS (SELECT event_type AS run_id, {_BAND_SQL} AS algorithm, round(avg(value) / 100.0, 9) AS score
         FROM events GROUP BY ALL)"""


@register("o03_step_bookkeeping", f"""WITH {STEPS_SQL}
SELECT run_id, step, slider, avg_score, best_algo, best_score, n_samples, delta, is_best, declines FROM bd""")
def o03(spark, sf):
    b = sw.bookkeeping(sw.step_summary(event_steps(spark, sf)))
    return b.drop("_i")


@register("o04_early_exit", f"""WITH {STEPS_SQL}
SELECT run_id, step, slider, avg_score, best_algo, best_score, n_samples, delta, is_best, declines, exit_reason
FROM kept""")
def o04(spark, sf):
    return sw.trajectory(event_steps(spark, sf))


@register("o05_optimum", f"""WITH {STEPS_SQL}, {_BASE_SQL},
best AS (SELECT run_id, step AS opt_step, slider AS optimal_value, best_algo AS best_algorithm, best_score AS best_f1,
                exit_reason FROM kept QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY avg_score DESC, step) = 1),
gains AS (SELECT s.run_id, s.algorithm, CASE WHEN b.score > 0 THEN s.score - b.score ELSE 0.0 END AS gain
          FROM st2 s JOIN best USING (run_id) LEFT JOIN base b ON b.run_id = s.run_id AND b.algorithm = s.algorithm
          WHERE s.step = best.opt_step)
SELECT best.run_id, optimal_value, best_algorithm, best_f1, exit_reason, avg(gain) AS mean_gain
FROM best LEFT JOIN gains USING (run_id) GROUP BY ALL""")
def o05(spark, sf):
    return sw.optimum(event_steps(spark, sf), event_baseline(spark, sf)).drop("gain_by_algorithm")


@register("o07_trajectory_table", f"""WITH {STEPS_SQL},
wide AS (SELECT run_id, step, max(CASE WHEN algorithm = 'day' THEN score END) AS day_f1,
                max(CASE WHEN algorithm = 'evening' THEN score END) AS evening_f1,
                max(CASE WHEN algorithm = 'night' THEN score END) AS night_f1 FROM st2 GROUP BY run_id, step)
SELECT kept.run_id, kept.step, slider, n_samples, delta, best_algo, best_score, day_f1, evening_f1, night_f1
FROM kept JOIN wide USING (run_id, step)""")
def o07(spark, sf):
    return sw.trajectory_table(event_steps(spark, sf), BANDS)


def gap_table(spark, sf):
    """(slider, algo, train_f1, val_f1, gap) derived from events."""
    e = load_table(spark, sf, "events")
    d0 = e.agg(F.min(F.to_date("ts"))).first()[0]
    step = F.datediff(F.to_date("ts"), F.lit(d0))
    g = e.groupBy((step - 20).cast("double").alias("_s"), _band().alias("algo")).agg(
        F.round(F.max("value") / F.lit(100.0), 9).alias("train_f1"),
        F.round(F.avg("value") / F.lit(100.0), 9).alias("val_f1"))
    return g.select((F.col("_s") / F.lit(20.0)).alias("slider"), "algo", "train_f1", "val_f1",
                    (F.col("train_f1") - F.col("val_f1")).alias("gap"))


GAP_SQL = f"""gp AS (SELECT slider, algo, train_f1, val_f1, train_f1 - val_f1 AS gap FROM (
    SELECT CAST(datediff('day', (SELECT min(CAST(ts AS DATE)) FROM events), CAST(ts AS DATE)) - 20 AS DOUBLE) / 20.0
             AS slider, {_BAND_SQL} AS algo,
           round(max(value) / 100.0, 9) AS train_f1, round(avg(value) / 100.0, 9) AS val_f1
    FROM events GROUP BY ALL))"""


@register("o08_gap_table", f"WITH {GAP_SQL} SELECT * FROM gp")
def o08t(spark, sf):
    return gap_table(spark, sf)


@register("o09_gap_verdict", f"""WITH {GAP_SQL},
up AS (SELECT algo, avg(gap) AS upsample_gap FROM gp WHERE slider > 0 GROUP BY algo),
bz AS (SELECT algo, avg(gap) AS baseline_gap FROM gp WHERE slider = 0 GROUP BY algo)
SELECT up.algo, upsample_gap, coalesce(baseline_gap, 0.0) AS baseline_gap,
       upsample_gap > coalesce(baseline_gap, 0.0) + 0.01 AS widening FROM up LEFT JOIN bz USING (algo)""")
def o09(spark, sf):
    return sw.gap_verdict(gap_table(spark, sf))


def diag_metrics(spark, sf):
    """(algorithm, train_f1, val_f1, cv_mean, cv_std) per event type, all in [0, 1]."""
    e = load_table(spark, sf, "events")
    return e.groupBy(F.col("event_type").alias("algorithm")).agg(
        F.round((F.avg("value") + F.max("value")) / (F.lit(2.0) * F.max("value")), 9).alias("train_f1"),
        F.round(F.avg("value") / F.max("value"), 9).alias("val_f1"),
        F.round(F.min("value") / F.max("value"), 9).alias("cv_mean"),
        F.lit(0.0).alias("cv_std"))


_DIAG_SRC = """dm AS (SELECT event_type AS algorithm,
        round((avg(value) + max(value)) / (2.0 * max(value)), 9) AS train_f1, round(avg(value) / max(value), 9) AS val_f1,
        round(min(value) / max(value), 9) AS cv_mean, CAST(0.0 AS DOUBLE) AS cv_std FROM events GROUP BY event_type)"""


@register("o10_fit_diagnosis", f"""WITH {_DIAG_SRC},
g AS (SELECT *, train_f1 - val_f1 AS gap FROM dm)
SELECT algorithm, train_f1, val_f1, cv_mean, cv_std, gap,
  CASE WHEN train_f1 > 0.95 AND gap > 0.05 THEN 'overfit'
       WHEN train_f1 < 0.7 AND val_f1 < 0.7 THEN 'underfit'
       WHEN gap < 0.03 AND val_f1 > 0.7 THEN 'optimal'
       WHEN gap > 0.03 THEN 'slight_overfit' ELSE 'acceptable' END AS status FROM g""")
def o10(spark, sf):
    return sw.fit_diagnosis(diag_metrics(spark, sf)).drop("explanation")


@register("o10_fit_explanation", f"""WITH {_DIAG_SRC},
g AS (SELECT *, train_f1 - val_f1 AS gap FROM dm)
SELECT algorithm, CASE WHEN train_f1 > 0.95 AND gap > 0.05 THEN 'fits its training rows far better than new ones'
       WHEN train_f1 < 0.7 AND val_f1 < 0.7 THEN 'fits neither training rows nor new ones well'
       WHEN gap < 0.03 AND val_f1 > 0.7 THEN 'does as well on new rows as in training'
       WHEN gap > 0.03 THEN 'loses a little on new rows' ELSE 'holds up on new rows' END
  || ': train ' || printf('%.4f', train_f1) || ', validation ' || printf('%.4f', val_f1) || ', difference ' || printf('%.4f', gap)
  || '; folds ' || printf('%.4f', cv_mean) || ' +/- ' || printf('%.4f', cv_std) AS explanation FROM g""")
def o10_explanation(spark, sf):
    return sw.fit_diagnosis(diag_metrics(spark, sf)).select("algorithm", "explanation")


@register("o11_checklist_cases", f"""WITH {_DIAG_SRC},
gap AS (SELECT algorithm, coalesce(train_f1 - val_f1 > 0.05, false) AS wide FROM dm)
SELECT 'all' AS case_name, count(*) > 0 AS has_learning_curves, count(*) > 0 AS has_cv, bool_or(wide) AS any_gap_over_005,
       true AS has_gap_analysis FROM gap
UNION ALL SELECT 'empty', false, false, false, true
UNION ALL SELECT 'none', false, false, bool_or(wide), false FROM gap
UNION ALL SELECT 'narrow', true, false, false, false""")
def o11_cases(spark, sf):
    """Each flag with and without what it stands for: tables with rows, without rows, and absent ones."""
    diag = sw.fit_diagnosis(diag_metrics(spark, sf)).checkpoint()
    steps = event_steps(spark, sf)
    cases = {"all": (steps, steps, diag, gap_table(spark, sf)), "empty": (steps.limit(0), steps.limit(0), diag.limit(0), gap_table(spark, sf)),
             "none": (None, None, diag, None), "narrow": (steps, None, diag.where("gap <= 0.05"), None)}
    out = None
    for name, parts in cases.items():
        row = sw.checklist(*parts).withColumn("case_name", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


@register("o11_checklist", f"""WITH {_DIAG_SRC}
SELECT true AS has_learning_curves, true AS has_cv,
       coalesce(bool_or(train_f1 - val_f1 > 0.05), false) AS any_gap_over_005, true AS has_gap_analysis FROM dm""")
def o11(spark, sf):
    diag = sw.fit_diagnosis(diag_metrics(spark, sf))
    steps = event_steps(spark, sf)
    return sw.checklist(steps, steps, diag, gap_table(spark, sf))


@register("o12_mean_gain", f"""WITH {STEPS_SQL}, {_BASE_SQL},
best AS (SELECT run_id, step AS opt_step FROM kept
         QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY avg_score DESC, step) = 1),
gains AS (SELECT s.run_id, CASE WHEN b.score > 0 THEN s.score - b.score ELSE 0.0 END AS gain
          FROM st2 s JOIN best USING (run_id) LEFT JOIN base b ON b.run_id = s.run_id AND b.algorithm = s.algorithm
          WHERE s.step = best.opt_step)
SELECT run_id, avg(gain) AS mean_gain FROM gains GROUP BY run_id""")
def o12(spark, sf):
    return sw.optimum(event_steps(spark, sf), event_baseline(spark, sf)).select("run_id", "mean_gain")


@register("o12_in_top5", f"""WITH {_IMP},
rk AS (SELECT method, feature, row_number() OVER (PARTITION BY method ORDER BY importance DESC, feature) AS r FROM imp)
SELECT method, bool_or(feature = 'src3' AND r <= 5) AS in_top_k FROM rk GROUP BY method""")
def o12t(spark, sf):
    return sw.in_top_k(doc_importances(spark, sf), "src3", 5)


O02_GRID = [-0.5, -0.25, 0.0, 0.25, 0.5]
# The sweeps only read these columns; project before the base table is cached.
SWEEP_COLS = ["doc_id", "lang", "source", "n_chars"]


def vm_f1_sql(src: str, on: str = "te", label: str = "lang", column: str = "source", key=DOC_KEY, resampled=None) -> str:
    """Scalar subquery: the value-majority scorer's macro F1 on ``src``, of its test (``te``) or training rows (``tr``).
    Copies are told apart by ``_copy`` where ``src`` has it; ``resampled`` gives the SQL that changes the training part."""
    from shiftlab.plans.q_metrics import metric_sql
    from shiftlab.plans.q_split import quota_sql
    from shiftlab.plans.sqlgen import rank
    target = f"ceil({dbl(0.2)} * (SELECT count(*) FROM src))::BIGINT"
    key = [*key, "_copy"] if " AS _copy" in src else key
    train = "s WHERE split = 'train'" if resampled is None else f"({resampled("(SELECT * FROM s WHERE split = 'train')")})"
    preds = f"""
src AS (SELECT *, {column} AS v FROM ({src})),
q AS {quota_sql("SELECT * FROM src", label, target)},
r AS (SELECT d.*, {rank([label], key)} AS rk FROM src d),
s AS (SELECT r.* EXCLUDE (rk), CASE WHEN rk < q THEN 'test' ELSE 'train' END AS split FROM r JOIN q USING ({label})),
tr AS (SELECT *, row_number() OVER () AS rid FROM {train}),
te AS (SELECT *, row_number() OVER () AS rid FROM s WHERE split = 'test'),
cls AS (SELECT DISTINCT {label} AS class FROM src WHERE {label} IS NOT NULL),
cnt AS (SELECT v, {label} AS class, count(*) AS c FROM tr GROUP BY ALL),
tot AS (SELECT v, sum(c) AS nv FROM cnt GROUP BY v),
pri AS (SELECT {label} AS class, count(*) / (SELECT count(*) FROM tr) AS p FROM tr GROUP BY {label}),
sc AS (SELECT x.rid, x.{label} AS y_true, cls.class,
              CASE WHEN tot.nv IS NULL THEN coalesce(pri.p, 0.0) ELSE coalesce(cnt.c, 0) / tot.nv END AS score
       FROM {on} AS x JOIN cls ON TRUE LEFT JOIN tot ON tot.v = x.v
       LEFT JOIN cnt ON cnt.v = x.v AND cnt.class = cls.class
       LEFT JOIN pri ON pri.class = cls.class),
pr AS (SELECT rid, y_true, first(class ORDER BY score DESC, class) AS y_pred FROM sc GROUP BY rid, y_true)"""
    return f"(WITH {metric_sql(preds).lstrip()} SELECT round(f1_macro, 12) FROM summ)"


def _rebalanced_sql(slider: float, table: str = "documents") -> str:
    """A step's table, with the number of each copy where it was resampled."""
    from shiftlab.plans.q_rebalance import _target_down_sql, _target_up_sql
    if abs(slider) < 0.01:
        return f"SELECT * FROM {table}"
    if slider > 0:
        return _target_up_sql(table, "lang", DOC_KEY, slider, (), "_copy")
    return f"SELECT *, 0::BIGINT AS _copy FROM ({_target_down_sql(table, 'lang', DOC_KEY, slider)})"


def _continuous_sql(column: str, slider: float) -> str:
    from shiftlab.plans.q_rebalance import _two_group_sql
    if abs(slider) < 0.01:
        return "SELECT * FROM documents"
    med = f"(SELECT median({column}) FROM documents)"
    if slider > 0:
        quota = f"greatest(floor({{g}} * (1 + {dbl(slider)} * 2))::BIGINT, {{g}})"
    else:
        quota = f"greatest(floor({{g}} * (1 - {dbl(abs(slider))} * 0.8))::BIGINT, 1)"
    return _two_group_sql("documents", f"{column} > {med}", f"{column} <= {med}", DOC_KEY, quota, slider > 0, "_copy")


def _sweep_sql(runs: list[tuple[str, object]], grid: list[float], algorithm: str = "by_source", **scorer) -> str:
    """Every step of every run in SQL, then the same bookkeeping, exit rule and optimum."""
    parts = []
    for run_id, src_of in runs:
        for i, sv in enumerate(grid):
            src = src_of(sv)
            parts.append(f"SELECT '{run_id}' AS run_id, {i} AS step, {dbl(sv)} AS slider, '{algorithm}' AS algorithm, "
                         f"{vm_f1_sql(src, **scorer)} AS score, (SELECT count(*) FROM ({src})) AS n_samples")
    steps = "\nUNION ALL\n".join(parts)
    book = STEPS_SQL[STEPS_SQL.index("sm AS"):]
    bases = " UNION ALL ".join(f"SELECT '{r}' AS run_id, '{algorithm}' AS algorithm, {vm_f1_sql(src_of(0.0), **scorer)} AS score"
                               for r, src_of in runs)
    return f"""WITH st2 AS ({steps}),
{book},
base AS ({bases}),
best AS (SELECT run_id, step AS opt_step, slider AS optimal_value, best_algo AS best_algorithm, best_score AS best_f1,
                exit_reason FROM kept QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY avg_score DESC, step) = 1),
gains AS (SELECT s.run_id, CASE WHEN b.score > 0 THEN s.score - b.score ELSE 0.0 END AS gain
          FROM st2 s JOIN best USING (run_id) LEFT JOIN base b ON b.run_id = s.run_id AND b.algorithm = s.algorithm
          WHERE s.step = best.opt_step)
SELECT best.run_id, optimal_value, best_algorithm, best_f1, exit_reason, avg(gain) AS mean_gain
FROM best LEFT JOIN gains USING (run_id) GROUP BY ALL"""


def _o02_sql() -> str:
    return _sweep_sql([("lang:target", _rebalanced_sql)], O02_GRID)


O06_GRID = [-0.5, 0.0, 0.5]


@register("o02_sweep_value_majority", _o02_sql())
def o02(spark, sf):
    """A real sweep: rebalance documents by language, score by source (exact SQL twin)."""
    d = load_table(spark, sf, "documents").select(*SWEEP_COLS)
    scorer = sw.value_majority_scorer("source", "lang", DOC_KEY)
    steps, base = sw.run_sweep(d, "lang", "target", scorer, DOC_KEY, grid=O02_GRID)
    return sw.optimum(steps, base).drop("gain_by_algorithm")


@register("o06_multi_column_sweep", _sweep_sql(
    [("lang", _rebalanced_sql), ("n_chars", lambda sv: _continuous_sql("n_chars", sv))], O06_GRID))
def o06(spark, sf):
    d = load_table(spark, sf, "documents").select(*SWEEP_COLS)
    scorer = sw.value_majority_scorer("source", "lang", DOC_KEY)
    steps, base = sw.run_multi(d, [("lang", "target"), ("n_chars", "continuous")], scorer, DOC_KEY,
                               grid=O06_GRID)
    return sw.optimum(steps, base).drop("gain_by_algorithm")


def _train_scope_sql() -> str:
    """The sweep with only the training part resampled: the split and the step's size are the base's."""
    steps = "\nUNION ALL\n".join(
        f"SELECT 'lang:target' AS run_id, {i} AS step, {dbl(s)} AS slider, 'by_source' AS algorithm, "
        f"{vm_f1_sql('SELECT * FROM documents', resampled=lambda t, s=s: _rebalanced_sql(s, t))} AS score, "
        "(SELECT count(*) FROM documents) AS n_samples" for i, s in enumerate(O02_GRID))
    return (f"WITH st2 AS ({steps}), {STEPS_SQL[STEPS_SQL.index('sm AS'):]} "
            "SELECT run_id, step, slider, avg_score, n_samples, exit_reason FROM kept")


@register("o02_sweep_train_scope", _train_scope_sql())
def o02_train_scope(spark, sf):
    """A sweep without leakage: split first, resample the training part."""
    d = load_table(spark, sf, "documents").select(*SWEEP_COLS)
    scorer = sw.value_majority_scorer("source", "lang", DOC_KEY)
    steps, _ = sw.run_sweep(d, "lang", "target", scorer, DOC_KEY, grid=O02_GRID, resample_scope="train")
    return sw.trajectory(steps).select("run_id", "step", "slider", "avg_score", "n_samples", "exit_reason")


@register("o02_sweep_speculative", _o02_sql())
def o02_speculative(spark, sf):
    """The same sweep with three steps side by side: the same result."""
    d = load_table(spark, sf, "documents").select(*SWEEP_COLS)
    scorer = sw.value_majority_scorer("source", "lang", DOC_KEY)
    steps, base = sw.run_sweep(d, "lang", "target", scorer, DOC_KEY, grid=O02_GRID, speculate=3)
    return sw.optimum(steps, base).drop("gain_by_algorithm")


SMOTE_GRID = [-0.5, 0.0, 0.5, 1.0]
SMOTE_GAP_SLIDERS = [-0.5, 0.0, 0.5]
# The value-majority scorer of encoded rows: by the first coordinate, in sixteenths.
SMOTE_BIN = "floor(embedding[1] * 16)"


def _smote_rows_sql(slider: float) -> str:
    if abs(slider) < 0.01:
        return SMOTE_BASE_SQL
    if slider < 0:
        from shiftlab.plans.q_rebalance import _target_down_sql
        return _target_down_sql(f"({SMOTE_BASE_SQL})", "label", ["row_key"], slider)
    return smote_sql(slider)


def _embeddings(spark, sf):
    return load_table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"), "embedding")


@register("o02_sweep_smote", _sweep_sql([("label:target", _smote_rows_sql)], SMOTE_GRID, "by_bin", label="label",
                                        column=SMOTE_BIN, key=["row_key"]))
def o02_smote(spark, sf):
    """SMOTE up, random under-sampling down, in the space of the vectors; neighbours are found once."""
    scorer = sw.value_majority_scorer("bin", "label", [ROW_KEY], of=F.floor(F.col("embedding")[0] * 16))
    steps, base = sw.run_sweep(_embeddings(spark, sf), "label", "target", scorer, EMB_KEY, grid=SMOTE_GRID,
                               use_smote=True, smote_features="embedding")
    return sw.optimum(steps, base).drop("gain_by_algorithm")


def _gap_sql(algorithm: str, src_of, sliders: list[float], **scorer) -> str:
    rows = " UNION ALL ".join(f"SELECT {dbl(s)} AS slider, {vm_f1_sql(src_of(s), 'tr', **scorer)} AS train_f1, "
                              f"{vm_f1_sql(src_of(s), 'te', **scorer)} AS val_f1" for s in sliders)
    return f"SELECT slider, '{algorithm}' AS algo, train_f1, val_f1, round(train_f1 - val_f1, 12) AS gap FROM ({rows})"


def _rounded_gaps(gaps):
    return gaps.select("slider", "algo", *(F.round(c, 12).alias(c) for c in ("train_f1", "val_f1", "gap")))


GAP_SLIDERS = [-0.5, 0.0, 0.5]


@register("o08_gap_value_majority", _gap_sql("by_source", _rebalanced_sql, GAP_SLIDERS))
def o08_value_majority(spark, sf):
    """Train and validation F1 of the value-majority model through the whole loop, on rebalanced documents."""
    d = load_table(spark, sf, "documents").withColumn("src", F.col("source"))
    prep = FeaturePrep(label="lang", categorical=["source"], numeric=["n_chars"], keep=["doc_id", "src"])
    return _rounded_gaps(sw.gap_analysis(d, "lang", "target", prep, DOC_KEY, GAP_SLIDERS,
                                         algorithms=md.value_majority("by_source", F.col("src")), max_samples=1 << 40, cv_folds=0))


@register("o08_gap_smote", _gap_sql("by_bin", _smote_rows_sql, SMOTE_GAP_SLIDERS, label="label", column=SMOTE_BIN, key=["row_key"]))
def o08_smote(spark, sf):
    """The gap analysis with SMOTE in the encoded space: the coordinates as numeric features, not scaled."""
    e = _embeddings(spark, sf)
    d = e.select(F.size("embedding").alias("d")).first()["d"]
    names = [f"e{i}" for i in range(d)]
    wide = e.select("vec_id", "label", *(F.col("embedding")[i].alias(n) for i, n in enumerate(names)))
    prep = FeaturePrep(label="label", numeric=names, keep=["vec_id"], scale=False)
    first = vector_to_array(F.col(prep.features_col))[0]
    return _rounded_gaps(sw.gap_analysis(wide, "label", "target", prep, EMB_KEY, SMOTE_GAP_SLIDERS, use_smote=True, cv_folds=0,
                                         algorithms=md.value_majority("by_bin", F.floor(first * 16)), max_samples=1 << 40))



def _doc_prep():
    return FeaturePrep(label="lang", categorical=["source"], numeric=["n_chars"], keep=["doc_id"])


def _light_forest():
    return md.default_algorithms(rf_trees=10, rf_depth=5)


@register("o08_gap_analysis")
def o08(spark, sf):
    """Train/validation F1 gaps of a forest at two sliders (3-fold CV inside)."""
    d = load_table(spark, sf, "documents")
    return sw.gap_analysis(d, "lang", "target", _doc_prep(), DOC_KEY, [0.0, 0.5],
                           algorithms=_light_forest(), selected=["Random Forest"])


@register("o02_sweep_mllib")
def o02m(spark, sf):
    """A sweep scored by the quick MLlib loop (feature prep + stratified cap + forest)."""
    d = load_table(spark, sf, "documents").select(*SWEEP_COLS)
    scorer = sw.mllib_scorer(_doc_prep(), DOC_KEY, algorithms=_light_forest(), selected=["Random Forest"])
    steps, base = sw.run_sweep(d, "lang", "target", scorer, DOC_KEY, grid=[-0.5, 0.0, 0.5])
    return sw.trajectory(steps)
