"""Registered queries for SMOTE (R13), classifiers and the loop (M02-M10), and
feature importance (P01-P05) on ``embeddings``.

Model fits are iterative, so their queries are rows-only (no oracle).  M02-M04 run at
the library defaults, which follow the reference (100 boosting rounds of depth 6, 300 net
iterations at most, 100 trees of depth 10); M05 runs 50 of 5,000 SVM iterations, and the
loops M06-M10 the lighter settings below, to keep the correctness run short.  The loops
are exact SQL with the value-majority model in ``q_loop``; SMOTE and the rank aggregation
are exact SQL here.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from shiftlab.operators import importance as im
from shiftlab.operators import models as md
from shiftlab.operators import shap as sh
from shiftlab.operators import smote as sm
from shiftlab.plans.registry import register
from shiftlab.sources.tables import load_table

EMB_KEY = ["vec_id"]
LIGHT = dict(gbt_rounds=10, mlp_iter=30, mlp_watch=0.0, rf_trees=20, svm_iter=50, rf_depth=5)
ALL = ["Boosted Trees", "MLP", "Random Forest", "SVM"]


def embeddings(spark, sf):
    e = load_table(spark, sf, "embeddings")
    return e.select("vec_id", F.col("label").cast("string").alias("label"),
                    array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


def emb_names(spark, sf) -> list[str]:
    d = load_table(spark, sf, "embeddings").select(F.size("embedding").alias("d")).first()["d"]
    return [f"e{i}" for i in range(int(d))]


def _loop(spark, sf, selected, settings=LIGHT, strict=True, **kw):
    """The loop; a part that failed is an error, as the queries return no ``failed``."""
    algos = md.default_algorithms(**settings)
    return md.run_loop(embeddings(spark, sf), "label", "features", EMB_KEY, algos, selected, strict=strict, **kw)


SMOTE_BASE_SQL = "SELECT label, CAST(embedding AS DOUBLE[]) AS embedding, CAST(vec_id AS VARCHAR) AS row_key FROM embeddings"


def smote_sql(slider: float) -> str:
    """SMOTE of ``embeddings`` at a slider above 0."""
    return f"""
WITH b AS ({SMOTE_BASE_SQL}),
c AS (SELECT label, count(*) AS n FROM b GROUP BY label),
t AS (SELECT floor(min(n) + (max(n) - min(n)) * CAST({float(slider)!r} AS DOUBLE))::BIGINT AS t,
             greatest(least(5, min(n) - 1), 1) AS k FROM c),
need AS (SELECT c.label, t.t - c.n AS q FROM c JOIN t ON c.n < t.t),
nb0 AS (SELECT a.label, a.row_key AS qkey, o.row_key AS nkey, list_distance(a.embedding, o.embedding) AS dist
        FROM b a JOIN b o ON a.label = o.label AND a.row_key <> o.row_key
        WHERE a.label IN (SELECT label FROM need)),
nb AS (SELECT qkey, nkey, row_number() OVER (PARTITION BY label, qkey ORDER BY dist, nkey) - 1 AS nn FROM nb0
       QUALIFY nn < (SELECT k FROM t)),
kk AS (SELECT qkey, count(*) AS kq FROM nb GROUP BY qkey),
r AS (SELECT b.*, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', '42', row_key)), row_key) - 1
             AS rk FROM b WHERE label IN (SELECT label FROM need)),
dj AS (SELECT label, unnest(range(q)) AS j FROM need),
dd AS (SELECT dj.label, dj.j, (('0x' || substr(md5(concat_ws('|', '42', dj.label, dj.j)), 1, 15))::BIGINT % c.n) AS rk
       FROM dj JOIN c USING (label)),
pk AS (SELECT r.label, r.embedding, r.row_key, dd.j FROM r JOIN dd USING (label, rk)),
ch AS (SELECT pk.*, (('0x' || substr(md5(concat_ws('|', '42', pk.label, pk.j, 'nn')), 1, 15))::BIGINT % kk.kq) AS nn,
              ('0x' || substr(md5(concat_ws('|', '42', pk.label, pk.j, 'gap')), 1, 15))::BIGINT
                / CAST(1152921504606846976 AS DOUBLE) AS gap
       FROM pk JOIN kk ON kk.qkey = pk.row_key),
syn AS (SELECT ch.label, list_transform(list_zip(ch.embedding, v.embedding), lambda p: p[1] + ch.gap * (p[2] - p[1]))
               AS embedding, 'smote|' || ch.label || '|' || ch.j AS row_key, true AS synthetic
        FROM ch JOIN nb ON nb.qkey = ch.row_key AND nb.nn = ch.nn JOIN b v ON v.row_key = nb.nkey)
SELECT label, embedding, row_key, false AS synthetic FROM b
UNION ALL SELECT label, embedding, row_key, synthetic FROM syn
"""


@register("r13_smote", smote_sql(0.5))
def r13(spark, sf):
    e = load_table(spark, sf, "embeddings")
    return sm.smote(e, "embedding", "label", 0.5, EMB_KEY)


@register("r13_smote_knn", """
WITH b AS (SELECT label, CAST(embedding AS DOUBLE[]) AS v, CAST(vec_id AS VARCHAR) AS k FROM embeddings),
d AS (SELECT CAST(a.label AS VARCHAR) AS cls, a.k AS qkey, o.k AS nkey, list_distance(a.v, o.v) AS dist
      FROM b a JOIN b o ON a.label = o.label AND a.k <> o.k)
SELECT cls, qkey, nkey, row_number() OVER (PARTITION BY cls, qkey ORDER BY dist, nkey) - 1 AS nn FROM d
QUALIFY nn < 5""")
def r13k(spark, sf):
    e = load_table(spark, sf, "embeddings")
    return sm.exact_knn(e, "label", "embedding", "vec_id", 5).select("cls", "qkey", "nkey", "nn")


@register("m02_boosted_trees")
def m02(spark, sf):
    return _loop(spark, sf, ["Boosted Trees"], {}, cv_folds=0).metrics


@register("m03_neural_net")
def m03(spark, sf):
    return _loop(spark, sf, ["MLP"], {}, cv_folds=0).metrics


@register("m04_random_forest")
def m04(spark, sf):
    return _loop(spark, sf, ["Random Forest"], {}, cv_folds=0).metrics


@register("m05_rff_svm")
def m05(spark, sf):
    return _loop(spark, sf, ["SVM"], cv_folds=0).metrics


@register("m06_train_eval_loop")
def m06(spark, sf):
    """All four algorithms, side by side; a part that failed is a row of its own."""
    res = _loop(spark, sf, ALL, LIGHT | {"svm_probability": False, "svm_iter": 20}, strict=False, cv_folds=2, parallel=4)
    failed = [(name, "failed", None) for name in res.failed]
    return res.metrics.unionByName(spark.createDataFrame(failed, res.metrics.schema)) if failed else res.metrics


@register("m06_confusion_by_algorithm")
def m06c(spark, sf):
    return _loop(spark, sf, ["Random Forest"], cv_folds=0).confusion


@register("m07_quick_loop")
def m07(spark, sf):
    algos = md.default_algorithms(**LIGHT)
    return md.quick_scores(embeddings(spark, sf), "label", "features", EMB_KEY, algos,
                           ["Random Forest", "MLP"])


@register("m07_quick_loop_all")
def m07_all(spark, sf):
    """All four algorithms side by side, scores only."""
    algos = md.default_algorithms(**LIGHT | {"svm_probability": False, "svm_iter": 20})
    return md.quick_scores(embeddings(spark, sf), "label", "features", EMB_KEY, algos, ALL, parallel=4)


@register("m08_cross_validation")
def m08(spark, sf):
    return _loop(spark, sf, ["Random Forest"], cv_folds=5).cv


@register("m09_learning_curve")
def m09(spark, sf):
    """24 fits, up to eight side by side: one alone is a chain of jobs that leaves most cores idle."""
    return _loop(spark, sf, ["Random Forest"], cv_folds=0, learning_curves=True, parallel=md.FITS_AT_ONCE).curve


@register("m10_train_val_gap")
def m10(spark, sf):
    return md.train_val_gap(_loop(spark, sf, ["Random Forest"], cv_folds=3).metrics)


@register("p01_gini_importance")
def p01(spark, sf):
    return im.gini_importance(embeddings(spark, sf), "label", "features", emb_names(spark, sf))


@register("p02_permutation_importance")
def p02(spark, sf):
    return im.permutation_importance(embeddings(spark, sf), "label", "features", emb_names(spark, sf),
                                     EMB_KEY, n_repeats=10, trees=20, depth=10)


@register("p03_shap_importance")
def p03(spark, sf):
    return sh.shap_importance(embeddings(spark, sf), "label", "features", emb_names(spark, sf), EMB_KEY, trees=20, depth=5)


@register("p04_all_importances")
def p04(spark, sf):
    x, names = embeddings(spark, sf), emb_names(spark, sf)
    return im.all_importances({
        "gini": im.gini_importance(x, "label", "features", names, trees=20),
        "permutation": im.permutation_importance(x, "label", "features", names, EMB_KEY, n_repeats=3, trees=20),
        "shap": sh.shap_importance(x, "label", "features", names, EMB_KEY, trees=10, depth=5),
    })


_IMP = """imp AS (SELECT lang AS method, source AS feature, avg(n_chars) AS importance
        FROM documents WHERE lang IS NOT NULL GROUP BY lang, source)"""


def doc_importances(spark, sf):
    d = load_table(spark, sf, "documents").where(F.col("lang").isNotNull())
    return d.groupBy(F.col("lang").alias("method"), F.col("source").alias("feature")).agg(
        F.avg("n_chars").alias("importance"))


@register("p05_top_features", f"""
WITH {_IMP},
rk AS (SELECT method, feature, row_number() OVER (PARTITION BY method ORDER BY importance DESC, feature) AS r FROM imp),
nm AS (SELECT max(c) AS n FROM (SELECT method, count(*) AS c FROM imp GROUP BY method)),
ms AS (SELECT DISTINCT method FROM imp),
fs AS (SELECT DISTINCT feature FROM imp),
g AS (SELECT fs.feature, ms.method, coalesce(rk.r, (SELECT n FROM nm)) AS r FROM fs JOIN ms ON TRUE
      LEFT JOIN rk ON rk.feature = fs.feature AND rk.method = ms.method),
w AS (SELECT feature,
             max(CASE WHEN method = 'de' THEN r END) AS de_rank, max(CASE WHEN method = 'en' THEN r END) AS en_rank,
             max(CASE WHEN method = 'es' THEN r END) AS es_rank, max(CASE WHEN method = 'fr' THEN r END) AS fr_rank,
             sum(r) / (SELECT count(*) FROM ms) AS avg_rank FROM g GROUP BY feature)
SELECT * FROM w ORDER BY avg_rank, feature LIMIT 10""")
def p05(spark, sf):
    return im.top_features(doc_importances(spark, sf), 10)


@register("m01_label_encoding", """
SELECT doc_id, lang, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS DOUBLE) AS label_idx,
       lang AS decoded FROM documents WHERE lang IS NOT NULL""")
def m01(spark, sf):
    d = load_table(spark, sf, "documents").select("doc_id", "lang")
    indexer, classes = md.label_indexer(d, "lang")
    enc = indexer.transform(d).withColumnRenamed(md.LABEL_IDX, "label_idx")
    return md.decode(enc, classes, col="label_idx", out="decoded")
