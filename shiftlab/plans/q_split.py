"""Registered queries for stratified subsample, split, folds and prefixes."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftlab.operators import rebalance as rb
from shiftlab.operators import split as sp
from shiftlab.plans.registry import register
from shiftlab.plans.sqlgen import dbl, rank
from shiftlab.sources.tables import TABLE_KEYS, load_table

DOC_KEY = TABLE_KEYS["documents"]


def quota_sql(src: str, label: str, target: str) -> str:
    """CTE body: per class quota by largest remainder of ``n * target / total``."""
    return f"""(
  WITH c AS (SELECT {label}, count(*) AS n FROM ({src}) GROUP BY {label}),
  tt AS (SELECT sum(n) AS total, {target} AS target FROM c),
  b AS (SELECT {label}, n, (n * target) // total AS base, (n * target) % total AS rem, target FROM c, tt)
  SELECT {label}, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, {label})
                               <= target - (SELECT sum(base) FROM b) THEN 1 ELSE 0 END AS q FROM b)"""


_SPLIT = f"""
WITH q AS {quota_sql("SELECT * FROM documents", "lang", f"ceil({dbl(0.2)} * (SELECT count(*) FROM documents))::BIGINT")},
r AS (SELECT d.*, {rank(["lang"], DOC_KEY)} AS rk FROM documents d)
SELECT r.* EXCLUDE (rk), CASE WHEN rk < q THEN 'test' ELSE 'train' END AS split FROM r JOIN q USING (lang)
"""


_LABELLED = "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)"


@register("s02_split_missing_labels", f"""
WITH x AS (SELECT * FROM ({_LABELLED}) WHERE quality IS NOT NULL),
q AS {quota_sql("SELECT * FROM x", "quality", f"ceil({dbl(0.2)} * (SELECT count(*) FROM x))::BIGINT")},
r AS (SELECT x.*, {rank(["quality"], DOC_KEY)} AS rk FROM x)
SELECT r.* EXCLUDE (rk), CASE WHEN rk < q THEN 'test' ELSE 'train' END AS split FROM r JOIN q USING (quality)
""")
def s02_missing(spark, sf):
    """Documents of which many have no label."""
    labels = load_table(spark, sf, "labels").select("doc_id", "quality")
    return sp.train_test_split(load_table(spark, sf, "documents").select("doc_id").join(labels, "doc_id", "left"),
                               "quality", DOC_KEY)


def _copies_split_sql() -> str:
    from shiftlab.plans.q_rebalance import _target_up_sql
    key = [*DOC_KEY, "_copy"]
    return f"""
WITH x AS ({_target_up_sql("documents", "lang", DOC_KEY, 1.0, (), "_copy")}),
q AS {quota_sql("SELECT * FROM x", "lang", f"ceil({dbl(0.2)} * (SELECT count(*) FROM x))::BIGINT")},
r AS (SELECT x.*, {rank(["lang"], key)} AS rk FROM x)
SELECT doc_id, _copy, CASE WHEN rk < q THEN 'test' ELSE 'train' END AS split FROM r JOIN q USING (lang)"""


@register("s02_split_of_copies", _copies_split_sql())
def s02_copies(spark, sf):
    """Up-sampled documents: a row's copies fall on both sides of the split."""
    x = rb.rebalance_target(load_table(spark, sf, "documents"), "lang", 1.0, DOC_KEY, copy_col=rb.COPY)
    return sp.train_test_split(x, "lang", [*DOC_KEY, rb.COPY]).select("doc_id", rb.COPY, "split")


@register("s01_stratified_subsample", f"""
WITH q AS {quota_sql("SELECT * FROM documents", "lang", "500")},
r AS (SELECT d.*, {rank(["lang"], DOC_KEY)} AS rk FROM documents d)
SELECT r.* EXCLUDE (rk) FROM r JOIN q USING (lang) WHERE rk < q
""")
def s01(spark, sf):
    return sp.stratified_subsample(load_table(spark, sf, "documents"), "lang", 500, DOC_KEY)


@register("s01_stratified_subsample_noop", "SELECT * FROM labels")
def s01n(spark, sf):
    return sp.stratified_subsample(load_table(spark, sf, "labels"), "toxic", 10_000_000, DOC_KEY)


@register("s02_train_test_split", f"SELECT doc_id, lang, split FROM ({_SPLIT})")
def s02(spark, sf):
    return sp.train_test_split(load_table(spark, sf, "documents"), "lang", DOC_KEY).select(
        "doc_id", "lang", "split")


_FOLDS = f"""
WITH s AS ({_SPLIT}),
t AS (SELECT * FROM s WHERE split = 'train'),
k AS (SELECT least(5, min(n)) AS k FROM (SELECT lang, count(*) AS n FROM t GROUP BY lang))
SELECT doc_id, lang, ({rank(["lang"], DOC_KEY)} % (SELECT k FROM k))::INTEGER AS fold FROM t
"""


@register("s03_stratified_folds", _FOLDS)
def s03(spark, sf):
    d = sp.train_test_split(load_table(spark, sf, "documents"), "lang", DOC_KEY)
    tr = d.where(F.col("split") == "train")
    out, _ = sp.stratified_folds(tr, "lang", DOC_KEY, folds=5)
    return out.select("doc_id", "lang", "fold")


@register("s04_learning_curve_prefixes", f"""
WITH s AS ({_SPLIT}),
t AS (SELECT * FROM s WHERE split = 'train'),
k AS (SELECT least(3, min(n)) AS k FROM (SELECT lang, count(*) AS n FROM t GROUP BY lang)),
f AS (SELECT doc_id, lang, ({rank(["lang"], DOC_KEY)} % (SELECT k FROM k))::INTEGER AS fold FROM t),
x AS (SELECT f.*, cv.cv_fold FROM f, (SELECT range::INTEGER AS cv_fold FROM range((SELECT k FROM k))) cv
      WHERE cv.cv_fold <> f.fold)
SELECT doc_id, cv_fold, {rank(["cv_fold"], DOC_KEY)} AS pos FROM x
""")
def s04(spark, sf):
    d = sp.train_test_split(load_table(spark, sf, "documents"), "lang", DOC_KEY)
    tr = d.where(F.col("split") == "train")
    folded, k = sp.stratified_folds(tr, "lang", DOC_KEY, folds=3)
    return sp.fold_train_positions(folded, "fold", k, DOC_KEY).select("doc_id", "cv_fold", "pos")
