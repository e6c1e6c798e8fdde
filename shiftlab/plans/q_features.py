"""Registered queries for feature preparation (F01-F08) and the dataset KPIs."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftlab.operators import features as fe
from shiftlab.plans.registry import register
from shiftlab.sources.tables import load_table

# Valid classes for the part preset (PROMO is left out on purpose, so F01 filters).
PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "SMALL", "STANDARD"]
PART_PREP = fe.FeaturePrep(
    label="p_type", categorical=["p_brand_group"], numeric=["p_size", "p_retailprice"],
    valid_labels=PART_TYPES, fold={"p_brand": ("p_brand_group", 20)}, keep=["p_partkey"])
DIGITS = 9

_IN = ", ".join(f"'{t}'" for t in PART_TYPES)
_D = f"SELECT * FROM part WHERE p_type IN ({_IN})"
_TOP = ("SELECT p_brand FROM d WHERE p_brand IS NOT NULL GROUP BY p_brand "
        "ORDER BY count(*) DESC, p_brand LIMIT 20")
_G = f"""
WITH d AS ({_D}), top AS ({_TOP}),
g AS (SELECT p_partkey, p_type, coalesce(TRY_CAST(p_size::VARCHAR AS DOUBLE), 0.0) AS p_size,
             coalesce(TRY_CAST(p_retailprice::VARCHAR AS DOUBLE), 0.0) AS p_retailprice,
             CASE WHEN p_brand IN (SELECT p_brand FROM top) THEN p_brand ELSE 'OTHER' END AS p_brand_group
      FROM d),
st AS (SELECT avg(p_size) AS m1, stddev_pop(p_size) AS s1, avg(p_retailprice) AS m2,
              stddev_pop(p_retailprice) AS s2 FROM g)"""


def _sd(s: str) -> str:
    return f"(CASE WHEN {s} IS NULL OR {s} = 0 THEN 1.0 ELSE {s} END)"


@register("f01_valid_labels", f"SELECT p_partkey, p_type FROM part WHERE p_type IN ({_IN})")
def f01(spark, sf):
    return fe.keep_valid_labels(load_table(spark, sf, "part"), "p_type", PART_TYPES).select(
        "p_partkey", "p_type")


@register("f02_top_n_fold", f"""
WITH d AS ({_D}), top AS ({_TOP})
SELECT p_partkey, CASE WHEN p_brand IN (SELECT p_brand FROM top) THEN p_brand ELSE 'OTHER' END AS p_brand_group
FROM d""")
def f02(spark, sf):
    d = fe.keep_valid_labels(load_table(spark, sf, "part"), "p_type", PART_TYPES)
    keep = fe.top_values(d, "p_brand", 20)
    return d.select("p_partkey", fe.fold_top_n("p_brand", keep).alias("p_brand_group"))


_DL = "SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)"


@register("f03_fill_category", f"""
SELECT doc_id, coalesce(CAST(toxic AS VARCHAR), 'UNKNOWN') AS toxic_cat FROM ({_DL})""")
def f03(spark, sf):
    d = load_table(spark, sf, "documents").join(load_table(spark, sf, "labels"), "doc_id", "left")
    return d.select("doc_id", fe.fill_category("toxic").alias("toxic_cat"))


@register("f04_numeric_coercion", f"""
SELECT doc_id, coalesce(TRY_CAST(CAST(quality AS VARCHAR) AS DOUBLE), 0.0) AS quality,
       coalesce(TRY_CAST(CAST(toxic AS VARCHAR) AS DOUBLE)::BIGINT, 0) AS toxic,
       coalesce(TRY_CAST(lang AS DOUBLE), 0.0) AS lang_num,
       CASE WHEN doc_id % 3 = 0 THEN 0 WHEN doc_id % 3 = 1 THEN 3000000000 + doc_id ELSE coalesce(trunc(quality / 2.0)::BIGINT, 0) END AS odd_flag
FROM ({_DL}) JOIN documents USING (doc_id)""")
def f04(spark, sf):
    docs = load_table(spark, sf, "documents")
    d = docs.join(load_table(spark, sf, "labels"), "doc_id", "left")
    # Text "nan" and "inf", values beyond int, and halves.
    odd = (F.when(F.col("doc_id") % 6 == 0, F.lit("nan")).when(F.col("doc_id") % 3 == 0, F.lit("inf"))
           .when(F.col("doc_id") % 3 == 1, (F.col("doc_id") + 3_000_000_000).cast("string"))
           .otherwise((F.col("quality") / 2.0).cast("string")))
    return d.select(
        "doc_id", fe.coerce_double("quality").alias("quality"),
        fe.coerce_flag("toxic").alias("toxic"),
        fe.coerce_double("lang").alias("lang_num"), fe.coerce_flag(odd).alias("odd_flag"))


def _long(fitted, df):
    wide = fitted.transform(df, assemble=False)
    names = fitted.feature_names
    vals = [F.col(f"`{n}`").cast("double").alias(n) for n in names]
    w = wide.select("p_partkey", "p_type", *vals)
    long = w.unpivot(["p_partkey", "p_type"], names, "feature", "value")
    return long.withColumn("value", F.round("value", DIGITS))


@register("f05_one_hot", f"""{_G},
lv AS (SELECT DISTINCT p_brand_group AS lvl FROM g)
SELECT p_partkey, 'p_brand_group_' || lvl AS feature, CASE WHEN p_brand_group = lvl THEN 1 ELSE 0 END AS value
FROM g, lv""")
def f05(spark, sf):
    part = load_table(spark, sf, "part")
    prep = fe.FeaturePrep(label="p_type", categorical=["p_brand_group"], valid_labels=PART_TYPES,
                          fold={"p_brand": ("p_brand_group", 20)}, keep=["p_partkey"])
    fitted = prep.fit(part)
    wide = fitted.transform(part, assemble=False)
    names = fitted.feature_names
    return wide.unpivot(["p_partkey"], [F.col(f"`{n}`").alias(n) for n in names], "feature", "value")


@register("f07_standardize", f"""{_G}
SELECT p_partkey, round((p_size - m1) / {_sd('s1')}, {DIGITS}) AS p_size,
       round((p_retailprice - m2) / {_sd('s2')}, {DIGITS}) AS p_retailprice FROM g, st""")
def f07(spark, sf):
    part = load_table(spark, sf, "part")
    fitted = PART_PREP.fit(part)
    out = fitted.transform(part, assemble=False)
    return out.select("p_partkey", F.round("p_size", DIGITS).alias("p_size"),
                      F.round("p_retailprice", DIGITS).alias("p_retailprice"))


@register("f08_feature_prep", f"""{_G},
lv AS (SELECT DISTINCT p_brand_group AS lvl FROM g)
SELECT p_partkey, p_type, 'p_size' AS feature, round((p_size - m1) / {_sd('s1')}, {DIGITS}) AS value FROM g, st
UNION ALL
SELECT p_partkey, p_type, 'p_retailprice', round((p_retailprice - m2) / {_sd('s2')}, {DIGITS}) FROM g, st
UNION ALL
SELECT p_partkey, p_type, 'p_brand_group_' || lvl, CASE WHEN p_brand_group = lvl THEN 1.0 ELSE 0.0 END FROM g, lv""")
def f08(spark, sf):
    part = load_table(spark, sf, "part")
    return _long(PART_PREP.fit(part), part)


@register("f06_assemble", f"""{_G}
SELECT p_type, count(*) AS n, round(sum((p_size - m1) / {_sd('s1')}), 6) AS sum_p_size,
       count(DISTINCT p_brand_group) AS n_brand_levels FROM g, st GROUP BY p_type""")
def f06(spark, sf):
    # Assembled vectors, reduced to checkable per-class sums of the first slot.
    from pyspark.ml.functions import vector_to_array
    part = load_table(spark, sf, "part")
    fitted = PART_PREP.fit(part)
    v = fitted.transform(part, assemble=True, wide=False)
    arr = vector_to_array("features")
    nb = len(fitted.levels["p_brand_group"])
    brand = F.array_position(F.slice(arr, 3, nb), F.lit(1.0))
    return v.groupBy("p_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(arr[0]), 6).alias("sum_p_size"),
        F.countDistinct(brand).cast("bigint").alias("n_brand_levels"))


@register("k01_dataset_kpis", """
SELECT count(*) AS n_rows, count(DISTINCT lang) AS n_classes, min(n_chars) AS min_chars,
       max(n_chars) AS max_chars FROM documents""")
def k01(spark, sf):
    d = load_table(spark, sf, "documents")
    return d.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("lang").alias("n_classes"),
                 F.min("n_chars").alias("min_chars"), F.max("n_chars").alias("max_chars"))
