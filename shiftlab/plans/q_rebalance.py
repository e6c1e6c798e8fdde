"""Registered queries for grouping, exact sampling and rebalancing."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftlab.operators import rebalance as rb
from shiftlab.operators.sampling import draw_with_replacement, sample_exact
from shiftlab.plans.registry import register
from shiftlab.plans.sqlgen import dbl, draw_sql, sample_sql
from shiftlab.sources.tables import TABLE_KEYS, TABLE_TIEBREAK, load_table

DOC_KEY = TABLE_KEYS["documents"]
LI_KEY, LI_TIE = TABLE_KEYS["lineitem"], TABLE_TIEBREAK["lineitem"]


# --- R01-R04: counts and two-group splits ---------------------------------

@register("r01_value_counts", """
SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang
""")
def r01(spark, sf):
    return rb.value_counts(load_table(spark, sf, "documents"), "lang")


@register("r01_value_counts_brand", """
SELECT p_brand, count(*) AS n FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand
""")
def r01b(spark, sf):
    return rb.value_counts(load_table(spark, sf, "part"), "p_brand")


@register("r02_binary_split", """
SELECT doc_id, toxic, CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS "group"
FROM labels WHERE toxic IN (0, 1)
""")
def r02(spark, sf):
    return rb.binary_groups(load_table(spark, sf, "labels"), "toxic").select("doc_id", "toxic", "group")


@register("r03_median_split", """
SELECT event_id, value, CASE WHEN value <= (SELECT median(value) FROM events) THEN 'low' ELSE 'high' END AS "group"
FROM events WHERE value IS NOT NULL
""")
def r03(spark, sf):
    return rb.median_groups(load_table(spark, sf, "events"), "value").select("event_id", "value", "group")


@register("r03_median_split_balanced", """
WITH v AS (SELECT l_orderkey, CAST(l_orderkey % 2 AS DOUBLE) AS v FROM lineitem WHERE l_orderkey % 5 <> 0),
m AS (SELECT median(v) AS m FROM v)
SELECT l_orderkey, v, CASE WHEN v <= m THEN 'low' ELSE 'high' END AS "group" FROM v, m
""")
def r03_balanced(spark, sf):
    """Ties at far-apart values; the operator drops the NaN rows, where the oracle has none."""
    x = load_table(spark, sf, "lineitem").select("l_orderkey", F.when(
        F.col("l_orderkey") % 5 == 0, F.lit(float("nan"))).otherwise((F.col("l_orderkey") % 2).cast("double")).alias("v"))
    return rb.median_groups(x, "v").select("l_orderkey", "v", "group")


@register("r04_majority_split", """
WITH m AS (SELECT lang FROM documents WHERE lang IS NOT NULL GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1)
SELECT doc_id, lang, CASE WHEN lang IS NOT DISTINCT FROM (SELECT lang FROM m) THEN 'major' ELSE 'rest' END AS "group"
FROM documents
""")
def r04(spark, sf):
    return rb.majority_groups(load_table(spark, sf, "documents"), "lang").select("doc_id", "lang", "group")


# --- R05-R07: exact samples and their union ------------------------------

@register("r05_sample_exact_by_lang", sample_sql("SELECT * FROM documents", ["lang"], DOC_KEY, "100"))
def r05(spark, sf):
    return sample_exact(load_table(spark, sf, "documents"), 100, ["lang"], DOC_KEY)


@register("r05_sample_exact_events", sample_sql("SELECT * FROM events", [], ["event_id"], "1000"))
def r05e(spark, sf):
    return sample_exact(load_table(spark, sf, "events"), 1000, [], ["event_id"])


@register("r05_sample_exact_lineitem",
          sample_sql("SELECT * FROM lineitem", ["l_returnflag"], LI_KEY, "5000", LI_TIE))
def r05l(spark, sf):
    return sample_exact(load_table(spark, sf, "lineitem"), 5000, ["l_returnflag"], LI_KEY, tiebreak=LI_TIE)


@register("r06_draw_with_replacement", draw_sql(
    "SELECT * FROM documents", ["lang"], DOC_KEY,
    "SELECT lang, 300 AS q FROM documents GROUP BY lang"))
def r06(spark, sf):
    d = load_table(spark, sf, "documents")
    return draw_with_replacement(d, 300, ["lang"], DOC_KEY)


@register("r07_union_pieces", f"""
{sample_sql("SELECT * FROM documents WHERE lang = 'en'", [], DOC_KEY, "50")}
UNION ALL
{draw_sql("SELECT * FROM documents WHERE lang = 'fr'", [], DOC_KEY, "SELECT 200 AS q")}
""")
def r07(spark, sf):
    d = load_table(spark, sf, "documents")
    a = sample_exact(d.where(F.col("lang") == "en"), 50, [], DOC_KEY)
    b = draw_with_replacement(d.where(F.col("lang") == "fr"), 200, [], DOC_KEY)
    return a.unionByName(b)


# --- R08: target rebalancing ---------------------------------------------

def _target_up_sql(table: str, col: str, key, s: float, tie=(), copy: str | None = None) -> str:
    kept = f", 0::BIGINT AS {copy}" if copy else ""
    return f"""
WITH d AS (SELECT * FROM {table} WHERE {col} IS NOT NULL),
c AS (SELECT {col}, count(*) AS n FROM d GROUP BY {col}),
t AS (SELECT floor(min(n) + (max(n) - min(n)) * {dbl(s)})::BIGINT AS t FROM c)
SELECT d.*{kept} FROM d JOIN c USING ({col}) JOIN t ON c.n >= t.t
UNION ALL
{draw_sql("SELECT * FROM d", [col], key, f"SELECT c.{col}, t.t AS q FROM c JOIN t ON c.n < t.t", tie, copy)}
"""


def _target_down_sql(table: str, col: str, key, s: float, tie=()) -> str:
    return f"""
WITH d AS (SELECT * FROM {table} WHERE {col} IS NOT NULL),
c AS (SELECT {col}, count(*) AS n FROM d GROUP BY {col}),
t AS (SELECT greatest(floor(max(n) - (max(n) - min(n)) * {dbl(abs(s))})::BIGINT, min(n)) AS t FROM c)
{sample_sql("SELECT * FROM d", [col], key, "(SELECT t FROM t)", tie)}
"""


@register("r08_rebalance_target_up", _target_up_sql("documents", "lang", DOC_KEY, 0.29))
def r08u(spark, sf):
    return rb.rebalance_target(load_table(spark, sf, "documents"), "lang", 0.29, DOC_KEY)


@register("r08_rebalance_target_down", _target_down_sql("documents", "lang", DOC_KEY, -0.29))
def r08d(spark, sf):
    return rb.rebalance_target(load_table(spark, sf, "documents"), "lang", -0.29, DOC_KEY)


@register("r08_rebalance_target_copies", _target_up_sql("documents", "lang", DOC_KEY, 1.0, (), "_copy"))
def r08_copies(spark, sf):
    """Every copy with its number, so that (doc_id, _copy) identifies a row."""
    return rb.rebalance_target(load_table(spark, sf, "documents"), "lang", 1.0, DOC_KEY, copy_col=rb.COPY)


@register("r08_rebalance_target_full_up", _target_up_sql("documents", "lang", DOC_KEY, 1.0))
def r08fu(spark, sf):
    return rb.rebalance_target(load_table(spark, sf, "documents"), "lang", 1.0, DOC_KEY)


@register("r08_rebalance_target_lineitem_up",
          _target_up_sql("lineitem", "l_returnflag", LI_KEY, 0.5, LI_TIE))
def r08lu(spark, sf):
    return rb.rebalance_target(load_table(spark, sf, "lineitem"), "l_returnflag", 0.5, LI_KEY,
                               tiebreak=LI_TIE)


@register("r08_rebalance_target_lineitem_down",
          _target_down_sql("lineitem", "l_returnflag", LI_KEY, -0.5, LI_TIE))
def r08ld(spark, sf):
    return rb.rebalance_target(load_table(spark, sf, "lineitem"), "l_returnflag", -0.5, LI_KEY,
                               tiebreak=LI_TIE)


@register("r08_rebalance_target_identity", "SELECT * FROM documents")
def r08i(spark, sf):
    return rb.rebalance_target(load_table(spark, sf, "documents"), "lang", 0.005, DOC_KEY)


# --- R09-R11: binary, continuous, categorical -----------------------------

def _two_group_sql(table: str, grow: str, other: str, key, quota: str, up: bool, copy: str | None = None) -> str:
    kept = f", 0::BIGINT AS {copy}" if copy else ""
    g = f"SELECT * FROM {table} WHERE {grow}"
    o = f"SELECT * FROM {table} WHERE {other}"
    ng = f"(SELECT count(*) FROM {table} WHERE {grow})"
    no = f"(SELECT count(*) FROM {table} WHERE {other})"
    q = quota.format(g=ng, o=no)
    moved = draw_sql(g, [], key, f"SELECT {q} AS q", (), copy) if up else f"SELECT *{kept} FROM ({sample_sql(g, [], key, q)})"
    return f"SELECT *{kept} FROM ({o})\nUNION ALL\n{moved}"


@register("r09_rebalance_binary_up", _two_group_sql(
    "labels", "toxic = 1", "toxic = 0", DOC_KEY,
    f"greatest(floor({{g}} + ({{o}} - {{g}}) * {dbl(0.29)})::BIGINT, {{g}})", True))
def r09u(spark, sf):
    return rb.rebalance_binary(load_table(spark, sf, "labels"), "toxic", 0.29, DOC_KEY)


@register("r09_rebalance_binary_down", _two_group_sql(
    "labels", "toxic = 1", "toxic = 0", DOC_KEY,
    f"greatest(floor({{g}} * (1 - {dbl(0.5)}))::BIGINT, 1)", False))
def r09d(spark, sf):
    return rb.rebalance_binary(load_table(spark, sf, "labels"), "toxic", -0.5, DOC_KEY)


_MED = "(SELECT median(value) FROM events)"


@register("r10_rebalance_continuous_up", _two_group_sql(
    "events", f"value > {_MED}", f"value <= {_MED}", ["event_id"],
    f"greatest(floor({{g}} * (1 + {dbl(0.29)} * 2))::BIGINT, {{g}})", True))
def r10u(spark, sf):
    return rb.rebalance_continuous(load_table(spark, sf, "events"), "value", 0.29, ["event_id"])


@register("r10_rebalance_continuous_down", _two_group_sql(
    "events", f"value > {_MED}", f"value <= {_MED}", ["event_id"],
    f"greatest(floor({{g}} * (1 - {dbl(0.5)} * 0.8))::BIGINT, 1)", False))
def r10d(spark, sf):
    return rb.rebalance_continuous(load_table(spark, sf, "events"), "value", -0.5, ["event_id"])


_NAN_EVENTS = """(SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST('nan' AS DOUBLE) ELSE value END AS value FROM events)"""
_NAN_MED = f"(SELECT median(value) FROM {_NAN_EVENTS} WHERE NOT isnan(value))"


def _nan_events(spark, sf):
    e = load_table(spark, sf, "events")
    return e.select("event_id", F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))


@register("r10_rebalance_continuous_nan_up", _two_group_sql(
    _NAN_EVENTS, f"NOT isnan(value) AND value > {_NAN_MED}", f"NOT isnan(value) AND value <= {_NAN_MED}", ["event_id"],
    f"greatest(floor({{g}} * (1 + {dbl(0.5)} * 2))::BIGINT, {{g}})", True))
def r10nu(spark, sf):
    """A third of the values is NaN: these rows are in neither half."""
    return rb.rebalance_continuous(_nan_events(spark, sf), "value", 0.5, ["event_id"])


@register("r10_rebalance_continuous_nan_down", _two_group_sql(
    _NAN_EVENTS, f"NOT isnan(value) AND value > {_NAN_MED}", f"NOT isnan(value) AND value <= {_NAN_MED}", ["event_id"],
    f"greatest(floor({{g}} * (1 - {dbl(0.5)} * 0.8))::BIGINT, 1)", False))
def r10nd(spark, sf):
    return rb.rebalance_continuous(_nan_events(spark, sf), "value", -0.5, ["event_id"])


_MAJ = "(SELECT lang FROM documents WHERE lang IS NOT NULL GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1)"


@register("r11_rebalance_categorical_up", _two_group_sql(
    "documents", f"lang IS DISTINCT FROM {_MAJ}", f"lang IS NOT DISTINCT FROM {_MAJ}", DOC_KEY,
    f"greatest(floor({{g}} + ({{o}} - {{g}}) * {dbl(0.29)})::BIGINT, {{g}})", True))
def r11u(spark, sf):
    return rb.rebalance_categorical(load_table(spark, sf, "documents"), "lang", 0.29, DOC_KEY)


@register("r11_rebalance_categorical_down", _two_group_sql(
    "documents", f"lang IS NOT DISTINCT FROM {_MAJ}", f"lang IS DISTINCT FROM {_MAJ}", DOC_KEY,
    f"least(greatest(floor({{g}} * (1 - {dbl(0.5)} * 0.8))::BIGINT, {{o}}), {{g}})", False))
def r11d(spark, sf):
    return rb.rebalance_categorical(load_table(spark, sf, "documents"), "lang", -0.5, DOC_KEY)


@register("r12_rebalance_dispatch", _target_down_sql("orders", "o_orderpriority", ["o_orderkey"], -1.0))
def r12(spark, sf):
    return rb.rebalance(load_table(spark, sf, "orders"), "o_orderpriority", "target", -1.0, ["o_orderkey"])


@register("r12_rebalance_unknown_kind", "SELECT * FROM orders")
def r12u(spark, sf):
    return rb.rebalance(load_table(spark, sf, "orders"), "o_orderpriority", "ordinal", 0.5, ["o_orderkey"])


# --- R14-R16 ----------------------------------------------------------------

@register("r14_random_undersample", _target_down_sql("embeddings", "label", ["vec_id"], -0.5))
def r14(spark, sf):
    return rb.random_undersample(load_table(spark, sf, "embeddings"), "label", -0.5, ["vec_id"])


@register("r15_random_oversample", f"""
WITH d AS (SELECT * FROM documents WHERE lang IS NOT NULL),
c AS (SELECT lang, count(*) AS n FROM d GROUP BY lang),
t AS (SELECT floor(min(n) + (max(n) - min(n)) * {dbl(0.5)})::BIGINT AS t FROM c)
SELECT * FROM d
UNION ALL
{draw_sql("SELECT * FROM d", ["lang"], DOC_KEY, "SELECT c.lang, t.t - c.n AS q FROM c JOIN t ON c.n < t.t")}
""")
def r15(spark, sf):
    return rb.random_oversample(load_table(spark, sf, "documents"), "lang", 0.5, DOC_KEY)


@register("r15_random_oversample_copies", f"""
WITH d AS (SELECT * FROM documents WHERE lang IS NOT NULL),
c AS (SELECT lang, count(*) AS n FROM d GROUP BY lang),
t AS (SELECT floor(min(n) + (max(n) - min(n)) * {dbl(0.5)})::BIGINT AS t FROM c)
SELECT *, 0::BIGINT AS _copy FROM d
UNION ALL
SELECT * EXCLUDE (_copy), _copy + 1 AS _copy FROM (
{draw_sql("SELECT * FROM d", ["lang"], DOC_KEY, "SELECT c.lang, t.t - c.n AS q FROM c JOIN t ON c.n < t.t", (), "_copy")})
""")
def r15_copies(spark, sf):
    return rb.random_oversample(load_table(spark, sf, "documents"), "lang", 0.5, DOC_KEY, copy_col=rb.COPY)


@register("r16_distribution_stats", f"""
WITH a AS ({_target_down_sql("documents", "lang", DOC_KEY, -0.5)}),
o AS (SELECT lang, count(*) AS original FROM documents WHERE lang IS NOT NULL GROUP BY lang),
m AS (SELECT lang, count(*) AS modified FROM a WHERE lang IS NOT NULL GROUP BY lang)
SELECT coalesce(o.lang, m.lang) AS class, coalesce(original, 0) AS original, coalesce(modified, 0) AS modified,
       coalesce(modified, 0) - coalesce(original, 0) AS difference,
       CASE WHEN coalesce(original, 0) > 0 THEN (coalesce(modified, 0) - original) / original * 100.0 ELSE 0.0 END
         AS pct_change
FROM o FULL OUTER JOIN m ON o.lang = m.lang
""")
def r16(spark, sf):
    d = load_table(spark, sf, "documents")
    return rb.distribution_stats(d, rb.rebalance_target(d, "lang", -0.5, DOC_KEY), "lang")
