"""Registered queries for the nested documents.

The driver's tables hold no vulnerability documents, so an order with its line
items (at most seven, a bounded group) is written as one JSON document, which is
then parsed and flattened by the ingest; every 50th text is cut off.  The
extraction functions also run on their own, on arrays built the same way.
Directories, compaction and the cache are tested on generated files.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftlab.functions import nested as nf
from shiftlab.functions.scalar import band
from shiftlab.plans.registry import register
from shiftlab.sources import ingest as ig
from shiftlab.sources.tables import load_table

_FIELDS = ["l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", "l_partkey", "l_suppkey"]


def order_lines(spark, sf):
    li = load_table(spark, sf, "lineitem")
    return li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*_FIELDS))).alias("arr"))


_ARR = f"""ol AS (SELECT l_orderkey, list(struct_pack({', '.join(f'{c} := {c}' for c in _FIELDS)})
                  ORDER BY {', '.join(_FIELDS)}) AS arr FROM lineitem GROUP BY l_orderkey)"""


@register("i01_json_props", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def i01(spark, sf):
    e = load_table(spark, sf, "events")
    return e.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@register("i06_primary_entry", f"""WITH {_ARR},
p AS (SELECT l_orderkey, coalesce(list_filter(arr, lambda e: e.l_returnflag = 'R')[1], arr[1]) AS e FROM ol)
SELECT l_orderkey, e.l_linenumber AS ln, e.l_returnflag AS flag, e.l_quantity AS qty FROM p""")
def i06(spark, sf):
    p = order_lines(spark, sf).select("l_orderkey", nf.first_preferred(F.col("arr"),
                                                                     lambda e: e["l_returnflag"] == "R").alias("e"))
    return p.select("l_orderkey", F.col("e.l_linenumber").alias("ln"), F.col("e.l_returnflag").alias("flag"),
                    F.col("e.l_quantity").alias("qty"))


@register("i07_preferred_score_default", f"""WITH {_ARR}
SELECT o_orderkey,
       coalesce(coalesce(list_filter(arr, lambda e: e.l_linestatus = 'F')[1], arr[1]).l_quantity, 0.0) AS score
FROM orders LEFT JOIN ol ON ol.l_orderkey = orders.o_orderkey""")
def i07(spark, sf):
    o = load_table(spark, sf, "orders").select("o_orderkey")
    j = o.join(order_lines(spark, sf), o["o_orderkey"] == F.col("l_orderkey"), "left")
    e = nf.first_preferred(F.col("arr"), lambda e: e["l_linestatus"] == "F")
    return j.select("o_orderkey", F.coalesce(e["l_quantity"], F.lit(0.0)).alias("score"))


def _desc(spark, sf):
    return order_lines(spark, sf).select("l_orderkey", F.transform(
        "arr", lambda e: F.struct(F.array(F.struct(
            e["l_linestatus"].alias("lang"),
            F.concat(e["l_returnflag"], F.lit("-"), e["l_linenumber"].cast("string")).alias("value")))
            .alias("description"))).alias("w"))


@register("i08_matching_values", f"""WITH {_ARR},
w AS (SELECT l_orderkey, list_transform(arr, lambda e: struct_pack(description := [struct_pack(
        lang := e.l_linestatus, value := e.l_returnflag || '-' || CAST(e.l_linenumber AS VARCHAR))])) AS w FROM ol),
m AS (SELECT l_orderkey, flatten(list_transform(w, lambda x: list_transform(list_filter(x.description,
        lambda d: d.lang = 'O' AND (starts_with(d.value, 'A-') OR starts_with(d.value, 'N-'))),
        lambda d: d.value))) AS v FROM w)
SELECT l_orderkey, len(v) AS n_values, coalesce(v[1], 'NONE') AS first_value FROM m""")
def i08(spark, sf):
    v = nf.matching_values(
        F.col("w"), "description",
        lambda d: (d["lang"] == "O") & (d["value"].startswith("A-") | d["value"].startswith("N-")),
        lambda d: d["value"])
    x = _desc(spark, sf).select("l_orderkey", v.alias("v"))
    return x.select("l_orderkey", nf.size0(F.col("v")).alias("n_values"),
                    nf.first_or(F.col("v"), "NONE").alias("first_value"))


@register("i09_token_distinct_count", f"""WITH {_ARR},
c AS (SELECT l_orderkey, list_transform(arr, lambda e: CASE WHEN e.l_linestatus = 'F' THEN 'cpe:2.3:' || e.l_returnflag
        ELSE 'cpe:2.3:' || e.l_returnflag || ':' || CAST(e.l_suppkey AS VARCHAR) || ':' || CAST(e.l_partkey AS VARCHAR)
        END) AS crit FROM ol)
SELECT l_orderkey, len(list_distinct(list_transform(list_filter(list_transform(crit, lambda s: string_split(s, ':')),
       lambda p: len(p) >= 4), lambda p: p[4]))) AS n_vendors FROM c""")
def i09(spark, sf):
    crit = F.transform("arr", lambda e: F.when(
        e["l_linestatus"] == "F", F.concat(F.lit("cpe:2.3:"), e["l_returnflag"])).otherwise(
        F.concat_ws(":", F.lit("cpe"), F.lit("2.3"), e["l_returnflag"], e["l_suppkey"].cast("string"),
                    e["l_partkey"].cast("string"))))
    x = order_lines(spark, sf).select("l_orderkey", crit.alias("crit"))
    return x.select("l_orderkey", nf.token_distinct_count(F.col("crit"), ":", 3, 4).alias("n_vendors"))


@register("i10_any_tag", f"""WITH {_ARR}
SELECT l_orderkey, CASE WHEN len(list_filter(list_transform(arr, lambda e: [e.l_returnflag, e.l_linestatus]),
       lambda t: list_contains(t, 'R'))) > 0 THEN 1 ELSE 0 END AS has_tag, len(arr) AS n_refs FROM ol""")
def i10(spark, sf):
    refs = F.transform("arr", lambda e: F.struct(F.array(e["l_returnflag"], e["l_linestatus"]).alias("tags")))
    x = order_lines(spark, sf).select("l_orderkey", refs.alias("refs"))
    return x.select("l_orderkey", nf.any_tag(F.col("refs"), "tags", "R").alias("has_tag"),
                    nf.size0(F.col("refs")).alias("n_refs"))


@register("i11_first_english_length", """
SELECT source, count(*) AS n_docs,
       coalesce(arg_min(length(text), doc_id) FILTER (WHERE lang = 'en'), 0) AS desc_length
FROM documents GROUP BY source""")
def i11(spark, sf):
    d = load_table(spark, sf, "documents")
    first_en = F.min_by(F.when(F.col("lang") == "en", F.length("text")),
                        F.when(F.col("lang") == "en", F.col("doc_id")))
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"),
                                   F.coalesce(first_en, F.lit(0)).alias("desc_length"))


@register("i12_year_prefix", """
SELECT o_orderkey, TRY_CAST(substr(CAST(o_orderdate AS VARCHAR), 1, 4) AS INTEGER) AS year,
       TRY_CAST(substr(o_orderpriority, 1, 4) AS INTEGER) AS bad_year FROM orders""")
def i12(spark, sf):
    o = load_table(spark, sf, "orders")
    return o.select("o_orderkey", nf.year_prefix(F.col("o_orderdate").cast("string")).alias("year"),
                    nf.year_prefix(F.col("o_orderpriority")).alias("bad_year"))


@register("i13_component_defaults", """
SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), 'UNKNOWN') AS quality_cat,
       coalesce(CAST(l.toxic AS DOUBLE), 0.0) AS toxic_score
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def i13(spark, sf):
    d = load_table(spark, sf, "documents").join(load_table(spark, sf, "labels"), "doc_id", "left")
    return d.select("doc_id", F.coalesce(F.col("quality").cast("string"), F.lit("UNKNOWN")).alias("quality_cat"),
                    F.coalesce(F.col("toxic").cast("double"), F.lit(0.0)).alias("toxic_score"))


@register("i14_band", """
SELECT o_orderkey, CASE WHEN o_totalprice >= 375000 THEN 'Critical' WHEN o_totalprice >= 250000 THEN 'High'
                        WHEN o_totalprice >= 125000 THEN 'Medium' ELSE 'Low' END AS severity FROM orders""")
def i14(spark, sf):
    o = load_table(spark, sf, "orders")
    return o.select("o_orderkey", band("o_totalprice", [375000, 250000, 125000],
                                       ["Critical", "High", "Medium", "Low"]).alias("severity"))


@register("i14_band_documents", """
SELECT doc_id, CASE WHEN n_chars >= 9000 THEN 'Critical' WHEN n_chars >= 7000 THEN 'High'
                    WHEN n_chars >= 4000 THEN 'Medium' ELSE 'Low' END AS severity FROM documents""")
def i14d(spark, sf):
    d = load_table(spark, sf, "documents")
    return d.select("doc_id", band("n_chars", [9000, 7000, 4000], ["Critical", "High", "Medium", "Low"])
                    .alias("severity"))


# --- whole documents --------------------------------------------------------

def order_documents(spark, sf):
    """(file_name, doc): each order as one JSON document in the ingest's format."""
    li = load_table(spark, sf, "lineitem")
    lines = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
        "l_extendedprice"))).alias("arr"))
    o = load_table(spark, sf, "orders")
    x = o.join(lines, o["o_orderkey"] == lines["l_orderkey"], "left").withColumn("arr", F.coalesce("arr", F.array()))
    k = F.col("o_orderkey")
    v31 = F.transform("arr", lambda e: F.struct(
        F.when(e["l_returnflag"] == "R", F.lit("Primary")).otherwise(F.lit("Secondary")).alias("type"),
        F.when(e["l_linenumber"] != 2, e["l_discount"]).alias("exploitabilityScore"), e["l_tax"].alias("impactScore"),
        F.struct(F.when(e["l_quantity"] <= 48, e["l_quantity"] / 5).alias("baseScore"),
                 F.when(e["l_linestatus"] == "F", F.lit("NETWORK")).alias("attackVector"),
                 e["l_returnflag"].alias("attackComplexity")).alias("cvssData")))
    v2 = F.transform(F.filter("arr", lambda e: e["l_linenumber"] <= 3), lambda e: F.struct(
        F.when(e["l_linestatus"] == "O", F.lit("Primary")).alias("type"), F.struct(e["l_tax"].alias("baseScore")).alias("cvssData")))
    weak = F.transform("arr", lambda e: F.struct(F.array(F.struct(
        F.when(e["l_linestatus"] == "O", F.lit("en")).otherwise(F.lit("es")).alias("lang"),
        F.concat(F.when(e["l_returnflag"] == "N", F.lit("other-")).otherwise(F.lit("CWE-")), (e["l_partkey"] % 9).cast("string"))
        .alias("value"))).alias("description")))
    conf = F.transform("arr", lambda e: F.struct(F.array(F.struct(F.array(F.struct(
        F.when(e["l_linestatus"] == "F", F.lit("cpe:2.3:a")).otherwise(F.concat(F.lit("cpe:2.3:a:"), (e["l_suppkey"] % 5).cast("string"), F.lit(":p")))
        .alias("criteria"))).alias("cpeMatch"))).alias("nodes")))
    refs = F.transform("arr", lambda e: F.struct(F.lit("u").alias("url"), F.when(e["l_linenumber"] > 1, F.array(
        F.when((e["l_returnflag"] == "R") & (e["l_linestatus"] == "F"), F.lit("Exploit")).otherwise(F.lit("Patch")))).alias("tags")))
    desc = F.array(F.struct(F.lit("es").alias("lang"), F.lit("hola").alias("value")),
                   F.struct(F.when(k % 4 != 0, F.lit("en")).alias("lang"), F.concat(F.col("o_orderpriority"), F.lit("é")).alias("value")))
    doc = F.to_json(F.struct(
        F.concat(F.lit("CVE-"), F.year("o_orderdate").cast("string"), F.lit("-"), k.cast("string")).alias("id"),
        F.when(k % 11 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("published"),
        F.when(k % 3 != 0, F.col("o_orderstatus")).alias("vulnStatus"),
        F.struct(v31.alias("cvssMetricV31"), v2.alias("cvssMetricV2")).alias("metrics"), weak.alias("weaknesses"),
        conf.alias("configurations"), refs.alias("references"), desc.alias("descriptions")))
    return x.select(F.concat(F.lit("CVE-"), F.year("o_orderdate").cast("string"), F.lit("-"), k.cast("string"), F.lit(".json")).alias("file_name"),
                    F.when(k % 50 == 7, F.substring(doc, 1, 40)).otherwise(doc).alias("doc"))


_FLAT = """ol AS (SELECT l_orderkey, list(struct_pack(ln := l_linenumber, p := l_partkey, s := l_suppkey, q := l_quantity, d := l_discount,
         x := l_tax, rf := l_returnflag, ls := l_linestatus, ep := l_extendedprice)
         ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, l_extendedprice) AS arr
       FROM lineitem GROUP BY l_orderkey),
doc AS (SELECT o.*, coalesce(arr, []) AS arr FROM orders o LEFT JOIN ol ON l_orderkey = o_orderkey WHERE o_orderkey % 50 <> 7),
e AS (SELECT *, coalesce(list_filter(arr, lambda e: e.rf = 'R')[1], arr[1]) AS m, list_filter(arr, lambda e: e.ln <= 3) AS a2,
             list_transform(list_filter(arr, lambda e: e.ls = 'O' AND e.rf <> 'N'), lambda e: 'CWE-' || CAST(e.p % 9 AS VARCHAR)) AS cwes
      FROM doc),
flat AS (SELECT 'CVE-' || year(o_orderdate) || '-' || o_orderkey AS cve_id, m.q / 5 AS cvss31_score,
  coalesce(coalesce(list_filter(a2, lambda e: e.ls = 'O')[1], a2[1]).x, 0.0) AS cvss2_score,
  CASE WHEN m.ls = 'F' THEN 'NETWORK' ELSE 'UNKNOWN' END AS attack_vector, m.rf AS attack_complexity,
  'UNKNOWN' AS privileges_required, 'UNKNOWN' AS user_interaction, 'UNKNOWN' AS scope, 'UNKNOWN' AS confidentiality,
  'UNKNOWN' AS integrity, 'UNKNOWN' AS availability,
  CASE WHEN m.ln <> 2 THEN m.d ELSE 0.0 END AS exploitability_score, m.x AS impact_score,
  CASE WHEN len(list_filter(arr, lambda e: e.ln > 1 AND e.rf = 'R' AND e.ls = 'F')) > 0 THEN 1 ELSE 0 END AS has_exploit,
  len(list_distinct(list_transform(list_filter(arr, lambda e: e.ls <> 'F'), lambda e: e.s % 5)))::INTEGER AS num_vendors,
  len(cwes)::INTEGER AS num_weaknesses, coalesce(cwes[1], 'NONE') AS primary_cwe, len(arr)::INTEGER AS num_references,
  CASE WHEN o_orderkey % 4 <> 0 THEN length(o_orderpriority) + 1 ELSE 0 END::INTEGER AS desc_length,
  CASE WHEN o_orderkey % 11 <> 0 THEN year(o_orderdate)::INTEGER END AS year_published,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus ELSE 'UNKNOWN' END AS vuln_status,
  CASE WHEN m.q / 5 >= 9 THEN 'Critical' WHEN m.q / 5 >= 7 THEN 'High' WHEN m.q / 5 >= 4 THEN 'Medium' ELSE 'Low' END AS severity
 FROM e WHERE len(arr) > 0 AND m.q <= 48)"""


def _flat(spark, sf):
    return ig.flatten(ig.parse(order_documents(spark, sf)))


@register("i15_flatten_documents", f"WITH {_FLAT} SELECT * FROM flat")
def i15(spark, sf):
    """Every document through the parser and the flattener, all 22 columns."""
    return _flat(spark, sf)


@register("i05_valid_documents", f"WITH {_FLAT} SELECT cve_id, cvss31_score FROM flat")
def i05(spark, sf):
    return _flat(spark, sf).select("cve_id", "cvss31_score")


@register("i04_ingest_report", f"""WITH {_FLAT}
SELECT (SELECT count(*) FROM orders) AS files, (SELECT count(*) FROM flat) AS valid,
       (SELECT count(*) FROM orders WHERE o_orderkey % 50 = 7) AS malformed""")
def i04(spark, sf):
    r = ig.report(ig.parse(order_documents(spark, sf)))
    return spark.createDataFrame([(r.files, r.valid, r.malformed)], "files bigint, valid bigint, malformed bigint")


@register("i02_year_pruned_documents", f"WITH {_FLAT} SELECT cve_id FROM flat WHERE CAST(split_part(cve_id, '-', 2) AS INTEGER) >= 1997")
def i02(spark, sf):
    """Documents whose file name has a year from 1997 on."""
    return ig.flatten(ig.parse(ig.select_files(order_documents(spark, sf), 1997))).select("cve_id")


@register("i11_flattened_lengths", f"WITH {_FLAT} SELECT cve_id, num_references, desc_length FROM flat")
def i11_flat(spark, sf):
    return _flat(spark, sf).select("cve_id", "num_references", "desc_length")


_DEFAULTED = ["attack_vector", "attack_complexity", "privileges_required", "user_interaction", "scope", "confidentiality",
              "integrity", "availability", "exploitability_score", "impact_score", "vuln_status"]


@register("i13_flattened_defaults", f"WITH {_FLAT} SELECT cve_id, {', '.join(_DEFAULTED)} FROM flat")
def i13_flat(spark, sf):
    return _flat(spark, sf).select("cve_id", *_DEFAULTED)


@register("k01_document_kpis", f"""WITH {_FLAT}
SELECT count(*) AS n_rows, count(DISTINCT severity) AS n_classes, min(year_published) AS min_year, max(year_published) AS max_year,
       22 AS n_features FROM flat""")
def k01_documents(spark, sf):
    flat = _flat(spark, sf)
    return ig.kpis(flat, n_features=len(flat.columns))
