"""Ingest of nested vulnerability documents into the flat 22-column table.

One JSON document per file.  No path list passes through the driver: the reader
matches file names itself, and the year in a file's name is a column.  A corpus of
many small files is compacted once (``compact``) into Parquet, partitioned by that
year, so later reads prune partitions and no task opens a tiny file.  Documents are
parsed under a declared schema (no inference pass) and flattened by one projection of
array/struct expressions.  Malformed documents land in ``_corrupt_record`` and are
dropped (and counted); documents without a version-3.1 entry carrying a numeric base
score are dropped.

Missing and explicit-null JSON values are indistinguishable under a declared
schema; both become the documented defaults (``UNKNOWN`` / 0.0).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlab.functions import nested as nf
from shiftlab.functions.scalar import band

FILE_GLOB = "CVE-*.json"
#: Where a cache notes what it was made from, beside its folder.
MANIFEST = "-manifest"
DEFAULT_YEAR_MIN = 2015

# Severity cut-offs on the v3.1 base score and their labels.
SEVERITY_CUTS = [9.0, 7.0, 4.0]
SEVERITY_NAMES = ["Critical", "High", "Medium", "Low"]

# Declared (DDL) schema of the fields read.
CVE_SCHEMA = """
id string, published string, vulnStatus string,
metrics struct<
  cvssMetricV31: array<struct<type:string, exploitabilityScore:double, impactScore:double,
    cvssData: struct<baseScore:double, attackVector:string, attackComplexity:string, privilegesRequired:string,
      userInteraction:string, scope:string, confidentialityImpact:string, integrityImpact:string,
      availabilityImpact:string>>>,
  cvssMetricV2: array<struct<type:string, cvssData: struct<baseScore:double>>>>,
weaknesses array<struct<description: array<struct<lang:string, value:string>>>>,
configurations array<struct<nodes: array<struct<cpeMatch: array<struct<criteria:string>>>>>>,
`references` array<struct<url:string, tags: array<string>>>,
descriptions array<struct<lang:string, value:string>>,
_corrupt_record string
"""

_FIELD_NAMES = ["id", "published", "vulnStatus", "metrics", "weaknesses", "configurations", "references", "descriptions"]

# The columns of the flat table.
FLAT_COLUMNS = [
    "cve_id", "cvss31_score", "cvss2_score", "attack_vector", "attack_complexity", "privileges_required",
    "user_interaction", "scope", "confidentiality", "integrity", "availability", "exploitability_score",
    "impact_score", "has_exploit", "num_vendors", "num_weaknesses", "primary_cwe", "num_references",
    "desc_length", "year_published", "vuln_status", "severity",
]

#: Years that one compacted file set is dealt over, and files of a year.
COMPACT_FILES_PER_YEAR = 8


def file_year(name: Column) -> Column:
    """Year token of ``CVE-YYYY-NNNN.json`` (second ``-`` field), NULL if unparsable."""
    return F.try_element_at(F.split(name, "-"), F.lit(2)).try_cast("int")


def list_files(spark: SparkSession, data_dir: str, glob: str = FILE_GLOB) -> DataFrame:
    """(path, file_name, length, modified) of the files matching ``glob``; contents are not read.

    Raises if the directory is missing or holds no matching file.
    """
    try:
        found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(data_dir)
    except AnalysisException as e:
        if e.getCondition() and e.getCondition().startswith("PATH_NOT_FOUND"):
            raise FileNotFoundError(f"document directory not found: {data_dir}") from e
        raise
    found = found.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "length",
                         F.col("modificationTime").alias("modified"))
    if not found.limit(1).count():
        raise FileNotFoundError(f"no {glob} files in {data_dir}")
    return found


def select_files(files: DataFrame, year_min: int | None = DEFAULT_YEAR_MIN, max_files: int = 0,
                 year: Column | None = None) -> DataFrame:
    """I02 + I03: rows whose ``file_name`` has a year >= ``year_min`` (unparsable names kept), then the
    first ``max_files`` by name (0 = all).  ``year`` is the year column where there is one."""
    if year_min:
        y = file_year(F.col("file_name")) if year is None else year
        files = files.where(y.isNull() | (y >= year_min))
    return files.orderBy("file_name").limit(max_files) if max_files and max_files > 0 else files


def read_files(spark: SparkSession, data_dir: str, glob: str = FILE_GLOB) -> DataFrame:
    """(file_name, doc): each file's text as one row, bytes that are no UTF-8 as a document that does not parse."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(data_dir)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"),
                        F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.lit("")).alias("doc"))


def parse(docs: DataFrame) -> DataFrame:
    """I01 + I04: the declared fields of each ``doc``; one that does not parse has its text in ``_corrupt_record``."""
    fields = F.from_json("doc", CVE_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    bad = F.trim("doc") == ""
    others = [c for c in docs.columns if c != "doc"]
    x = docs.select(*others, nf.once(F.col("doc")).alias("doc"))
    x = x.select(*others, nf.once(F.when(~bad, fields)).alias("_f"), "doc")
    names = [c.strip("`") for c in _FIELD_NAMES]
    corrupt = F.when(F.col("_f").isNull(), F.col("doc")).otherwise(F.col("_f._corrupt_record"))
    return x.select(*others, *(F.col("_f")[n].alias(n) for n in names), corrupt.alias("_corrupt_record"))


def compact(spark: SparkSession, data_dir: str, out: str, glob: str = FILE_GLOB, years: list[int] | None = None) -> None:
    """Write a directory of one-document files as Parquet (file_name, doc, file_year), partitioned by year.

    With ``years`` only these years' partitions are rewritten; the others stay.
    """
    rows = read_files(spark, data_dir, glob).withColumn("file_year", file_year(F.col("file_name")))
    if years is not None:
        rows = rows.where(F.col("file_year").isin(years))
    part = F.pmod(F.xxhash64("file_name"), F.lit(COMPACT_FILES_PER_YEAR))
    (rows.repartition("file_year", part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("file_year").parquet(out))


def load_compacted(spark: SparkSession, path: str, year_min: int | None = DEFAULT_YEAR_MIN, max_files: int = 0) -> DataFrame:
    """I01-I15 from a compacted corpus: partitions before ``year_min`` are not read."""
    rows = spark.read.schema("file_name string, doc string, file_year int").parquet(path)
    return flatten(parse(select_files(rows, year_min, max_files, F.col("file_year"))))


def primary_entry() -> Column:
    """The document's version-3.1 entry."""
    return nf.first_preferred(F.col("metrics")["cvssMetricV31"], lambda e: e["type"] == "Primary")


def is_valid() -> Column:
    """I04 + I05: the document parses and has a version-3.1 entry with a base score."""
    return F.col("_corrupt_record").isNull() & F.coalesce(primary_entry()["cvssData"]["baseScore"].isNotNull(), F.lit(False))


def flatten(raw: DataFrame) -> DataFrame:
    """The flat table, one projection, valid documents only."""
    m = F.col("metrics")
    v31 = primary_entry()
    v2 = nf.first_preferred(m["cvssMetricV2"], lambda e: e["type"] == "Primary")
    cwes = nf.matching_values(
        F.col("weaknesses"), "description",
        lambda d: (d["lang"] == "en") & (d["value"].startswith("CWE-") | d["value"].startswith("NVD-")),
        lambda d: d["value"])
    criteria = F.flatten(F.transform(
        F.coalesce(F.col("configurations"), F.array()),
        lambda c: F.flatten(F.transform(F.coalesce(c["nodes"], F.array()),
                                        lambda n: F.transform(F.coalesce(n["cpeMatch"], F.array()),
                                                              lambda x: F.coalesce(x["criteria"], F.lit("")))))))
    desc = F.try_element_at(F.filter(F.coalesce(F.col("descriptions"), F.array()),
                                     lambda d: d["lang"] == "en"), F.lit(1))
    d = raw.where(F.col("_corrupt_record").isNull()).select("*", nf.once(v31).alias("_v31"))
    d = d.select("*", v2.alias("_v2"), cwes.alias("_cwes"))
    d = d.where(F.col("_v31").isNotNull() & F.col("_v31.cvssData.baseScore").isNotNull())
    cd = F.col("_v31.cvssData")

    def comp(field: str) -> F.Column:
        return F.coalesce(cd[field], F.lit("UNKNOWN"))

    return d.select(
        F.coalesce(F.col("id"), F.lit("")).alias("cve_id"),
        cd["baseScore"].cast("double").alias("cvss31_score"),
        F.coalesce(F.col("_v2.cvssData.baseScore"), F.lit(0.0)).cast("double").alias("cvss2_score"),
        comp("attackVector").alias("attack_vector"),
        comp("attackComplexity").alias("attack_complexity"),
        comp("privilegesRequired").alias("privileges_required"),
        comp("userInteraction").alias("user_interaction"),
        comp("scope").alias("scope"),
        comp("confidentialityImpact").alias("confidentiality"),
        comp("integrityImpact").alias("integrity"),
        comp("availabilityImpact").alias("availability"),
        F.coalesce(F.col("_v31.exploitabilityScore"), F.lit(0.0)).cast("double").alias("exploitability_score"),
        F.coalesce(F.col("_v31.impactScore"), F.lit(0.0)).cast("double").alias("impact_score"),
        nf.any_tag(F.col("references"), "tags", "Exploit").alias("has_exploit"),
        nf.token_distinct_count(criteria, ":", 3, 4).alias("num_vendors"),
        nf.size0(F.col("_cwes")).alias("num_weaknesses"),
        nf.first_or(F.col("_cwes"), "NONE").alias("primary_cwe"),
        nf.size0(F.col("references")).alias("num_references"),
        F.coalesce(F.length(desc["value"]), F.lit(0)).alias("desc_length"),
        nf.year_prefix(F.col("published")).alias("year_published"),
        F.coalesce(F.col("vulnStatus"), F.lit("UNKNOWN")).alias("vuln_status"),
        band(cd["baseScore"], SEVERITY_CUTS, SEVERITY_NAMES).alias("severity"),
    )


@dataclass
class IngestReport:
    files: int
    valid: int
    malformed: int

    @property
    def skipped(self) -> int:
        return self.files - self.valid


def read_raw(spark: SparkSession, data_dir: str, year_min: int | None = DEFAULT_YEAR_MIN, max_files: int = 0) -> DataFrame:
    """The parsed documents of a directory, after the choice of files by name."""
    list_files(spark, data_dir)
    return parse(select_files(read_files(spark, data_dir), year_min, max_files))


def load_documents(spark: SparkSession, data_dir: str, year_min: int | None = DEFAULT_YEAR_MIN,
                   max_files: int = 0) -> DataFrame:
    """Choose, read and flatten the documents of a directory."""
    return flatten(read_raw(spark, data_dir, year_min, max_files))


def report(raw: DataFrame) -> IngestReport:
    """Documents considered, valid and malformed, in one pass."""
    r = raw.agg(F.count(F.lit(1)), F.coalesce(F.sum(is_valid().cast("long")), F.lit(0)),
                F.coalesce(F.sum(F.col("_corrupt_record").isNotNull().cast("long")), F.lit(0))).first()
    return IngestReport(int(r[0]), int(r[1]), int(r[2]))


def ingest_report(spark: SparkSession, data_dir: str, year_min: int | None = DEFAULT_YEAR_MIN, max_files: int = 0) -> IngestReport:
    """The report of a directory."""
    return report(read_raw(spark, data_dir, year_min, max_files))


def cache_path(base: str, year_min: int | None, max_files: int) -> str:
    """Cache location keyed by the ingest parameters."""
    return f"{base.rstrip('/')}/year_min={year_min or 0}/max_files={max_files}"


def materialize(df: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """I16: write Parquet and read it back (lineage cut, reusable cache)."""
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def digest(files: DataFrame) -> str:
    """A digest of a listing (names, sizes, times), independent of its order."""
    h = F.xxhash64("file_name", "length", "modified")
    r = files.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first()
    return f"{r[0]}:{r[1]}:{r[2]}"


def _manifest(spark: SparkSession, data_dir: str, path: str, year_min: int | None, max_files: int) -> dict[str, str]:
    """What a cache must agree on: its sources, its own parts, parameters and columns."""
    return {"sources": digest(list_files(spark, data_dir)), "parts": digest(list_files(spark, path, "*.parquet")),
            "parameters": f"{year_min or 0},{max_files}", "columns": ",".join(FLAT_COLUMNS)}


def cache_is_valid(spark: SparkSession, data_dir: str, path: str, year_min: int | None, max_files: int) -> bool:
    """Whether the cache holds what an ingest would write now, and all its parts as they were written."""
    try:
        noted = {r["name"]: r["value"] for r in spark.read.schema("name string, value string").json(path + MANIFEST).collect()}
        return noted == _manifest(spark, data_dir, path, year_min, max_files)
    except FileNotFoundError:
        return False
    except AnalysisException as e:
        if e.getCondition() and e.getCondition().startswith("PATH_NOT_FOUND"):
            return False
        raise


def load_data(spark: SparkSession, data_dir: str, cache_base: str, use_cache: bool = True,
              year_min: int | None = DEFAULT_YEAR_MIN, max_files: int = 0) -> DataFrame:
    """I16: the Parquet cache if its manifest agrees with the documents and its parts, else ingest and write both."""
    path = cache_path(cache_base, year_min, max_files)
    docs = load_documents(spark, data_dir, year_min, max_files)
    if use_cache and cache_is_valid(spark, data_dir, path, year_min, max_files):
        return spark.read.schema(docs.schema).parquet(path)
    out = materialize(docs, path)
    rows = list(_manifest(spark, data_dir, path, year_min, max_files).items())
    spark.createDataFrame(rows, "name string, value string").coalesce(1).write.mode("overwrite").json(path + MANIFEST)
    return out


def kpis(flat: DataFrame, label: str = "severity", year: str = "year_published",
         n_features: int | None = None) -> DataFrame:
    """Rows, class count, min/max year (and the feature count if given)."""
    cols = [F.count(F.lit(1)).alias("n_rows"), F.countDistinct(label).alias("n_classes"),
            F.min(year).alias("min_year"), F.max(year).alias("max_year")]
    out = flat.agg(*cols)
    return out if n_features is None else out.withColumn("n_features", F.lit(int(n_features)))


__all__ = ["CVE_SCHEMA", "FLAT_COLUMNS", "flatten", "parse", "load_documents", "load_data", "materialize", "compact",
           "load_compacted", "list_files", "select_files", "read_files", "read_raw", "kpis", "report", "IngestReport"]
