"""Parquet table loading for a scale-factor directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Row keys for hash sampling.  lineitem's (orderkey, linenumber) repeats, so the
# key adds part and supplier; the remaining columns break any leftover tie.
TABLE_KEYS = {
    "documents": ["doc_id"],
    "labels": ["doc_id"],
    "events": ["event_id"],
    "orders": ["o_orderkey"],
    "part": ["p_partkey"],
    "embeddings": ["vec_id"],
    "customer": ["c_custkey"],
    "supplier": ["s_suppkey"],
    "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
}
TABLE_TIEBREAK = {
    "lineitem": ["l_quantity", "l_extendedprice", "l_discount", "l_tax",
                 "l_returnflag", "l_linestatus", "l_shipdate"],
}


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    for n in names:
        load_table(spark, sf_dir, n).createOrReplaceTempView(n)
