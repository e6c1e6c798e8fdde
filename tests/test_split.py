"""Split quotas: driver and distributed largest-remainder give the same counts."""

from pyspark.sql import functions as F

from shiftlab.operators import split as sp
from shiftlab.sources.tables import load_table
from tests.conftest import SF01


def test_largest_remainder_twins_agree(spark):
    cases = [[("a", 7), ("b", 7), ("c", 7)], [("x", 620), ("y", 145), ("z", 129), ("w", 106)],
             [("p", 1), ("q", 2), ("r", 3), ("s", 5)]]
    for sizes in cases:
        total = sum(n for _, n in sizes)
        for target in (1, 2, 5, total // 3, total - 1):
            local = sp.largest_remainder(sizes, target)
            counts = spark.createDataFrame(sizes, "c string, n long")
            dist = {r["c"]: r["_q"] for r in sp.stratified_quota(counts, "c", total, target).collect()}
            assert local == dist, (sizes, target)
            assert sum(local.values()) == target


def test_split_is_stratified_and_stable(spark):
    d = load_table(spark, SF01, "documents")
    s = sp.train_test_split(d, "lang", ["doc_id"])
    t = {r["lang"]: r["count"] for r in s.where(F.col("split") == "test").groupBy("lang").count().collect()}
    assert sum(t.values()) == 200
    assert t == sp.largest_remainder([("en", 620), ("fr", 145), ("de", 129), ("es", 106)], 200)
    a = sorted(r[0] for r in sp.train_test_split(d.repartition(5), "lang", ["doc_id"])
               .where(F.col("split") == "test").select("doc_id").collect())
    b = sorted(r[0] for r in s.where(F.col("split") == "test").select("doc_id").collect())
    assert a == b
