"""Copies of drawn rows: no hot keys, both sides of a split by default, none across it in train scope."""

from pyspark.sql import functions as F

from shiftlab.operators import models as md
from shiftlab.operators import rebalance as rb
from shiftlab.operators import split as sp
from shiftlab.operators.sampling import draw_with_replacement


def test_few_rows_drawn_very_often_are_dealt_over_tasks(spark):
    names = {"spark.sql.shuffle.partitions": "200", "spark.sql.adaptive.enabled": "false"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    try:
        df = spark.createDataFrame([(i, "a") for i in range(3)], "id long, c string")
        out = draw_with_replacement(df, 1_000_000, ["c"], ["id"], draw_id="n")
        parts = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(parts) == 1_000_000 and max(parts) <= 20_000
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def test_copies_fall_on_both_sides_unless_only_training_rows_are_resampled(spark):
    df = spark.range(210).select("id", F.when(F.col("id") < 200, "a").otherwise("b").alias("y"), (F.col("id") % 3).alias("v"))
    up = rb.rebalance_target(df, "y", 1.0, ["id"], copy_col=rb.COPY)
    assert up.count() == 400 and up.select("id", rb.COPY).distinct().count() == 400
    sides = sp.train_test_split(up, "y", ["id", rb.COPY]).where("y = 'b'").groupBy("id").agg(F.countDistinct("split").alias("n"))
    assert sides.where("n = 2").count() > 5
    seen = []

    def resample(train):
        seen.append({r["id"] for r in train.collect()})
        return rb.rebalance_target(train, "y", 1.0, ["id"])

    got = md.run_loop(df, "y", None, ["id"], md.value_majority("m", F.col("v")), cv_folds=0, resample=resample)
    split = sp.train_test_split(df, "y", ["id"])
    assert seen[0] == {r["id"] for r in split.where("split = 'train'").collect()}
    assert got.confusion.agg(F.sum("n")).first()[0] == 42  # the test part of the 210 rows, untouched
