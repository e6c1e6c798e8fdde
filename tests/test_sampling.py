"""Exact-size sampling: counts, membership, and independence from partitioning."""

from pyspark.sql import functions as F

from shiftlab.operators import rebalance as rb
from shiftlab.operators.sampling import draw_with_replacement, hash_rank, sample_exact
from shiftlab.sources.tables import load_table
from tests.conftest import SF01


def _ids(df, col="doc_id"):
    return sorted(r[0] for r in df.select(col).collect())


def test_sample_exact_counts_and_subset(spark):
    d = load_table(spark, SF01, "documents")
    s = sample_exact(d, 100, ["lang"], ["doc_id"])
    counts = {r["lang"]: r["count"] for r in s.groupBy("lang").count().collect()}
    assert counts == {"en": 100, "fr": 100, "de": 100, "es": 100}
    assert s.join(d, "doc_id", "left_anti").count() == 0
    assert s.select("doc_id").distinct().count() == 400


def test_sample_exact_is_partition_independent(spark):
    d = load_table(spark, SF01, "documents")
    a = _ids(sample_exact(d.repartition(1), 77, ["lang"], ["doc_id"]))
    b = _ids(sample_exact(d.repartition(37), 77, ["lang"], ["doc_id"]))
    assert a == b


def test_quota_larger_than_group_keeps_all(spark):
    d = load_table(spark, SF01, "documents")
    assert sample_exact(d, 10_000, ["lang"], ["doc_id"]).count() == d.count()
    assert sample_exact(d, 0, ["lang"], ["doc_id"]).count() == 0


def test_hash_rank_is_dense_permutation(spark):
    d = load_table(spark, SF01, "documents")
    r = hash_rank(d, ["lang"], ["doc_id"])
    g = r.groupBy("lang").agg(F.min("hash_rank").alias("lo"), F.max("hash_rank").alias("hi"),
                              F.count(F.lit(1)).alias("n"), F.countDistinct("hash_rank").alias("nd")).collect()
    for row in g:
        assert row["lo"] == 0 and row["hi"] == row["n"] - 1 and row["nd"] == row["n"]


def test_draws_are_members_and_exact(spark):
    d = load_table(spark, SF01, "documents")
    x = draw_with_replacement(d, 333, ["lang"], ["doc_id"])
    counts = {r["lang"]: r["count"] for r in x.groupBy("lang").count().collect()}
    assert counts == {"en": 333, "fr": 333, "de": 333, "es": 333}
    # every draw is a row of its own class
    bad = x.join(d.select("doc_id", F.col("lang").alias("l2")), "doc_id").where(F.col("lang") != F.col("l2"))
    assert bad.count() == 0
    a = _ids(draw_with_replacement(d.repartition(3), 50, ["lang"], ["doc_id"]))
    b = _ids(draw_with_replacement(d.repartition(29), 50, ["lang"], ["doc_id"]))
    assert a == b


def test_rebalance_target_counts(spark):
    d = load_table(spark, SF01, "documents")
    # en 620, fr 145, de 129, es 106 at sf0.01
    up = rb.rebalance_target(d, "lang", 0.29, ["doc_id"])
    t = int(106 + (620 - 106) * 0.29)
    assert t == 255
    counts = {r["lang"]: r["count"] for r in up.groupBy("lang").count().collect()}
    assert counts == {"en": 620, "fr": 255, "de": 255, "es": 255}
    down = rb.rebalance_target(d, "lang", -0.5, ["doc_id"])
    t = max(int(620 - (620 - 106) * 0.5), 106)
    counts = {r["lang"]: r["count"] for r in down.groupBy("lang").count().collect()}
    assert counts == {"en": t, "fr": 145, "de": 129, "es": 106}


def test_identity_below_threshold(spark):
    d = load_table(spark, SF01, "documents")
    for kind in rb.KINDS:
        col = {"target": "lang", "binary": "n_chars", "continuous": "n_chars", "categorical": "lang"}[kind]
        assert rb.rebalance(d, col, kind, 0.005, ["doc_id"]) is d


def test_binary_degenerate_returns_input(spark):
    d = load_table(spark, SF01, "labels").where(F.col("toxic") == 0)
    out = rb.rebalance_binary(d, "toxic", 0.5, ["doc_id"])
    assert out.count() == d.count()


def test_categorical_null_goes_to_rest(spark):
    d = spark.createDataFrame([(i, "a" if i < 6 else (None if i < 8 else "b")) for i in range(10)],
                              "id long, c string")
    g = {r["group"]: r["count"] for r in rb.majority_groups(d, "c").groupBy("group").count().collect()}
    assert g == {"major": 6, "rest": 4}
    down = rb.rebalance_categorical(d, "c", -1.0, ["id"])
    # majority cut to max(int(6 * 0.2), 4) = 4; rest (with NULLs) kept
    assert down.where(F.col("c") == "a").count() == 4
    assert down.where(F.col("c").isNull()).count() == 2


def test_exact_median_matches_pandas(spark):
    import pandas as pd

    from shiftlab.operators.quantile import exact_median

    vals = [float((i * 7919) % 1013) for i in range(3000)] + [None] * 5
    d = spark.createDataFrame([(v,) for v in vals], "v double")
    assert exact_median(d, "v") == pd.Series(vals, dtype="float64").median()


def test_exact_median_takes_several_passes(spark, monkeypatch):
    import pandas as pd

    from shiftlab.operators import quantile as qm

    monkeypatch.setattr(qm, "HIST_BINS", 16)
    vals = [float(i % 97) * 1.5 + (i % 3) for i in range(5000)]
    d = spark.createDataFrame([(v,) for v in vals], "v double")
    assert qm.exact_median(d, "v") == pd.Series(vals).median()
    assert qm.exact_quantile(d, "v", 0.25) == pd.Series(vals).quantile(0.25)
