"""Plans whose cost must grow no faster than their input."""
import re

from pyspark.sql import functions as F

from shiftlab.operators.sampling import draw_with_replacement


def test_draws_and_offsets_are_not_broadcast(spark):
    rows = spark.range(4000).select("id", (F.col("id") % 2).cast("string").alias("g"))
    out = draw_with_replacement(rows, 20_000, ["g"], ["id"])
    assert out.count() == 40_000
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "HashJoin" in line and ("_rank" in line or re.search(r"_sh_b#\d+\], \[", line))]
    assert "SortMergeJoin" in plan and not joins


def test_permutation_ranks_carry_no_vectors(spark, monkeypatch):
    from pyspark.ml.functions import array_to_vector

    from shiftlab.operators import importance as im

    seen, rank = [], im.hash_rank
    monkeypatch.setattr(im, "hash_rank", lambda df, by, *a, **k: (seen.append((list(by), df.columns)), rank(df, by, *a, **k))[1])
    df = spark.range(60).select("id", (F.col("id") % 2).cast("string").alias("y"), array_to_vector(
        F.array((F.col("id") % 2).cast("double"), (F.col("id") % 7).cast("double"))).alias("x"))
    df = df.unionByName(df.where("id < 10"))  # keys may repeat
    got = {r["feature"]: r["importance"] for r in im.permutation_importance(df, "y", "x", ["a", "b"], ["id"], 2, trees=3, depth=3).collect()}
    assert set(got) == {"a", "b"} and got["a"] > got["b"]
    assert [c for by, c in seen if by == ["_f", "_r"]] and not any("_arr" in c for by, c in seen if by)


def test_a_document_is_parsed_once(spark):
    from shiftlab.sources import ingest as ig

    good = '{"id": "CVE-1", "metrics": {"cvssMetricV31": [{"type": "Primary", "cvssData": {"baseScore": 5.0}}]}}'
    docs = spark.createDataFrame([("a", good), ("b", good[:40]), ("c", ""), ("d", None)], "file_name string, doc string")
    flat = ig.flatten(ig.parse(docs))
    assert flat._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert [(r["cve_id"], r["cvss31_score"]) for r in flat.collect()] == [("CVE-1", 5.0)]
    assert ig.parse(docs).count() == 4
