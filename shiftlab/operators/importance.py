"""Feature importance.

* P01 impurity importance of a random forest (``featureImportances``);
* P02 permutation importance: every (feature, repeat) permutation of the
  held-out rows is built by joining two hash ranks on (feature, rank), a donor being
  one number and a row one vector that meets its donors, so all F x R permuted copies are scored by one ``model.transform`` and
  one grouped macro-F1 aggregation;
* P04 the methods unioned with a ``method`` column;
* P05 rank aggregation across methods.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftlab.functions.hashing import DEFAULT_SEED
from shiftlab.operators import models as md
from shiftlab.operators.metrics import grouped_macro_f1
from shiftlab.operators import split as sp
from shiftlab.operators.sampling import hash_rank
from shiftlab.session import ensure_checkpoint_dir

IMPORTANCE_SCHEMA = "feature string, importance double"


def forest(features: str, label: str, trees: int = 100, depth: int = 10, seed: int = DEFAULT_SEED):
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featuresCol=features,
                                  labelCol=label)


def gini_importance(df: DataFrame, label: str, features: str, names: Sequence[str],
                    trees: int = 100, depth: int = 10, seed: int = DEFAULT_SEED) -> DataFrame:
    """Impurity importance, descending."""
    indexer, _ = md.label_indexer(df, label)
    model = forest(features, md.LABEL_IDX, trees, depth, seed).fit(indexer.transform(df))
    imp = model.featureImportances.toArray()
    spark = df.sparkSession
    rows = [(str(n), float(v)) for n, v in zip(names, imp)]
    return spark.createDataFrame(rows, IMPORTANCE_SCHEMA).orderBy(F.col("importance").desc(), "feature")


def permutation_importance(df: DataFrame, label: str, features: str, names: Sequence[str],
                           key: Sequence[str], n_repeats: int = 10, test_size: float = 0.2,
                           seed: int = DEFAULT_SEED, trees: int = 100, depth: int = 10) -> DataFrame:
    """Mean and population sd over repeats of the macro-F1 drop when one
    feature is permuted among the held-out rows."""
    indexer, classes = md.label_indexer(df, label)
    data = sp.train_test_split(indexer.transform(df), label, key, test_size, seed)
    train = data.where(F.col("split") == "train")
    test = data.where(F.col("split") == "test").withColumn("_arr", vector_to_array(features)).cache()
    model = forest(features, md.LABEL_IDX, trees, depth, seed).fit(train)
    base = grouped_macro_f1(model.transform(test).withColumn("_g", F.lit(0)), ["_g"], md.LABEL_IDX,
                            "prediction").first()["f1"]
    n_feat = len(names)
    ensure_checkpoint_dir(df.sparkSession)
    # A row's rank is its number too (keys may repeat); written, so that every use has the same.
    ranked = hash_rank(test, [], key, seed, rank_col="_ra").select("_ra", *key, md.LABEL_IDX, "_arr").checkpoint()
    # One number a donor: the value of one feature at one rank.
    donors = ranked.select(F.col("_ra").alias("_rb"), F.posexplode("_arr").alias("_f", "_dv"))
    grid = F.explode(F.array(*[F.struct(F.lit(f).alias("_f"), F.lit(r).alias("_r"))
                               for f in range(n_feat) for r in range(n_repeats)]))
    x = ranked.select("_ra", *key, grid.alias("_fr")).select("*", "_fr._f", "_fr._r").drop("_fr")
    x = hash_rank(x, ["_f", "_r"], ["_f", "_r", *key], seed + 1, rank_col="_rb", n_groups=n_feat * n_repeats)
    # Only numbers are shuffled: a row's vector meets all its donors at once, and is copied where it is scored.
    x = x.select("_ra", "_f", "_r", "_rb").join(donors.hint("merge"), ["_f", "_rb"])
    x = x.groupBy("_ra").agg(F.collect_list(F.struct("_f", "_r", "_dv")).alias("_given"))
    x = x.join(ranked.select("_ra", md.LABEL_IDX, "_arr").hint("merge"), "_ra")
    x = x.select(md.LABEL_IDX, "_arr", F.explode("_given").alias("_g")).select(md.LABEL_IDX, "_arr", "_g.*")
    swapped = F.concat(F.slice("_arr", F.lit(1), F.col("_f")), F.array("_dv"), F.slice("_arr", F.col("_f") + 2, F.size("_arr")))
    x = x.select("_f", "_r", md.LABEL_IDX, array_to_vector(swapped).alias(features))
    scored = grouped_macro_f1(model.transform(x), ["_f", "_r"], md.LABEL_IDX, "prediction")
    drops = scored.select("_f", (F.lit(float(base)) - F.col("f1")).alias("_d"))
    agg = drops.groupBy("_f").agg(F.avg("_d").alias("importance"), F.stddev_pop("_d").alias("std"))
    nm = F.array(*[F.lit(str(n)) for n in names])
    out = agg.select(F.element_at(nm, F.col("_f") + 1).alias("feature"), "importance", "std")
    out = out.checkpoint()  # materialise, then drop the cached hold-out
    test.unpersist()
    return out.orderBy(F.col("importance").desc(), "feature")


def all_importances(frames: dict[str, DataFrame]) -> DataFrame:
    """``(method, feature, importance)`` from per-method frames."""
    out = None
    for m, f in frames.items():
        part = f.select(F.lit(m).alias("method"), "feature", F.col("importance").cast("double"))
        out = part if out is None else out.unionByName(part)
    return out


def top_features(imp: DataFrame, top_n: int = 10) -> DataFrame:
    """1-based rank per method (importance desc, feature asc); a feature
    missing from a method gets the longest method's length; mean rank over the
    methods; the ``top_n`` best (ties: feature)."""
    methods = sorted(r[0] for r in imp.select("method").distinct().collect())
    if not methods:
        return imp.sparkSession.createDataFrame([], "feature string, avg_rank double")
    w = Window.partitionBy("method").orderBy(F.col("importance").desc(), F.col("feature").asc())
    ranked = imp.withColumn("rank", F.row_number().over(w))
    n_max = ranked.groupBy("method").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0]
    wide = ranked.groupBy("feature").pivot("method", methods).agg(F.first("rank"))
    cols = [F.coalesce(F.col(f"`{m}`"), F.lit(n_max)).alias(f"{m}_rank") for m in methods]
    wide = wide.select("feature", *cols)
    avg = sum((F.col(f"`{m}_rank`") for m in methods), F.lit(0)) / F.lit(float(len(methods)))
    return wide.withColumn("avg_rank", avg).orderBy("avg_rank", "feature").limit(top_n)
