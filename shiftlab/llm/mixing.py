"""Mixing sources to target weights by Pareto order sampling.

A document's expected copies ``e`` come from its source's target; ``floor(e)``
whole copies are certain, and the rest is an inclusion probability ``p`` for
one more.  Within a stratum (a source's documents of one size octave) the
documents are ranked by ``(u / (1 - u)) / (p / (1 - p))`` and the fixed number
with the least ratios is taken.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftlab.llm.store import written

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_COPIES = 2.0
#: How far expected copies lean to shorter documents, as a part of what bounds allow (0: not at all).
LEAN = 0.5
BUCKETS = 1024
SEED = 20
WORD = "[^\\x20\\x09-\\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
                   most: float = MOST_COPIES) -> DataFrame:
    """``sizes`` (source, source_size: a row a source) with target.

    ``target = least(most * source_size, level * weight)`` where the level makes
    the targets sum to ``share`` of all sizes: what capped sources leave is
    reshared by weight until none is above.  The level is found in one pass over
    the sources in order of ``cap / weight``.  One row a source meets in the
    window, never a document.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    t = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(most))
    t = t.withColumn("r", F.col("cap") / F.col("w"))
    order = Window.orderBy("r", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    heft = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    t = t.withColumn("level", left / heft)
    level = F.first(F.when(F.col("level") <= F.col("r"), F.col("level")), ignorenulls=True).over(everything)
    target = F.least(F.col("cap"), F.coalesce(level, F.lit(float("inf"))) * F.col("w"))
    return t.withColumn("target", target).select("source", "source_size", "target")


def _unit(*parts: Column) -> Column:
    """A number in (0, 1), fixed by the parts."""
    h = F.pmod(F.xxhash64(*parts), F.lit(1 << 52))
    return (h.cast("double") + 0.5) / F.lit(float(1 << 52))


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES,
        lean: float = LEAN, seed: int = SEED) -> DataFrame:
    """(``doc_id``, size, source_size, target, copies, taken): a row for each row of ``docs``.

    ``size`` counts words; ``taken = copies * size`` with ``copies`` at most
    ``most``.  Each source's taken words come near its target: the counts of its
    strata carry their rounding to the next smaller octave.  Null and empty
    texts have size 0 and take nothing; null is a source of its own, last by
    order; rows without id and repeated rows are documents like others (equal
    rows share a random number, and any of them may be taken); an empty table
    gives no rows.  Reruns agree: the random numbers are hashes of id and text.

    ``e = f + d * (b - mean b)`` with ``f = target / source_size``,
    ``b = 1 / (1 + ln(1 + size))`` (mean by words) and
    ``d = lean * least(f, most - f)``, so that ``0 <= e <= most`` and the
    expected words of a source are its target.
    """
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("bigint")
    base = docs.select(F.col(doc_id).alias("id"), F.col(source).alias("source"), size.alias("size"),
                       _unit(F.lit(seed), F.col(doc_id), F.col(text)).alias("u"))
    b = 1.0 / (1.0 + F.log1p("size"))
    base = written(base.withColumn("b", b), "mix-sizes")
    per_source = base.groupBy("source").agg(F.sum("size").alias("source_size"),
                                            F.sum(F.col("b") * F.col("size")).alias("bw"))
    targets = source_targets(per_source.select("source", "source_size"), weights, share, most)
    plan = written(targets.withColumnRenamed("source", "s0").join(
        per_source.select("source", "bw"), F.col("s0").eqNullSafe(F.col("source")))
        .select("s0", "source_size", "target", (F.col("bw") / F.greatest("source_size", F.lit(1))).alias("mean_b")),
        "mix-targets")

    f = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    e = f + F.lit(lean) * F.least(f, F.lit(most) - f) * (F.col("b") - F.col("mean_b"))
    rows = (base.join(plan, F.col("source").eqNullSafe(F.col("s0")))
            .withColumn("e", F.greatest(F.lit(0.0), F.least(F.lit(most), e)))
            .withColumn("sure", F.floor("e"))
            .withColumn("p", F.when(F.col("size") > 0, F.col("e") - F.col("sure")).otherwise(F.lit(0.0)))
            .withColumn("octave", F.when(F.col("size") > 0, F.floor(F.log2("size"))).otherwise(F.lit(-1)).cast("int"))
            .select("id", "source", "size", "source_size", "target", "u", "sure", "p", "octave"))

    drawn = F.col("p") > 0
    strata = rows.where(drawn).groupBy("source", "octave").agg(
        F.count(F.lit(1)).alias("n"), F.sum("p").alias("sp"), F.sum(F.col("p") * F.col("size")).alias("words"))
    # At most 63 octaves a source: fold from the largest, carrying the words that rounding leaves.
    folded = (strata.groupBy("source").agg(F.expr("""
        aggregate(sort_array(collect_list(named_struct('octave', octave, 'n', n, 'sp', sp, 'words', words)), false),
          named_struct('carry', 0.0D, 'out', cast(array() AS array<struct<octave:int,take:bigint,odds:double>>)),
          (a, x) -> named_struct(
            'carry', a.carry + x.words - least(x.n, greatest(0L, cast(round((a.carry + x.words) / (x.words / x.sp)) AS bigint))) * (x.words / x.sp),
            'out', concat(a.out, array(named_struct('octave', x.octave,
              'take', least(x.n, greatest(0L, cast(round((a.carry + x.words) / (x.words / x.sp)) AS bigint))),
              'odds', (x.sp / x.n) / greatest(1e-12D, 1 - x.sp / x.n))))),
          a -> a.out)""").alias("out"))
              .select(F.col("source").alias("s1"), F.inline("out").alias("o1", "take", "odds")))
    ratio = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    ranked = (rows.join(folded, F.col("source").eqNullSafe(F.col("s1")) & (F.col("octave") == F.col("o1")) & drawn, "left")
              .withColumn("q", F.when(drawn, ratio))
              # Scaled by the stratum's odds, the ratio spreads evenly over buckets.
              .withColumn("bucket", F.floor(F.col("q") * F.col("odds") / (1 + F.col("q") * F.col("odds")) * BUCKETS))
              .drop("s1", "o1", "odds", "u", "p"))
    ranked = written(ranked, "mix-ranked")
    counts = ranked.where("q IS NOT NULL").groupBy("source", "octave", "bucket").agg(F.count(F.lit(1)).alias("n"))
    up_to = (Window.partitionBy("source", "octave").orderBy("bucket")
             .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(F.col("source").alias("s2"), F.col("octave").alias("o2"), F.col("bucket").alias("b2"),
                            F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("source", "octave", "bucket").orderBy("q", "id", "size"))
    picked = (ranked.where("q IS NOT NULL").withColumn("place", place)
              .join(offsets, F.col("source").eqNullSafe(F.col("s2")) & (F.col("octave") == F.col("o2"))
                    & (F.col("bucket") == F.col("b2")))
              .withColumn("more", (F.col("place") + F.col("before") <= F.col("take")).cast("bigint")))
    keep = ["id", "size", "source_size", "target", "sure", "more"]
    every = picked.select(*keep).unionByName(
        ranked.where("q IS NULL").withColumn("more", F.lit(0).cast("bigint")).select(*keep))
    copies = F.when(F.col("size") > 0, F.col("sure") + F.col("more")).otherwise(F.lit(0)).cast("bigint")
    return every.select(F.col("id").alias(doc_id), "size", "source_size", "target", copies.alias("copies"),
                        (copies * F.col("size")).alias("taken"))
