"""Document fingerprints as invertible Bloom lookup tables, with DataFrame functions only.

A text's paragraphs, overlong ones cut further by content, are hashed to 64-bit digests; each digest goes into one
cell of each of three subtables as (count, xor of digests, xor of checks).  The
difference of two tables holds the differing paragraphs alone: a cell with one
of them gives its digest, which is taken out of its other cells, and so on
until nothing is left.  When that gets stuck, the pair is tried again with a
larger table: the same cells for each of many segments of the digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A paragraph ends at a line end, or before a sentence that opens with a word of four letters or fewer.
PARAGRAPH = r"\n|(?<=[.!?])\x20(?=\p{Lu}\p{L}{0,3}[\x20,])"
#: Longer paragraphs (code points) are cut after a unit where a hash of it and the two before it is 0
#: modulo EVERY, and after MOST units at the latest.
LONG, EVERY, MOST = 240, 16, 32
#: A unit: a word of at most 24 letters, or one letter of a longer run (scripts without spaces).
UNIT = r"\s*+(?:\S{1,24}(?=\s|\z)|\S)|\s++"
SUBTABLES, PLACES = 3, 8
CELLS = SUBTABLES * PLACES
#: Digests a segment should hold at a retry; each retry makes segments this many times smaller.
PER_SEGMENT, SMALLER = 12, 3
RETRIES = 3
#: Peeling steps; each takes out all digests that are alone in a cell.  A longer chain is tried again as a stuck one.
STEPS = 10
FIELDS = ("n", "key", "check", *(f"p{j}" for j in range(SUBTABLES)))
CELL = "struct<i:int,n:int,key:bigint,check:bigint>"


def _cut(paragraph: Column) -> Column:
    """The pieces of an overlong paragraph; where they end depends on the words nearby, so an edit changes few."""
    def marked(units):
        return F.array_join(F.transform(units, lambda u, i: F.when(
            F.pmod(F.xxhash64(F.get(units, i - 2), F.get(units, i - 1), u), F.lit(EVERY)) == 0, F.concat(u, F.lit("\n")))
            .otherwise(u)), "")

    # An array of one binds the units, so that they are not read again for each of them.
    lines = F.get(F.transform(F.array(F.regexp_extract_all(paragraph, F.lit(UNIT), F.lit(0))), marked), F.lit(0))
    return F.flatten(F.transform(F.split(lines, "\n", -1), lambda x: F.regexp_extract_all(
        x, F.lit(f"(?:{UNIT}){{1,{MOST}}}"), F.lit(0))))


def digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs, overlong ones in pieces, that are not blank."""
    parts = F.flatten(F.transform(F.split(text, PARAGRAPH, -1), lambda p: F.when(
        F.length(p) > LONG, _cut(p)).otherwise(F.array(p))))
    parts = F.filter(parts, lambda p: F.trim(p) != "")
    return F.array_sort(F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p))))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit("check"))


def _cells_of(key: Column) -> list[Column]:
    """The digest's cell in each subtable."""
    return [(F.pmod(F.xxhash64(key, F.lit(j)), F.lit(PLACES)) + j * PLACES).cast("int") for j in range(SUBTABLES)]


def entries(keys: Column) -> Column:
    """The digests with their checks and cells, hashed once each; ``n`` is what each counts in a cell."""
    return F.transform(keys, lambda k: F.struct(
        F.lit(1).alias("n"), k.alias("key"), _check(k).alias("check"), *(c.alias(f"p{j}") for j, c in enumerate(_cells_of(k)))))


def table(items: Column) -> Column:
    """The cells of a set of digests, given as :func:`entries`."""
    def subtable(j):
        def cell(i):
            return F.aggregate(
                F.filter(items, lambda e: e[f"p{j}"] == i),
                F.struct(i.alias("i"), F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("key"),
                         F.lit(0).cast("bigint").alias("check")),
                lambda c, e: F.struct(c["i"].alias("i"), (c["n"] + e["n"]).alias("n"), c["key"].bitwiseXOR(e["key"]).alias("key"),
                                      c["check"].bitwiseXOR(e["check"]).alias("check")))

        return F.transform(F.array(*(F.lit(j * PLACES + x) for x in range(PLACES))), cell)

    return F.concat(*(subtable(j) for j in range(SUBTABLES)))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct(
        x["i"].alias("i"), (x["n"] - y["n"]).alias("n"), x["key"].bitwiseXOR(y["key"]).alias("key"),
        x["check"].bitwiseXOR(y["check"]).alias("check")))


def peel(cells: Column) -> Column:
    """struct<ok, a, b>: whether the difference came apart, and the digests of either side."""
    longs = F.array().cast("array<bigint>")

    def step(acc, _):
        # All that are alone in a cell leave together; one that is alone in several cells is one.
        pure = F.array_distinct(F.transform(
            F.filter(acc["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["check"] == _check(c["key"]))),
            lambda c: F.struct(c["n"].alias("n"), c["key"].alias("key"), c["check"].alias("check"),
                               F.array(*_cells_of(c["key"])).alias("at"))))

        def without(c, p):
            return F.struct(c["i"].alias("i"), (c["n"] - p["n"]).alias("n"), c["key"].bitwiseXOR(p["key"]).alias("key"),
                            c["check"].bitwiseXOR(p["check"]).alias("check"))

        def take(found):
            rest = F.transform(acc["cells"], lambda c: F.aggregate(
                F.filter(found, lambda p: F.array_contains(p["at"], c["i"])), c, without))
            side = lambda sign: F.transform(F.filter(found, lambda p: p["n"] == sign), lambda p: p["key"])
            return F.struct((F.size(found) == 0).alias("done"), rest.alias("cells"), F.concat(acc["a"], side(1)).alias("a"),
                            F.concat(acc["b"], side(-1)).alias("b"))

        # An array of one binds the found ones, so that they are not looked for again for each cell.
        return F.when(acc["done"], acc).otherwise(F.get(F.transform(F.array(pure), take), F.lit(0)))

    start = F.struct(F.lit(False).alias("done"), cells.cast(f"array<{CELL}>").alias("cells"), longs.alias("a"), longs.alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda acc: F.struct(
        F.forall(acc["cells"], lambda c: (c["n"] == 0) & (c["key"] == 0) & (c["check"] == 0)).alias("ok"),
        acc["a"].alias("a"), acc["b"].alias("b")))


def _count(peeled: Column, side: str) -> Column:
    """How many digests only ``side`` has, over the differences that came apart."""
    return F.aggregate(peeled, F.lit(0), lambda n, p: n + F.when(p["ok"], F.size(p[side])).otherwise(0))


def _grouped(items: Column, count: Column, coarse: Column) -> Column:
    """array of arrays: the entries of each segment 0 .. count - 1, cut in two steps of about equal width."""
    groups = F.transform(F.sequence(F.lit(0), F.floor((count - 1) / coarse).cast("int")), lambda g: F.struct(
        g.alias("g"), F.filter(items, lambda e: F.floor(e["s"] / coarse) == g).alias("items")))
    return F.flatten(F.transform(groups, lambda x: F.transform(
        F.sequence(x["g"] * coarse, F.least((x["g"] + 1) * coarse, count) - 1),
        lambda s: F.filter(x["items"], lambda e: e["s"] == s))))


def with_segments(t: DataFrame, name: str, items: str, per_segment: int, salt: int) -> DataFrame:
    """``t`` with ``name``: array<array>, the entries ``items`` by the segments of a larger table; null where they are."""
    t = t.withColumn("_n", F.when(F.col(items).isNotNull(), F.greatest(
        F.lit(1), F.ceil(F.size(items) / per_segment)).cast("int")))
    t = t.withColumn("_w", F.ceil(F.sqrt("_n")).cast("int"))
    t = t.withColumn("_e", F.when(F.col("_n").isNotNull(), F.transform(items, lambda e: F.struct(
        *(e[f].alias(f) for f in FIELDS),
        F.pmod(F.xxhash64(e["key"], F.lit(f"segment {salt}")), F.col("_n")).cast("int").alias("s")))))
    t = t.withColumn(name, F.when(F.col("_n").isNotNull(), _grouped(F.col("_e"), F.col("_n"), F.col("_w"))))
    return t.drop("_n", "_w", "_e")


def with_differing(t: DataFrame, name: str, cells_a: str, cells_b: str, a: str, b: str) -> DataFrame:
    """``t`` with ``name``: struct<n_a, n_b>, how many digests only either side has (``a``, ``b``: their entries).

    From the difference of the two tables; where that gets stuck, from that of
    larger tables, whose cells count the entries of ``b`` negatively, and for a
    segment that gets stuck again from larger ones of its own entries.
    What is left after all retries is compared digest by digest.
    """
    t = t.withColumn("_peeled", F.array(peel(subtract(F.col(cells_a), F.col(cells_b)))))
    both = F.concat(F.transform(a, lambda e: F.struct(*(e[f].alias(f) for f in FIELDS))),
                    F.transform(b, lambda e: F.struct((-e["n"]).alias("n"), *(e[f].alias(f) for f in FIELDS[1:]))))
    t = t.withColumns({"_na": _count(F.col("_peeled"), "a"), "_nb": _count(F.col("_peeled"), "b"),
                       "_left": F.when(~F.col("_peeled")[0]["ok"], both)})
    for k in range(RETRIES):
        t = with_segments(t, "_parts", "_left", max(1, PER_SEGMENT // SMALLER ** k), k)
        t = t.withColumn("_peeled", F.transform("_parts", lambda p: peel(table(p))))
        t = t.withColumn("_stuck", F.filter("_parts", lambda p, i: ~F.get(F.col("_peeled"), i)["ok"]))
        more = lambda side: F.coalesce(_count(F.col("_peeled"), side), F.lit(0))
        t = t.withColumns({"_na": F.col("_na") + more("a"), "_nb": F.col("_nb") + more("b"),
                           "_left": F.when(F.size("_stuck") > 0, F.flatten("_stuck"))})
    keys = lambda sign: F.transform(F.filter("_left", lambda e: e["n"] == sign), lambda e: e["key"])
    plain = lambda x: F.coalesce(F.size(F.array_except(keys(x), keys(-x))), F.lit(0))
    only = lambda n, x: F.col(n) + F.when(F.col("_left").isNull(), 0).otherwise(plain(x))
    t = t.withColumn(name, F.struct(only("_na", 1).alias("n_a"), only("_nb", -1).alias("n_b")))
    return t.drop("_peeled", "_parts", "_stuck", "_na", "_nb", "_left")


def likeness(cells: Column, d: Column) -> Column:
    """Shared digests by all digests, 0 to 1, from the cells of one side and the difference; two empty texts are alike."""
    count = F.aggregate(F.slice(cells, 1, PLACES), F.lit(0), lambda n, c: n + c["n"])
    every = count + d["n_b"]
    return F.when(every == 0, F.lit(1.0)).otherwise((count - d["n_a"]) / every)


def as_text(cells: Column) -> Column:
    return F.concat_ws(";", F.transform(cells, lambda c: F.concat_ws(
        ":", c["n"].cast("string"), F.lower(F.hex(c["key"])), F.lower(F.hex(c["check"])))))


def with_next(docs: DataFrame, columns: list[str], doc_id: str, tie: str, buckets: int) -> DataFrame:
    """``docs`` with next_<column>: that of the next row by (``doc_id`` nulls first, ``tie``), the first after the last.

    Ids are cut into ranges at sampled ids; a range also gets a copy of the row
    that follows it, so that one window per range sees all neighbours.
    """
    ids = docs.agg(F.percentile_approx(doc_id, [k / buckets for k in range(1, buckets)], 10_000).alias("cuts"),
                   F.min(doc_id).alias("least"), F.max(F.col(doc_id).isNull()).alias("nulls")).first()
    cuts = sorted(set(ids["cuts"] or []) - {ids["least"]})
    bounds = F.array(*[F.lit(c).cast("bigint") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    key = F.col(doc_id)
    bucket = F.when(key.isNull(), 0).otherwise(F.size(F.filter(bounds, lambda b: b <= key)))
    first = key.isNull() if ids["nulls"] else key == F.lit(ids["least"])
    place = lambda b, guard, wrap: F.struct(b.cast("int").alias("bucket"), F.lit(guard).alias("guard"), F.lit(wrap).alias("wrap"))
    places = F.filter(F.array(
        place(bucket, False, False),
        F.when(F.array_contains(bounds, key), place(bucket - 1, True, False)),
        F.when(first, place(F.lit(len(cuts)), True, True))), lambda p: p.isNotNull())
    spread = docs.withColumn("_p", F.explode(places))
    order = Window.partitionBy("_p.bucket").orderBy("_p.wrap", F.col(doc_id).asc_nulls_first(), tie)
    return (spread.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns))
            .where("NOT _p.guard").drop("_p"))


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """(``doc_id``, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next): a row for
    each row of ``docs``.

    ``edited`` is the text with its last quarter (code points, rounded down)
    replaced by the first as many of the next document's; likeness is the share
    of common paragraphs, or of common pieces of overlong ones.  Null texts are empty ones; rows without id come
    first, rows with equal ids follow by text; the only row is its own next;
    an empty table gives no rows.  ``doc_id`` is an integer.
    """
    n = buckets or max(8, min(2048, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    base = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = base.withColumn("own", digests(F.col("text")))
    t = with_next(base, ["text", "own"], "id", "text", n)
    chars, quarter = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    t = t.withColumn("edited", F.concat(F.substring("text", F.lit(1), chars - quarter), F.substring("next_text", F.lit(1), quarter)))
    t = t.select("id", chars.cast("bigint").alias("n_chars"), entries(F.col("own")).alias("own"),
                 entries(F.col("next_own")).alias("next_own"), "edited", entries(digests(F.col("edited"))).alias("new"))
    t = t.withColumns({"cells": table(F.col("own")), "new_cells": table(F.col("new")), "next_cells": table(F.col("next_own"))})
    t = with_differing(t, "d_edited", "cells", "new_cells", "own", "new")
    t = with_differing(t, "d_next", "cells", "next_cells", "own", "next_own")
    return t.select(
        F.col("id").alias(doc_id), "n_chars", "edited", as_text(F.col("cells")).alias("fingerprint"),
        as_text(F.col("new_cells")).alias("edited_fingerprint"),
        likeness(F.col("cells"), F.col("d_edited")).alias("near_edited"),
        likeness(F.col("cells"), F.col("d_next")).alias("near_next"))
