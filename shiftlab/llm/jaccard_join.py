"""Exact Jaccard join of n-gram sets with set relations.

Equal sets are one class (exact copies and re-spaced copies meet there).  An
inverted index holds the rare-first prefix of every class; posting lists are
worked through by set size, so a block whose sizes can't reach the threshold is
skipped as a whole.  Relations between sets save the rest of the work:

* each class first meets one *pivot*, the most central class of most of its
  lists; the exact *delta* of the two sets (what is in one of them only) is kept,
  whether they are linked or not;
* classes that a pivot has linked are one group, and pairs within a group need
  no answer;
* two classes ``x, y`` with the same pivot have distance ``|delta x ^ delta y|``:
  the answers of one set follow from those of a highly similar one, no set is
  read again.  If both are linked to the pivot they are one group; otherwise a
  link needs ``(|delta x| + |delta y| - limit) / 2 >= 1`` common elements of
  their deltas, so a rare-first prefix index over the deltas finds them, and
  near copies with edits of their own never meet;
* groups meet by their closest pair first, so a crowd of near copies becomes
  one group after a few rounds and is never compared all with all;
* lists carry each class's size and the place of the shingle in its prefix (in
  whole hundredths of the set, which take less room in the shuffle): two
  classes whose sets behind those places are too small for the overlap skip each
  other, and parity sketches (512 bits in the lists, at least two bits a shingle
  after) bound the distance of the others from below; what is left is compared
  exactly.

Links are exact over 64-bit shingle hashes (odds of about 2**-64 a pair of
shingles or of classes to share one).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftlab.llm import bytearrays as ba
from shiftlab.llm.components import components
from shiftlab.llm.store import ready, small, written

SHINGLE = 5
PERCENT = 80
#: Most frequent shingles that every task knows, to put them last in a prefix
#: (8 bytes each).  It bounds only how well the order is fitted, not the join.
FREQUENT = 500_000
SKETCH_WORDS = 8
#: Rounds in which groups are compared by one pair each before single classes are.
ROUNDS = 4
#: Bits of the filter of wanted texts (8 MB), and partners of a head in one task's group.
FILTER_BITS = 1 << 26
GROUP_SETS = 512
#: A class keeps its delta to a pivot of up to this many times the distance of a link; one farther off is its
#: own pivot and meets the others in the lists.
DELTA_REACH = 3
PLACE = ba.U64(0x9FB21C651E98DF25)


def shingle_hashes(words: np.ndarray, at: np.ndarray, n: int):
    """(hash, text number) of each n-word shingle; a shorter text is one shingle."""
    count = np.diff(at)
    size = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    text = np.repeat(np.arange(len(count)), size)
    first = at[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)
    length = np.minimum(count, n)[text]
    h = np.zeros(len(first), ba.U64)
    for k in range(n):
        there = length > k
        h = ba.mix(h + np.where(there, words[np.minimum(first + k, len(words) - 1)] * PLACE, ba.U64(0)))
    return ba.mix(h ^ length.astype(ba.U64)), text


def distinct_sets(words: np.ndarray, at: np.ndarray, n: int):
    """(hashes sorted within each text, offsets of texts) of the distinct shingles."""
    h, text = shingle_hashes(words, at, n)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[keep], text[keep]
    return h, np.searchsorted(text, np.arange(len(at)))


def class_keys(h: np.ndarray, at: np.ndarray) -> list[int]:
    raw = h.tobytes()
    return [int.from_bytes(hashlib.blake2b(raw[8 * a:8 * b], digest_size=8).digest(), "little", signed=True)
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def sketches(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Parity of the set's hashes in each of 512 places; rows of 64-bit words."""
    n = len(at) - 1
    place = (ba.mix(h) >> ba.U64(55)).astype(np.int64)
    odd = np.bincount(ba.texts_of(at) * 512 + place, minlength=n * 512).reshape(n, 512) & 1
    return np.packbits(odd.astype(np.uint8), axis=1)


def wide_sketches(h: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Parity of a set's hashes in a power of two of places, at least twice its size; halves fold by xor."""
    out = []
    place = ba.mix(h)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        bits = max(9, int(2 * (b - a)).bit_length())
        odd = np.bincount((place[a:b] & ba.U64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits) & 1
        out.append(np.packbits(odd.astype(np.uint8)).tobytes())
    return out


def apart(x: bytes, y: bytes) -> int:
    """Places in which two wide sketches differ: a lower bound of the distance."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(a) > len(b):
        a = a[:len(a) // 2] ^ a[len(a) // 2:]
    while len(b) > len(a):
        b = b[:len(b) // 2] ^ b[len(b) // 2:]
    return int(np.bitwise_count(a ^ b).sum())


def _bounded(percent: int, reach: int = 1):
    """(a, b, limit, bound, and the pair's other columns) of pairs whose sketches do not rule a link out, or let
    expect a distance of at most ``reach`` times a link's."""
    def run(batches):
        for batch in batches:
            a, b, sa, sb, wa, wb = (batch.column(k) for k in range(6))
            others = batch.schema.names[6:]
            limit = far_apart(sa.to_numpy(), sb.to_numpy(), percent)
            low = np.array([apart(x, y) if m >= 0 else 1 for x, y, m in zip(
                wa.to_pylist(), wb.to_pylist(), limit.tolist(), strict=True)], np.int64)
            keep = low <= limit
            if reach > 1:
                # d shingles put an odd number into places / 2 * (1 - exp(-2 d / places)) places on average.
                places = 8 * np.minimum(pc.binary_length(wa).to_numpy(), pc.binary_length(wb).to_numpy())
                even = np.maximum(1 - 2 * low / places, 1e-9)
                keep |= (-places / 2 * np.log(even) <= reach * limit) & (limit >= 0)
            keep = pa.array(keep)
            yield pa.RecordBatch.from_arrays(
                [x.filter(keep) for x in (a, b, pa.array(limit), pa.array(low), *(batch.column(c) for c in others))],
                ["a", "b", "limit", "bound", *others])

    return run


def _sets(batch: pa.RecordBatch, n: int):
    """(first row, hashes, offsets) of each slice of a batch of texts."""
    data, offsets = ba.flat(batch.column(batch.schema.get_field_index("text")))
    for i, j in ba.slices(offsets):
        words, at = ba.word_hashes(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], ba.NOT_SPACE)
        yield i, *distinct_sets(words, at, n)


def _profile(n: int):
    """A row for each text (kind 0: id, row hash, key, size, sketches), and a row for the shingles that
    repeat among a batch's texts with their counts (kind 1)."""
    def run(batches):
        for batch in batches:
            keys, sizes, sketch, wide, seen = [], [], [], [], []
            for _, h, at in _sets(batch, n):
                keys += class_keys(h, at)
                sizes.append(np.diff(at))
                sketch += [row.tobytes() for row in sketches(h, at)]
                wide += wide_sketches(h, at)
                seen.append(h)
            if not keys:
                continue
            m = len(keys)
            h, c = np.unique(np.concatenate(seen), return_counts=True)
            h, c = h[c > 1], c[c > 1]
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([pa.array(np.zeros(m, np.int8)), pa.array(np.ones(len(h), np.int8))]),
                pa.concat_arrays([batch.column(0), pa.nulls(len(h), batch.schema.field(0).type)]),
                pa.concat_arrays([batch.column(1), pa.nulls(len(h), pa.int64())]),
                pa.concat_arrays([pa.array(keys, pa.int64()), ba.signed(h)]),
                pa.concat_arrays([pa.array(np.concatenate(sizes).astype(np.int64)), pa.array(c.astype(np.int64))]),
                pa.concat_arrays([pa.array(sketch, pa.binary()), pa.nulls(len(h), pa.binary())]),
                pa.concat_arrays([pa.array(wide, pa.binary()), pa.nulls(len(h), pa.binary())]),
            ], ["kind", "id", "rh", "key", "size", "sketch", "wide"])

    return run


def _prefixes(n: int, percent: int, frequent):
    """(shingle, class key, size, place in hundredths) of the first |x| - ceil(t|x|) + 1 shingles, frequent ones last."""
    def run(batches):
        hot = frequent.value
        rank = np.argsort(hot) if len(hot) else hot
        sorted_hot = hot[rank] if len(hot) else hot
        for batch in batches:
            seen: set[int] = set()
            for _, h, at in _sets(batch, n):
                key = np.array(class_keys(h, at), np.int64)
                # Copies within a batch have the same prefix: one of them stands for all.
                fresh = np.zeros(len(key), bool)
                fresh[np.unique(key, return_index=True)[1]] = True
                fresh &= ~np.isin(key, np.array(list(seen), np.int64))
                seen.update(key.tolist())
                text = ba.texts_of(at)
                late = np.zeros(len(h), np.int64)
                if len(hot):
                    k = np.searchsorted(sorted_hot, h)
                    k[k == len(hot)] = 0
                    late = np.where(sorted_hot[k] == h, rank[k] + 1, 0)
                size = np.diff(at)
                take = np.where(fresh, size - -(-size * percent // 100) + 1, 0)
                order = np.lexsort((h, late, text))
                place = np.arange(len(h)) - np.repeat(at[:-1], size)
                first = place < np.repeat(take, size)
                order = order[first]
                yield pa.RecordBatch.from_arrays(
                    [ba.signed(h[order]), pa.array(key[text[order]]), pa.array(size[text[order]].astype(np.int32)),
                     pa.array((place[first] * 100 // size[text[order]]).astype(np.int8))],
                    ["h", "key", "size", "place"])

    return run


def far_apart(size_a, size_b, percent: int):
    """The largest distance that two sets of these sizes may have to be linked."""
    # 100 o >= percent (a + b - o)  with  d = a + b - 2 o
    s = size_a + size_b
    need = -(-(percent * s) // (100 + percent))
    return s - 2 * need


def _in_lists(t: dict, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Pairs of a list of shingles that may be linked and have no answer through a pivot."""
    ok = t["pivot"][a] != t["pivot"][b]
    ok &= (t["pivot"][a] != t["key"][b]) & (t["key"][a] != t["pivot"][b])
    # A pair's first common shingle has nothing in common before it: the rest must hold the whole overlap.
    most = t["size"] - t["size"] * t["place"] // 100
    behind = np.minimum(most[a], most[b])
    ok &= 2 * behind >= t["size"][a] + t["size"][b] - limit
    a, b = a[ok], b[ok]
    ok[ok] = np.bitwise_count(t["sketch"][a] ^ t["sketch"][b]).sum(axis=1, dtype=np.int64) <= limit[ok]
    return ok


def _in_deltas(t: dict, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Pairs of a list of delta elements that may have enough of them in common."""
    behind = np.minimum(t["d"][a] - t["place"][a], t["d"][b] - t["place"][b])
    return 2 * behind >= t["d"][a] + t["d"][b] - limit


def _lists(percent: int, names: tuple[str, ...], test):
    """Pairs of different groups within each posting list that pass ``test``.

    Rows come sorted by (h, size); a list is held whole, pairs are tried by
    growing offset, and a row stops at the first size that is out of reach.
    """
    def pairs(t: dict):
        h, size, n = t["h"], t["size"], len(t["h"])
        alive, step = np.arange(n), 1
        while len(alive):
            alive = alive[alive + step < n]
            other = alive + step
            ok = (h[alive] == h[other]) & (size[other] * percent <= size[alive] * 100)
            alive = alive[ok]
            a = alive[t["root"][alive] != t["root"][alive + step]]
            b = a + step
            ok = test(t, a, b, far_apart(size[a], size[b], percent))
            a, b = a[ok], b[ok]
            yield np.minimum(t["key"][a], t["key"][b]), np.maximum(t["key"][a], t["key"][b])
            step += 1

    def run(batches):
        rest = None
        for batch in _ended(batches):
            if batch is not None:
                t = {k: batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in names if k != "sketch"}
                if "sketch" in names:
                    raw, _ = ba.flat(batch.column(batch.schema.get_field_index("sketch")))
                    t["sketch"] = raw.view(np.uint64).reshape(-1, SKETCH_WORDS)
                if rest is not None:
                    t = {k: np.concatenate([rest[k], t[k]]) for k in t}
                cut = int(np.searchsorted(t["h"], t["h"][-1])) if len(t["h"]) else 0
                rest = {k: v[cut:] for k, v in t.items()}
                t = {k: v[:cut] for k, v in t.items()}
            else:
                t = rest
            if t is None or not len(t["h"]):
                continue
            found = np.unique(np.concatenate([np.stack(p, 1) for p in pairs(t)] or [np.zeros((0, 2), np.int64)]), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return run


def _ended(batches):
    for b in batches:
        if b.num_rows:
            yield b
    yield None


def _among(bits: np.ndarray):
    """Rows whose hash may be wanted: a bit for each place of a fixed-size filter."""
    def run(batches):
        for batch in batches:
            place = batch.column(0).to_numpy(zero_copy_only=False) & (FILTER_BITS - 1)
            keep = bits.value[place >> 3] >> (place & 7).astype(np.uint8) & 1
            yield batch.filter(pa.array(keep.astype(bool)))

    return run


def _role_sets(n: int):
    """A text's set, once for each comparison group that it takes part in."""
    def run(batches):
        for batch in batches:
            roles = batch.column(batch.schema.get_field_index("roles"))
            for i, h, at in _sets(batch, n):
                own = roles.slice(i, len(at) - 1)
                times = own.value_lengths().to_numpy(zero_copy_only=False)
                parts = own.flatten()
                raw, back = h.tobytes(), np.repeat(np.arange(len(at) - 1), times)
                sets = pa.array([raw[8 * a:8 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())
                key = batch.column(batch.schema.get_field_index("key")).slice(i, len(at) - 1)
                for j in range(0, len(back), 2000):
                    some = pa.array(back[j:j + 2000])
                    yield pa.RecordBatch.from_arrays([
                        parts.field("head").slice(j, 2000), parts.field("salt").slice(j, 2000),
                        parts.field("member").slice(j, 2000), key.take(some), sets.take(some)],
                        ["head", "salt", "member", "key", "hashes"])

    return run


def _distances(percent: int, reach: int):
    """Distance of each member to the head of its group, with its delta if it is at most ``reach`` times a link's;
    the head's row comes first."""
    def run(batches):
        now, own = None, None
        for batch in batches:
            head, salt, member, key, sets = (c.to_pylist() for c in batch.columns)
            a, b, d, delta = [], [], [], []
            for g, s, m, k, raw in zip(head, salt, member, key, sets, strict=True):
                x = np.frombuffer(raw, np.uint64)
                if not m:
                    now, own = (g, s), x
                    continue
                if now != (g, s):
                    raise ValueError("a comparison group has no head")
                both = np.sort(np.concatenate([own, x]))
                same = both[1:] == both[:-1]
                a.append(k)
                b.append(g)
                d.append(len(both) - 2 * int(np.count_nonzero(same)))
                if d[-1] <= reach * far_apart(len(own), len(x), percent):
                    alone = np.ones(len(both), bool)
                    alone[1:] &= ~same
                    alone[:-1] &= ~same
                    delta.append(both[alone].view(np.int64))
                else:
                    delta.append(None)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (a, b, d)), pa.array(delta, pa.list_(pa.int64()))],
                                             ["a", "b", "d", "delta"])

    return run


def _measured(pairs: DataFrame, base: DataFrame, reps: DataFrame, n: int, percent: int, reach: int) -> DataFrame:
    """(a, b, d, delta): the exact distance of each pair of classes, and the shingles that only one of them has if
    it is at most ``reach`` times that of a link (0: only for equal sets).

    A class's set is rebuilt from the text of its representative row and moves
    once for each pair, to the group of the pair's other class (its head).  A
    head with many partners has its group split by salt, its own set in each
    part.  A filter of fixed size keeps most texts that no pair needs from the
    join; where it is too small for the data it only filters less.
    """
    parts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / GROUP_SETS).cast("int").alias("parts"))
    members = (pairs.join(parts, "b").select(F.col("a").alias("key"), F.col("b").alias("head"), F.pmod(
        F.xxhash64("a"), F.col("parts")).cast("int").alias("salt"), F.lit(True).alias("member")))
    heads = parts.select(F.col("b").alias("key"), F.col("b").alias("head"), F.explode(
        F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(False).alias("member"))
    roles = written(members.unionByName(heads).groupBy("key").agg(F.collect_list(F.struct("head", "salt", "member")).alias("roles"))
                    .join(reps, "key"), "roles")
    place = F.col("rh").bitwiseAND(F.lit(FILTER_BITS - 1))
    bits = (roles.select(place.alias("p")).groupBy(F.expr("p div 32768").alias("k"))
            .agg(F.bitmap_construct_agg(F.expr("p % 32768")).alias("bits")).toArrow())
    table = np.zeros(FILTER_BITS // 8, np.uint8)
    for k, raw in zip(bits["k"].to_pylist(), bits["bits"].to_pylist(), strict=True):
        table[k * 4096:k * 4096 + len(raw)] = np.frombuffer(raw, np.uint8)
    wanted = base.select("rh", "text").mapInArrow(
        _among(base.sparkSession.sparkContext.broadcast(table)), "rh bigint, text string")
    texts = wanted.join(roles, "rh").dropDuplicates(["rh"]).select("key", "text", "roles")
    sets = texts.mapInArrow(_role_sets(n), "head bigint, salt int, member boolean, key bigint, hashes binary")
    return (sets.repartition("head", "salt").sortWithinPartitions("head", "salt", "member")
            .mapInArrow(_distances(percent, reach), "a bigint, b bigint, d bigint, delta array<bigint>"))


def near_groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                percent: int = PERCENT, frequent: int = FREQUENT) -> DataFrame:
    """(``doc_id``, n_shingles, component_id, n_links): a row for each row of ``docs``.

    A text's set holds its distinct shingles of ``shingle`` words (lower-cased
    A-Z, split at ASCII white space); with fewer words, the whole sequence is
    one.  Two texts link when their Jaccard similarity is ``percent`` or more;
    component_id is the least id that links reach, ``n_links`` the links that
    were measured between the text's class and others (a lower bound, as pairs
    inside a group need no answer) plus those to rows of its own class.  Null
    and empty texts have an empty set, link with nothing and are their own
    component; repeated rows are copies like others; a row without id takes its
    component's least id (null if none has one); an empty table gives no rows.
    """
    rows, links = _linked(docs, doc_id, text, shingle, percent, frequent)
    return _result(rows, components(links), links, doc_id)


def first_rows(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
               percent: int = PERCENT, frequent: int = FREQUENT) -> DataFrame:
    """(rh): xxhash64 of id and text of one row for each component of :func:`near_groups`.

    It is the row of the least id, ids before none, and of equal ids the one of
    the least hash.  Texts without words are in no component.
    """
    rows, links = _linked(docs, doc_id, text, shingle, percent, frequent)
    place = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rh"))
    own = rows.where("size > 0").groupBy("key").agg(place.alias("first"))
    root = own.join(components(links).select(F.col("node").alias("key"), "root"), "key", "left")
    return root.groupBy(F.coalesce("root", "key")).agg(F.min("first").alias("first")).select("first.rh")


def _linked(docs: DataFrame, doc_id: str, text: str, shingle: int, percent: int, frequent: int) -> tuple[DataFrame, DataFrame]:
    """The rows (id, rh, key, size) with their classes, and the links between classes."""
    spark = docs.sparkSession
    ready(spark)
    base = docs.select(F.col(doc_id).alias("id"), F.xxhash64(doc_id, text).alias("rh"), F.col(text).alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    profile = written(base.mapInArrow(
        _profile(shingle), f"kind tinyint, id {kind}, rh bigint, key bigint, size bigint, sketch binary, wide binary"), "profile")
    rows = profile.where("kind = 0").drop("kind")
    counts = profile.where("kind = 1").groupBy("key").agg(F.sum("size").alias("n"))
    # At most `frequent` rows of 16 bytes reach the driver; the rarest of them first.
    hot = counts.where("n > 3").orderBy(F.desc("n"), "key").limit(frequent).select("key").toArrow()
    shared = spark.sparkContext.broadcast(np.array(hot.column(0).to_numpy()[::-1]).view(np.uint64))

    index = base.mapInArrow(_prefixes(shingle, percent, shared), "h bigint, key bigint, size int, place tinyint")
    list_of = Window.partitionBy("h")
    lists = written(index.withColumn("first", F.min("key").over(list_of))
                    .withColumn("last", F.max("key").over(list_of))
                    .where("first <> last").dropDuplicates(["h", "key"]).drop("first", "last"), "lists")

    classes = written(rows.where("size > 0").groupBy("key").agg(
        *(F.first(c).alias(c) for c in ("size", "sketch", "wide")), F.min("rh").alias("rh")), "classes")
    reps = classes.select("key", "rh")
    a = classes.select(F.col("key").alias("a"), F.col("size").alias("sa"), F.col("wide").alias("wa"))
    b = classes.select(F.col("key").alias("b"), F.col("size").alias("sb"), F.col("wide").alias("wb"))

    def bounded(pairs: DataFrame, reach: int = 1) -> DataFrame:
        others = [c for c in pairs.columns if c not in ("a", "b")]  # numbers
        return (pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb", "wa", "wb", *others)
                .mapInArrow(_bounded(percent, reach), ", ".join(f"{c} bigint" for c in ("a", "b", "limit", "bound", *others))))

    def compared(pairs: DataFrame, reach: int = 0) -> DataFrame:
        pairs = written(pairs, "pairs")
        found = _measured(pairs.select("a", "b"), base, reps, shingle, percent, reach)
        return written(pairs.join(found if reach else found.drop("delta"), ["a", "b"]), "measured")

    # Each class with its pivot: the class that leads most of its lists, where a list is led by its class that is
    # in most lists.  In a crowd of near copies that is the text with the fewest edits of its own.
    central = written(lists.groupBy("key").agg(F.count(F.lit(1)).alias("shared")), "central", tidy=False)
    led = (lists.select("h", "key").join(small(central)(central), "key")
           .withColumn("lead", F.max(F.struct("shared", "key")).over(list_of)["key"])
           .where("key <> lead").groupBy("key", "lead").count())
    pivot = led.groupBy("key").agg(F.max_by("lead", F.struct("count", "lead")).alias("pivot"))
    measured = compared(bounded(pivot.select(F.col("key").alias("a"), F.col("pivot").alias("b")), DELTA_REACH), DELTA_REACH)
    links = written(measured.where("d <= limit").select("a", "b"), "links")
    known = measured.where("delta IS NOT NULL").withColumnsRenamed({"a": "key", "b": "pivot"})
    group = components(links)

    # Then groups with groups: of two that share lists, the closest pair by sketch stands for both.  A round
    # costs a pair for each two groups, not for each two classes; it goes on while groups merge.
    rounds = 0
    while rounds < ROUNDS:
        star = (_tagged(lists, group, list_of).where("root <> lead.root")
                .select(F.col("key").alias("a"), F.col("lead.key").alias("b"), "root", F.col("lead.root").alias("head_root")).distinct())
        near = (bounded(star)
                .groupBy("root", "head_root").agg(F.min_by(F.struct("a", "b", "limit", "bound"), F.struct("bound", "a", "b")).alias("p"))
                .select("p.*"))
        found = compared(near)
        new = found.where("d <= limit").select("a", "b")
        if not new.limit(1).count():
            break
        links = written(links.unionByName(new), "links")
        group = components(links)
        rounds += 1

    # What is left: pairs of classes of different groups, by their deltas if they have the same pivot ...
    node = small(group)(group.select(F.col("node").alias("key"), "root"))
    side = known.select("key", "pivot", "d", "limit", "delta").join(classes.select("key", "size"), "key")
    deltas = side.join(node, "key", "left").withColumn("root", F.coalesce("root", "key"))
    shared = written(_delta_index(deltas, percent).repartition("h").sortWithinPartitions("h", "size", "key").mapInArrow(
        _lists(percent, ("h", "key", "size", "root", "d", "place"), _in_deltas), "a bigint, b bigint").distinct(), "shared")
    x, y = (side.select(F.col("key").alias(k), *(F.col(c).alias(c + k) for c in ("d", "delta", "size"))) for k in ("a", "b"))
    both = shared.join(x, "a").join(y, "b").withColumn(
        "d", F.col("da") + F.col("db") - 2 * F.size(F.array_intersect("deltaa", "deltab")))
    # 100 o >= percent (a + b - o)  with  2 o = a + b - d
    derived = both.where(f"(100 + {percent}) * (sizea + sizeb - d) >= 2 * {percent} * (sizea + sizeb)").select("a", "b")

    # ... and within the lists otherwise.
    tagged = _tagged(lists, group, list_of).join(known.select("key", "pivot"), "key", "left")
    sketched = tagged.withColumns({"pivot": F.coalesce("pivot", "key"), "size": F.col("size").cast("bigint"),
                                   "place": F.col("place").cast("bigint")}).join(classes.select("key", "sketch"), "key")
    tried = (sketched.repartition("h").sortWithinPartitions("h", "size", "key")
             .mapInArrow(_lists(percent, ("h", "key", "size", "root", "pivot", "place", "sketch"), _in_lists), "a bigint, b bigint")
             .distinct())
    tried = written(tried, "tried")
    last = compared(bounded(tried)).where("d <= limit").select("a", "b")
    return rows, written(links.unionByName(derived).unionByName(last).distinct(), "links")


def _delta_index(deltas: DataFrame, percent: int) -> DataFrame:
    """(h, key, size, d, place, root): the elements of deltas that two classes of a pivot have, rarest first.

    Of classes x, y with pivot p one at least is not linked to p, or they would
    be one group.  With r = (100 - percent) / (100 + percent), a pair is linked
    if its distance is at most r (|x| + |y|), and |y| <= |p| + |delta y|.  So
    two linked classes have more than (1 - r) / 2 |delta y| delta elements in
    common if x is not linked to p, and, as |delta y| >= |delta x| - r (|x| + |y|),
    at least e / (1 + r) with e = |delta x| - r (|x| + |p|): an element with
    fewer elements behind it can't be their first common one.
    """
    crowds = (deltas.groupBy("pivot").agg(F.count(F.lit(1)).alias("members"), F.max(F.col("d") > F.col("limit")).alias("far"))
              .where("members > 1 AND far").select("pivot"))
    each = deltas.join(crowds, "pivot", "left_semi").select(
        "key", "pivot", "d", "limit", "size", "root", F.explode("delta").alias("e"))
    often = each.groupBy("pivot", "e").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Elements of one class only come first; they meet no one and are only counted.
    own = Window.partitionBy("key")
    place = F.col("d") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("n", "e")) - 1
    p, behind = percent, F.col("d") - F.col("place")
    # r (|x| + |p|) is at most limit + 2, as limit rounds down by less than two.
    far = 200 * behind >= (F.col("d") - F.col("limit") - 2) * (100 + p)
    near = behind * (100 + p) >= F.col("d") * p
    return (each.join(often, ["pivot", "e"]).withColumn("place", place.cast("bigint"))
            .where(F.when(F.col("d") > F.col("limit"), far).otherwise(near))
            .select(F.xxhash64("pivot", "e").alias("h"), "key", "size", "d", "place", "root"))


def _tagged(lists: DataFrame, group: DataFrame, list_of) -> DataFrame:
    """The lists that hold more than one group, with each row's group and the list's first row."""
    node = small(group)(group.select(F.col("node").alias("key"), "root"))
    return (lists.select("h", "key", "size", "place").join(node, "key", "left")
            .withColumn("root", F.coalesce("root", "key"))
            .withColumn("r0", F.min("root").over(list_of)).withColumn("r1", F.max("root").over(list_of))
            .withColumn("lead", F.min(F.struct("key", "root")).over(list_of)).where("r0 <> r1").drop("r0", "r1"))


def _result(rows: DataFrame, groups: DataFrame, links: DataFrame, doc_id: str) -> DataFrame:
    own = rows.groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    degree = (links.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("others")))
    root = (own.join(groups.select(F.col("node").alias("key"), "root"), "key", "left")
            .join(degree, "key", "left").withColumn("root", F.coalesce("root", "key")))
    least = root.groupBy("root").agg(F.min("least").alias("component_id"))
    table = root.join(least, "root").select("key", "component_id", "copies", F.coalesce("others", F.lit(0)).alias("others"))
    empty = rows.where("size = 0")
    return (rows.where("size > 0").join(table, "key")
            .select(F.col("id").alias(doc_id), F.col("size").alias("n_shingles"), "component_id",
                    (F.col("copies") - 1 + F.col("others")).alias("n_links"))
            .unionByName(empty.select(F.col("id").alias(doc_id), F.col("size").alias("n_shingles"),
                                      F.col("id").alias("component_id"), F.lit(0).cast("bigint").alias("n_links"))))
