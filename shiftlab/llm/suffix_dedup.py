"""Removal of byte strings that also start earlier, by sorted suffixes.

Every string of ``length`` bytes holds one *anchor*: the position of its least
``GRAM``-byte hash (leftmost), so equal strings have equal anchors at equal
offsets.  Only suffixes at anchors whose gram occurs again are sorted (about
one in 30 positions is an anchor at all):

1. anchors meet by the hash of their gram; those alone are done;
2. the others' suffixes, with what is left of them, go to the buckets that
   splitters, taken from a sample of suffixes, cut by leading bytes.  Equal contexts of a task have
   already been cut to their earliest one (all others lose their whole run of
   strings), so a passage in a third of the documents is not a third of the rows;
3. a bucket sorts the strings of each gram with a multikey sort, eight bytes a
   key, and marks the earliest of equal ones.  Equal leading bytes are never on
   two sides of a splitter, so no comparison crosses one;
4. a text's strings at repeated anchors are removed but for the marked ones.

Grams are found by 64-bit hashes; strings are compared by their bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftlab.llm import bytearrays as ba
from shiftlab.llm.store import ready, written

LENGTH = 100
GRAM = 32
#: Rows of the sample for the splitters, about; it bounds how evenly buckets are cut, nothing else.
SAMPLE_ROWS = 5000
BUCKETS_A_PARTITION = 8
#: Bytes of a text that are worked on at once; longer texts go in overlapping pieces.
PIECE = 1 << 21
POSITION_BITS = ba.U64(22)


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, from block-wise running minima."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, ba.U64)
    padded[:len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(first start, last start, anchor, gram hash) of the runs of starts with one anchor.

    ``ends``: the end of the text at each place where a text begins, as
    ``(begin, end)`` rows; a start counts if its string ends in its text.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, np.zeros(0, ba.U64)
    up, down = ba.powers(len(data) + 1)
    sums = np.empty(len(data) + 1, ba.U64)
    sums[0] = 0
    np.cumsum(ba.BYTE_VALUE[data] * up[:len(data)], out=sums[1:])
    m = len(data) - gram + 1
    h = ba.mix((sums[gram:] - sums[:-gram]) * down[:m])
    keyed = (h >> POSITION_BITS << POSITION_BITS) | np.arange(m, dtype=ba.U64)
    least = _sliding_least(keyed, length - gram + 1)
    at = (least & ((ba.U64(1) << POSITION_BITS) - ba.U64(1))).astype(np.int64)
    ok = np.zeros(len(at) + 1, np.int8)
    begin, stop = ends[:, 0], ends[:, 1] - length + 1
    long = stop > begin
    np.add.at(ok, begin[long], 1)
    np.add.at(ok, np.minimum(stop[long], len(at)), -1)
    starts = np.flatnonzero(np.cumsum(ok[:-1]) > 0)
    if not len(starts):
        return none, none, none, np.zeros(0, ba.U64)
    at = at[starts]
    cut = np.flatnonzero((at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)) + 1
    lo, hi = np.append(0, cut), np.append(cut, len(starts)) - 1
    return starts[lo], starts[hi], at[lo], h[at[lo]]


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int):
    """(bytes, (begin, end) rows, row numbers, places in the rows' texts) of pieces of texts."""
    for i, j in ba.slices(offsets, PIECE):
        a, b = int(offsets[i]), int(offsets[j])
        if b - a <= PIECE or j - i > 1:
            yield data[a:b], np.stack([offsets[i:j] - a, offsets[i + 1:j + 1] - a], 1), np.arange(i, j), np.zeros(j - i, np.int64)
            continue
        for k in range(a, max(b - length + 1, a + 1), PIECE):
            part = data[k:min(k + PIECE + length - 1, b)]
            yield part, np.array([[0, len(part)]]), np.array([i]), np.array([k - a])


def _runs(data, offsets, length, gram):
    """(row, first start, last start, anchor, gram hash) of all texts of a batch, places in their texts."""
    parts = []
    for part, spans, rows, place in _pieces(data, offsets, length):
        lo, hi, at, h = anchors(part, spans, length, gram)
        k = np.searchsorted(spans[:, 0], lo, "right") - 1
        # Of texts that begin at one place, all but the last are empty.
        shift = place[k] - spans[k, 0]
        parts.append((rows[k], lo + shift, hi + shift, at + shift, h))
    if not parts:
        z = np.zeros(0, np.int64)
        return z, z, z, z, np.zeros(0, ba.U64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _texts(batch: pa.RecordBatch):
    return ba.flat(batch.column(batch.schema.get_field_index("text")))


def _anchors(length: int, gram: int):
    """A row for each gram of a text's anchors, with how often it is one there."""
    def run(batches):
        for part in _sliced(batches, 4 * PIECE):
            row, _, _, _, h = _runs(*_texts(part), length, gram)
            order = np.lexsort((h, row))
            row, h = row[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            new = np.flatnonzero(new)
            rh = part.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([
                ba.signed(h[new]), pa.array(rh[row[new]]), pa.array(np.diff(np.append(new, len(h))).astype(np.int32))],
                ["h", "rh", "times"])

    return run


def _member(batch, row, h):
    """Whether the gram is among those listed for its row."""
    column = batch.column(batch.schema.get_field_index("grams"))
    listed = column.flatten().to_numpy(zero_copy_only=False).view(ba.U64)
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return np.isin(ba.mix(row.astype(ba.U64)) ^ h, ba.mix(owner.astype(ba.U64)) ^ listed)


def _contexts(length: int, gram: int, splitters: np.ndarray):
    """The bytes around each anchor with a listed gram; of equal ones with equal runs the earliest of a task's slice only."""
    reach = length - gram
    width = reach + length
    place = np.arange(width, dtype=np.int32)

    def run(batches):
        for part in _sliced(batches, 4 * PIECE):
            data, offsets = _texts(part)
            row, lo, hi, at, h = _runs(data, offsets, length, gram)
            keep = _member(part, row, h)
            row, lo, hi, at = (x[keep] for x in (row, lo, hi, at))
            ids = part.column(1).to_numpy(zero_copy_only=False)
            rh = part.column(0).to_numpy(zero_copy_only=False)
            # Bytes [lo, hi + length) at a fixed place: the anchor is at `reach`; zeros elsewhere.
            around = np.concatenate([np.zeros(reach, np.uint8), data, np.zeros(length, np.uint8)])
            context = sliding_window_view(around, width)[offsets[row] + at]
            context[(place < (lo - at + reach)[:, None]) | (place >= (hi + length - at + reach)[:, None])] = 0
            near, far = at - hi, at - lo
            kept = _earliest(context, near, far, ids[row], rh[row], at)
            context, row, at, near, far = (x[kept] for x in (context, row, at, near, far))
            lead = np.ascontiguousarray(context[:, reach:reach + 8]).view(">u8").reshape(-1).astype(ba.U64)
            bucket = np.searchsorted(splitters, lead, "right")
            raw = pa.py_buffer(np.ascontiguousarray(context))
            at_bytes = pa.py_buffer(np.arange(len(at) + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays([
                pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, at_bytes, raw]), pa.array(ids[row]), pa.array(rh[row]),
                pa.array(at), pa.array(near.astype(np.int32)), pa.array(far.astype(np.int32)), pa.array(bucket.astype(np.int32))],
                ["context", "id", "rh", "at", "near", "far", "bucket"])

    return run


def _sliced(batches, most: int):
    """The batches in slices of rows with about ``most`` bytes of text."""
    for batch in batches:
        _, offsets = _texts(batch)
        for i, j in ba.slices(offsets, most):
            yield batch.slice(i, j - i)


def _leads(length: int, gram: int):
    """The first eight bytes of each anchor's gram, as a number that sorts like them."""
    def run(batches):
        for part in _sliced(batches, 4 * PIECE):
            data, offsets = _texts(part)
            row, _, _, at, _ = _runs(data, offsets, length, gram)
            lead = sliding_window_view(data, 8)[offsets[row] + at] if len(at) else np.zeros((0, 8), np.uint8)
            words = np.ascontiguousarray(lead).view(">u8").reshape(-1).astype(ba.U64)
            yield pa.RecordBatch.from_arrays([ba.signed(words ^ ba.U64(1 << 63))], ["lead"])

    return run


def splitters(base: DataFrame, buckets: int, length: int, gram: int, sample: int = SAMPLE_ROWS) -> np.ndarray:
    """``buckets - 1`` leading words that cut a bounded sample of the suffixes into equal parts."""
    rows = base.count()
    some = base.where(F.pmod(F.xxhash64("rh"), F.lit(max(1, rows // sample))) == 0)
    leads = some.select("text").mapInArrow(_leads(length, gram), "lead bigint")
    cuts = leads.agg(F.percentile_approx("lead", [k / buckets for k in range(1, buckets)], 10_000)).first()[0] or []
    return np.unique(np.array(cuts, np.int64).view(ba.U64) ^ ba.U64(1 << 63))


def _starts(t: dict):
    """(rh, start) of all strings of contexts."""
    n = t["far"] - t["near"] + 1
    owner = np.repeat(np.arange(len(n)), n)
    d = t["near"][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    return t["rh"][owner], t["at"][owner] - d


def _earliest(context, near, far, ids, rh, at, group=None) -> np.ndarray:
    """The rows that are the earliest of those with equal contexts and runs."""
    if not len(at):
        return np.zeros(0, np.int64)
    words = _words8(context)
    h = np.zeros(len(at), ba.U64) if group is None else group.astype(ba.U64)
    for k in range(words.shape[1]):
        h = ba.mix(h * ba.BASE + words[:, k] + ba.U64(k))
    order = np.lexsort((at, rh, ids, far, near, h))
    a, b = order[1:], order[:-1]
    same = (h[a] == h[b]) & (near[a] == near[b]) & (far[a] == far[b]) & (context[a] == context[b]).all(1)
    return order[np.append(True, ~same)]


def _words8(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as big-endian 64-bit words, zero-padded."""
    pad = -rows.shape[1] % 8
    return np.ascontiguousarray(np.pad(rows, ((0, 0), (0, pad)))).view(">u8").astype(ba.U64)


def multikey_order(words: np.ndarray, ties: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(order, whether a row equals the one before it) by the words of each row, then by ``ties``.

    A multikey sort: each word is looked at only within the rows that are still
    equal, and what a word tells apart is not touched again.
    """
    n = len(words)
    order = np.argsort(words[:, 0], kind="stable")
    new = np.ones(n, bool)
    new[1:] = words[order[1:], 0] != words[order[:-1], 0]
    for k in range(1, words.shape[1]):
        part = np.cumsum(new)
        open_ = np.flatnonzero(~new | np.append(~new[1:], False))
        if not len(open_):
            break
        rows = order[open_]
        inner = np.lexsort((words[rows, k], part[open_]))
        order[open_] = rows = rows[inner]
        same_part = part[open_][1:] == part[open_][:-1]
        new[open_[1:]] = ~same_part | (words[rows[1:], k] != words[rows[:-1], k])
    part = np.cumsum(new)
    open_ = np.flatnonzero(~new | np.append(~new[1:], False))
    if len(open_):
        rows = order[open_]
        order[open_] = rows[np.lexsort((*(t[rows] for t in ties), part[open_]))]
    return order, ~new


def _firsts(length: int, gram: int):
    """The earliest starts of equal strings, as runs (rh, from, to); rows come sorted by gram."""
    reach = length - gram

    def settle(t: dict):
        once = _earliest(t["context"], t["near"], t["far"], t["id"], t["rh"], t["at"], t["group"])
        t = {k: v[once] for k, v in t.items()}
        alone = np.bincount(t["group"] - t["group"].min())[t["group"] - t["group"].min()] == 1
        lone = _starts({k: v[alone] for k, v in t.items()})
        t = {k: v[~alone] for k, v in t.items()}
        if not len(t["at"]):
            return lone
        n = t["far"] - t["near"] + 1
        owner = np.repeat(np.arange(len(n)), n)
        d = t["near"][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        group = t["group"][owner]
        width = reach + length
        strings = sliding_window_view(np.ascontiguousarray(t["context"]).reshape(-1), length)[owner * width + reach - d]
        words = np.concatenate([group[:, None].astype(ba.U64), _words8(strings)], 1)
        start = t["at"][owner] - d
        order, again = multikey_order(words, (start, t["rh"][owner], t["id"][owner]))
        # One string at one start may come from copies of a row: the same document.
        first = order[~again]
        return np.concatenate([lone[0], t["rh"][owner[first]]]), np.concatenate([lone[1], start[first]])

    def run(batches):
        rest, held = None, 0
        for batch in _with_end(batches):
            if batch is not None:
                raw, _ = ba.flat(batch.column(0))
                t = {name: batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(np.int64)
                     for name in ("id", "rh", "at", "near", "far")}
                t["context"] = raw.reshape(-1, reach + length)
                if rest is not None:
                    t = {k: np.concatenate([rest[k], t[k]]) for k in t}
                grams = t["context"][:, reach:reach + gram]
                new = np.append(True, (grams[1:] != grams[:-1]).any(1))
                t["group"] = np.cumsum(new)
                cut = int(np.flatnonzero(new)[-1])
                rest = {k: v[cut:] for k, v in t.items() if k != "group"}
                t = {k: v[:cut] for k, v in t.items()}
            else:
                t = rest
                if t is not None:
                    t["group"] = np.ones(len(t["at"]), np.int64)
            if t is None or not len(t["at"]):
                continue
            for part in _blocks(t):
                rh, start = settle(part)
                order = np.lexsort((start, rh))
                rh, start = rh[order], start[order]
                cut = np.flatnonzero((rh[1:] != rh[:-1]) | (start[1:] != start[:-1] + 1)) + 1
                lo, hi = np.append(0, cut), np.append(cut, len(rh)) - 1
                yield pa.RecordBatch.from_arrays([pa.array(rh[lo]), pa.array(start[lo]), pa.array(start[hi])], ["rh", "lo", "hi"])

    return run


def _blocks(t: dict, most: int = 4000):
    """Whole groups, together about ``most`` rows."""
    n = len(t["group"])
    i = 0
    while i < n:
        j = int(np.searchsorted(t["group"], t["group"][min(i + most, n) - 1], "left"))
        if j <= i:
            j = int(np.searchsorted(t["group"], t["group"][i], "right"))
        if i + most >= n:
            j = n
        yield {k: v[i:j] for k, v in t.items()}
        i = j


def _with_end(batches):
    for b in batches:
        if b.num_rows:
            yield b
    yield None


def _cut(length: int, gram: int):
    def run(batches):
        for batch in _sliced(batches, PIECE):
            data, offsets = _texts(batch)
            row, lo, hi, _, h = _runs(data, offsets, length, gram)
            keep = _member(batch, row, h)
            row, lo, hi = row[keep], lo[keep], hi[keep]
            cover = np.zeros(len(data) + 1, np.int64)
            # Starts that go: those of repeated anchors, without the earliest ones.
            gone = np.zeros(len(data) + 1, np.int64)
            np.add.at(gone, offsets[row] + lo, 1)
            np.add.at(gone, offsets[row] + hi + 1, -1)
            gone = np.cumsum(gone)[:len(data)] > 0
            firsts = batch.column(batch.schema.get_field_index("firsts"))
            spans = firsts.flatten()
            sizes = firsts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            if len(spans):
                base = offsets[np.repeat(np.arange(len(sizes)), sizes)]
                stay = np.zeros(len(data) + 1, np.int64)
                np.add.at(stay, base + spans.field("lo").to_numpy(zero_copy_only=False), 1)
                np.add.at(stay, base + spans.field("hi").to_numpy(zero_copy_only=False) + 1, -1)
                gone &= ~(np.cumsum(stay)[:len(data)] > 0)
            starts = np.flatnonzero(gone)
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + length, -1)
            removed = np.cumsum(cover[:-1]) > 0
            total = np.concatenate([[0], np.cumsum(removed)])
            begins = removed.copy()
            begins[1:] &= ~removed[:-1]
            inner = offsets[1:-1][offsets[1:-1] < len(data)]
            begins[inner] = removed[inner]
            runs = np.concatenate([[0], np.cumsum(begins)])
            kept = [data[a:b][~removed[a:b]].tobytes() if total[b] > total[a] else data[a:b].tobytes()
                    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                batch.column(1), pa.array(np.diff(offsets)), pa.array(np.diff(total[offsets])),
                pa.array(np.diff(runs[offsets])), pa.array(kept, pa.binary())],
                ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
                   gram: int = GRAM) -> DataFrame:
    """(``doc_id``, n_bytes, n_removed, n_spans, kept): a row for each row of ``docs``.

    Every byte of a text (UTF-8; null: empty) covered by a string of ``length``
    bytes that also starts earlier goes; ``kept`` is the rest, ``n_spans`` the
    maximal removed runs.  Earlier is a smaller id, or the same document and an
    earlier start; strings are judged on the input.  ``doc_id`` is an integer;
    rows without id come last.  Rows with equal ids are told apart by the hash
    of their text; rows equal in both are one document and get equal results.
    Texts shorter than ``length`` stay whole; an empty table gives no rows.
    """
    if not gram < length <= PIECE:
        raise ValueError("gram < length <= PIECE is needed")
    ready(docs.sparkSession)
    base = docs.select(F.xxhash64(doc_id, text).alias("rh"), F.col(doc_id).cast("bigint").alias("id"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = base.select("rh", "text").mapInArrow(_anchors(length, gram), "h bigint, rh bigint, times int")
    of_gram = Window.partitionBy("h")
    again = (found.withColumn("n", F.sum("times").over(of_gram)).where("n > 1")
             .groupBy("rh").agg(F.collect_set("h").alias("grams")))
    again = written(again, "grams")
    order_id = F.coalesce("id", F.lit((1 << 63) - 1)).alias("id")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = splitters(base.select("rh", "text"), n * BUCKETS_A_PARTITION, length, gram)
    contexts = (base.select("rh", order_id, "text").join(again, "rh").dropDuplicates(["rh"])
                .select("rh", "id", "text", "grams")
                .mapInArrow(_contexts(length, gram, cuts), "context binary, id bigint, rh bigint, at bigint, "
                            "near int, far int, bucket int"))
    firsts = (contexts.repartition(n, "bucket").sortWithinPartitions(F.substring("context", length - gram + 1, gram))
              .mapInArrow(_firsts(length, gram), "rh bigint, lo bigint, hi bigint")
              .groupBy("rh").agg(F.collect_list(F.struct("lo", "hi")).alias("firsts")))
    marks = written(again.join(firsts, "rh", "left"), "firsts")
    return (base.join(marks, "rh", "left").select("rh", "id", "text", "grams", "firsts")
            .mapInArrow(_cut(length, gram), "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
            .withColumnRenamed("id", doc_id))
