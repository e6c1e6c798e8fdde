"""Benchmark decontamination with suffix arrays over the training documents.

Each shard (a slice of a partition's documents) becomes one sequence of word
numbers with a suffix array; every suffix of the test set is looked up in it
with two binary searches, which give the range of its verbatim occurrences by
the first words of a window.  What is found there is followed to its full
length: the places in shard and test set get ranks by stretches of doubled
length, and the test suffixes next to a place in that order share most with it.
A document is whole in its row, so the result needs no shuffle; the test set
is given to the tasks in blocks of bounded size, one narrow pass a block.

Words are compared by 64-bit hashes.  A word that is in no test item can be in
no match, so only runs of test words long enough for a window enter the array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from shiftlab.llm import bytearrays as ba
from shiftlab.llm.store import ready

WINDOW = 10
#: Bytes of test text that a task holds at once.
BLOCK_BYTES = 16 << 20
MATCHES = "array<struct<start:int,length:int,item:string,item_start:int>>"


class TestWindows:
    """The distinct windows of a block of test items, as fixed-width keys."""

    __test__ = False

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        self.window = window
        data, offsets = ba.flat(pa.array([t for _, t in items], pa.large_string()))
        hashes, at = ba.word_hashes(data, offsets, ba.WORD_CHAR)
        self.vocabulary, ids = np.unique(hashes, return_inverse=True)
        ids = ids.astype(np.int64).reshape(-1) + 1
        owners: dict[tuple[int, ...], set[str]] = {}
        for i, (item, _) in enumerate(items):
            words = ids[at[i]:at[i + 1]].tolist()
            length = min(window, len(words))
            for j in range(len(words) - length + 1) if length else ():
                owners.setdefault(tuple(words[j:j + length]), set()).update([] if item is None else [item])
        self.windows = list(owners)
        self.owners = [sorted(owners[w]) for w in self.windows]
        number = {w: i + 1 for i, w in enumerate(self.windows)}
        #: Number of the full window that begins at each word of the items, 0 for none; an item's words are followed by a 0.
        self.items = [item for item, _ in items]
        self.begins, self.item_of, self.item_start = _begins(ids, at, number, window)
        self.lengths = np.array([len(w) for w in self.windows], np.int64)
        self.shortest = int(self.lengths.min()) if len(self.windows) else 0
        low = np.zeros((len(self.windows), window), ">u4")
        high = np.full((len(self.windows), window), 0xFFFFFFFF, ">u4")
        for i, w in enumerate(self.windows):
            low[i, :len(w)] = high[i, :len(w)] = w
        self.low, self.high = keys(low), keys(high)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers from 1; 0 for a word that no item has."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        k = np.searchsorted(self.vocabulary, hashes)
        k[k == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[k] == hashes, k + 1, 0)


def _begins(ids: np.ndarray, at: np.ndarray, number: dict, window: int):
    """(number of the window that begins there or 0, item, word position) of all words of the items and an end each."""
    words, size = ids.tolist(), np.diff(at) + 1
    of = np.repeat(np.arange(len(size)), size)
    start = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    begins = np.zeros(len(of), np.int64)
    for k in np.flatnonzero(start + window < size[of]).tolist():
        j = int(at[of[k]] + start[k])
        begins[k] = number[tuple(words[j:j + window])]
    return begins, of, start


def keys(rows: np.ndarray) -> np.ndarray:
    """Rows of big-endian word numbers as byte strings that sort alike."""
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1] * 4}").reshape(-1) if len(rows) else np.zeros(0, "S4")


def suffix_array(words: np.ndarray, run: np.ndarray, starts: np.ndarray, depth: int):
    """(keys, positions) of the suffixes that begin at ``starts``, sorted.

    A key has the first ``depth`` words as far as the run of known words goes.
    """
    at = starts[:, None] + np.arange(depth)
    short = np.arange(depth) >= run[starts][:, None]
    rows = np.where(short, 0, words[np.minimum(at, len(words) - 1)]).astype(">u4")
    k = keys(rows)
    order = np.argsort(k, kind="stable")
    return k[order], starts[order]


def runs(known: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each word, how many known words of its text follow from it on."""
    n = len(known)
    stop = np.zeros(n + 1, bool)
    stop[n] = True
    stop[:n] = ~known
    cut = np.zeros(n + 1, bool)
    cut[n] = True
    if n:
        cut[1:n] = text[1:] != text[:-1]
    # The first position after p at which the run ends: a stop at or after p, or a text border after p.
    where = np.arange(n + 1)
    next_stop = np.minimum.accumulate(np.where(stop, where, n)[::-1])[::-1]
    next_cut = np.minimum.accumulate(np.where(cut, where, n)[::-1])[::-1]
    return np.where(known, np.minimum(next_stop[:n], np.append(next_cut[1:], n)[:n]) - where[:n], 0)


def matches(words: np.ndarray, words_at: np.ndarray, test: TestWindows):
    """(test window, word position) of all verbatim occurrences in a shard."""
    none = np.zeros(0, np.int64)
    if not len(test.windows) or not len(words):
        return none, none
    run = runs(words > 0, ba.texts_of(words_at))
    starts = np.flatnonzero(run >= test.shortest)
    if not len(starts):
        return none, none
    sorted_keys, positions = suffix_array(words, run, starts, test.window)
    lo = np.searchsorted(sorted_keys, test.low, "left")
    hi = np.searchsorted(sorted_keys, test.high, "right")
    n = hi - lo
    w = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
    return w, positions[lo[w] + inside]


def _chain(numbers: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window numbers with a 0 before each one that is ``apart`` from the last, and at the end; where the numbers are)."""
    where = np.arange(len(numbers)) + np.cumsum(apart)
    chain = np.zeros(len(numbers) + int(apart.sum()) + 1, np.int64)
    chain[where] = numbers
    return chain, where


def longest_matches(position: np.ndarray, number: np.ndarray, text: np.ndarray, test: TestWindows):
    """(length in words, place in ``test.begins``) of the longest verbatim match from each of the ``position`` on.

    ``position`` ascends; the full window there has ``number`` and lies in ``text``.
    Two places that share n windows in a row share n + window - 1 words.
    """
    places = np.flatnonzero(np.isin(test.begins, number))
    apart = np.concatenate([[True], (np.diff(position) != 1) | (text[1:] != text[:-1])])
    mine, at = _chain(number, apart)
    theirs, there = _chain(test.begins[places], np.concatenate([[True], np.diff(places) != 1]))
    chain, there = np.concatenate([mine, theirs]), there + len(mine)
    ends = np.flatnonzero(chain == 0)
    run = ends[np.searchsorted(ends, np.arange(len(chain)))] - np.arange(len(chain))
    ranks, k = [chain], 1
    while k < run[at].max():  # ranks by twice as many windows from those of both halves
        rank = ranks[-1]
        after = np.append(rank[k:] + 1, np.zeros(min(k, len(rank)), np.int64))
        ranks.append(np.unique(rank * (len(chain) + rank.max() + 2) + after, return_inverse=True)[1].reshape(-1))
        k *= 2
    order = np.argsort(ranks[-1][there], kind="stable")
    suffixes = ranks[-1][there][order]
    after = np.searchsorted(suffixes, ranks[-1][at], "right")
    length, place = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for near in (np.maximum(after - 1, 0), np.minimum(after, len(order) - 1)):
        other, shared = there[order[near]], np.zeros(len(at), np.int64)
        for level in range(len(ranks) - 1, -1, -1):
            x, y = at + shared, other + shared
            inside = (x < len(chain)) & (y < len(chain))
            same = inside & (ranks[level][np.where(inside, x, 0)] == ranks[level][np.where(inside, y, 0)])
            shared += same * (1 << level)
        shared = np.minimum(shared, run[at])
        better = shared > length
        length[better], place[better] = shared[better], places[order[near]][better]
    return length + test.window - 1, place


def _scan(batch: pa.RecordBatch, text: str, test: TestWindows) -> list[tuple]:
    """(n_words, hit positions, items, longest matches as (start, length, item, start in the item)) of each row."""
    data, offsets = ba.flat(batch.column(batch.schema.get_field_index(text)))
    out: list[tuple] = []
    for i, j in ba.slices(offsets):
        hashes, at = ba.word_hashes(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], ba.WORD_CHAR)
        window, position = matches(test.numbers(hashes), at, test)
        cover = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(cover, position, 1)
        np.add.at(cover, position + test.lengths[window], -1)
        hit = np.cumsum(cover[:-1]) > 0
        row = np.searchsorted(at, position, "right") - 1
        per: dict[int, set[str]] = {}
        for t, w in set(zip(row.tolist(), window.tolist(), strict=True)):
            per.setdefault(t, set()).update(test.owners[w])
        found: dict[int, list[tuple]] = {}
        full = np.isin(window + 1, test.begins)
        order = np.argsort(position[full], kind="stable")
        if len(order):
            p, t = position[full][order], row[full][order]
            length, place = longest_matches(p, window[full][order] + 1, t, test)
            for x in zip(t.tolist(), (p - at[t]).tolist(), length.tolist(), test.item_of[place].tolist(),
                         test.item_start[place].tolist(), strict=True):
                found.setdefault(x[0], []).append((x[1], x[2], test.items[x[3]], x[4]))
        for t, p, w in zip(row[~full].tolist(), position[~full].tolist(), window[~full].tolist(), strict=True):
            found.setdefault(t, []).append((p - int(at[t]), int(test.lengths[w]), next(iter(test.owners[w]), None), 0))
        for t in range(j - i):
            where = np.flatnonzero(hit[at[t]:at[t + 1]]) if t in per else np.zeros(0, np.int64)
            out.append((int(at[t + 1] - at[t]), where, per.get(t, set()), _outer(found.get(t, []))))
    return out


def _outer(found: list[tuple]) -> list[tuple]:
    """The matches that do not lie within another one."""
    out, end = [], 0
    for x in sorted(found, key=lambda x: (x[0], -x[1])):
        if x[0] + x[1] > end:
            out.append(x)
            end = x[0] + x[1]
    return out


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list[tuple]]:
    """Test items in blocks of bounded bytes, one partition at a time on the driver."""
    block, size = [], 0
    for row in benchmark.select(F.col(item).cast("string"), F.coalesce(F.col(text), F.lit(""))).toLocalIterator():
        if block and size + len(row[1]) > block_bytes:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len(row[1])
    yield block


def find(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id",
         item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
         prefix: str = "") -> DataFrame:
    """``docs`` with n_words, hit_words (positions of hit words), items, matches and longest (words).

    A window is ``window`` consecutive words of a test item; an item of fewer
    words, but not none, is one window.  A document word inside any verbatim
    occurrence is hit.  ``matches`` are the longest verbatim matches that lie in no
    other one: start, length, an item that holds it (null: one without id) and
    the start there, in words; ``longest`` is the longest one's length.  All columns of ``docs`` stay; the new names take
    ``prefix`` and must not be in ``docs``.  Null and empty texts have no words
    and no hits; repeated rows each get their result; an empty test set gives
    no hits.  An item without id hits words but is in no list of items.
    """
    new = [f"{prefix}{n}" for n in ("n_words", "hit_words", "items", "matches", "longest")]
    if clash := set(new) & set(docs.columns):
        raise ValueError(f"docs already has {sorted(clash)}; give another prefix")
    ready(docs.sparkSession)
    kinds = ("bigint", "array<int>", "array<string>", MATCHES, "bigint")
    out, first = docs, True
    for block in _blocks(benchmark, item_id, item_text, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(TestWindows(block, window))
        target = StructType(list(docs.schema.fields))
        for name, kind in zip(new, kinds, strict=True):
            target = target.add(StructField(name, StructType.fromDDL(f"x {kind}")[0].dataType))
        out = out.mapInArrow(_mapper(shared, text, new, first), target)
        first = False
    return out


def _mapper(shared, text: str, new: list[str], first: bool):
    fields = ("start", "length", "item", "item_start")
    kind = pa.list_(pa.struct([pa.field(f, pa.string() if f == "item" else pa.int32()) for f in fields]))

    def run(batches):
        test = shared.value
        for batch in batches:
            found = _scan(batch, text, test)
            if not first:
                old = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in new[1:4]]
                found = [(n, np.union1d(where, np.array(h, np.int64)), items | set(i), _outer([tuple(x.values()) for x in m] + own))
                         for (n, where, items, own), h, i, m in zip(found, *old, strict=True)]
            base = [batch.column(k) for k, n in enumerate(batch.schema.names) if n not in new]
            names = [n for n in batch.schema.names if n not in new]
            yield pa.RecordBatch.from_arrays([
                *base,
                pa.array([x[0] for x in found], pa.int64()),
                pa.array([x[1].astype(np.int32) for x in found], pa.list_(pa.int32())),
                pa.array([sorted(x[2]) for x in found], pa.list_(pa.string())),
                pa.array([[dict(zip(fields, m, strict=True)) for m in x[3]] for x in found], kind),
                pa.array([max((m[1] for m in x[3]), default=0) for x in found], pa.int64()),
            ], [*names, *new])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, max_hits: int = 0, **options) -> DataFrame:
    """The documents with at most ``max_hits`` words inside test windows; same columns."""
    found = find(docs, benchmark, prefix="_decontam_", **options)
    return found.where(F.size("_decontam_hit_words") <= max_hits).select(*[f"`{c}`" for c in docs.columns])
