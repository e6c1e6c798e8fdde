"""Ranked lexical search by range-maximum queries over posting lists.

The documents of a task are cut into shards.  In a shard every term has a
posting list in document order, with the integer impact of each posting, and a
sparse table over it: entry j of a posting names the largest impact among 2**j
postings from there on, so two lookups give the maximum of any range.

An item's search starts with the whole shard as one interval of documents.  The
interval with the highest bound, the sum over the item's terms of weight times
the list's maximum in the interval, is taken next.  It is split at the document
where its most promising term has its maximum; that document is scored, and the
halves go back with bounds of their own.  Short intervals are scored whole.  The
search ends when no bound reaches the item's tenth score, which is carried from
shard to shard.  A task returns its ten best of each item; two ranked steps,
first within salted parts, then over all, leave the ten best.

Scores are the integers the query's contract names, so results do not depend
on the order of work; equal scores go by ascending doc_id.

The items are a given query set, held in every task in blocks of a bounded
number of terms; each block passes over the documents once.  Term statistics
(document frequencies, document count, total length) cover all documents.

Odd rows: a null or wordless text is in no result and counts in no statistic.
Rows of ``items`` with the same (or null) item_id are one item whose terms are
added up; an item without terms has no rows.  Documents with a null or repeated
doc_id are documents of their own, a null one ranks last among equal scores.  An
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftlab.llm.store import ready, written

K = 10
#: A shard ends at so many documents or postings.
SHARD_DOCS, SHARD_POSTINGS = 4096, 1 << 20
#: Intervals of at most so many documents are scored whole.
WHOLE_DOCS = 256
#: Terms (of items, with the items they are in) that a block of items may have.
BLOCK_TERMS = 400_000
#: Parts of an item's candidates that are ranked before all are.
PARTS = 32

#: Bytes of terms, lower-cased; the others separate them.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text: maximal runs of letters, digits and characters beyond ASCII, A-Z lower-cased."""
    return text.encode().translate(_FOLD).split(b" ") if text else []


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, n): how often each term is in an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, t, n) for i, text in enumerate(batch.column(1).to_pylist())
                     for t, n in Counter(filter(None, terms(text))).items()]
            at, term, n = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(term, pa.binary()), pa.array(n, pa.int64())],
                names=["item_id", "term", "n"])

    kind = items.schema["item_id"].dataType.simpleString()
    return (items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, term binary, n bigint")
            .groupBy("item_id", "term").agg(F.sum("n").alias("n")))


def postings(docs: DataFrame, vocabulary) -> DataFrame:
    """(doc_id, n, terms, tfs): a document's length and its postings of the vocabulary's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            n, ids, tfs, ends = [], [], [], [0]
            for text in batch.column(1).to_pylist():
                found = Counter(terms(text))
                found.pop(b"", None)
                n.append(found.total())
                held = [(known[t], c) for t, c in found.items() if t in known]
                ids += [i for i, _ in held]
                tfs += [c for _, c in held]
                ends.append(len(ids))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int64()))], names=["doc_id", "n", "terms", "tfs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n bigint, terms array<int>, tfs array<bigint>")


def document_frequencies(found: DataFrame, width: int) -> np.ndarray:
    """In how many documents each of the vocabulary's terms occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(width, np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(), minlength=width)
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(df[used])], names=["term", "df"])

    out = np.zeros(width, np.int64)
    for term, df in (found.select("terms").mapInArrow(run, "term bigint, df bigint")
                     .groupBy("term").agg(F.sum("df")).toLocalIterator()):  # at most the block's terms
        out[term] = df
    return out


class Shard:
    """Posting lists of some documents, each with its sparse table."""

    def __init__(self, docs: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, width: int):
        self.docs = docs
        self.key = term.astype(np.int64) * docs + doc
        order = np.argsort(self.key)
        self.key, self.impact, self.doc = self.key[order], impact[order], doc[order]
        self.ends = np.cumsum(np.bincount(term, minlength=width))
        self.starts = np.concatenate([[0], self.ends[:-1]])
        longest = int((self.ends - self.starts).max(initial=0))
        table = [np.arange(len(self.key), dtype=np.int32)]
        for j in range(1, longest.bit_length()):
            last, step = table[-1], 1 << (j - 1)
            other = np.concatenate([last[step:], np.broadcast_to(last[-1], step)])[:len(last)]
            table.append(np.where(self.impact[other] > self.impact[last], other, last))
        self.table = np.stack(table) if len(self.key) else np.zeros((1, 0), np.int32)

    def maxima(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The posting of the largest impact in each range [a, b), of at least one posting."""
        j = np.frexp((b - a).astype(np.float64))[1] - 1
        x, y = self.table[j, a], self.table[j, b - (1 << j)]
        return np.where(self.impact[y] > self.impact[x], y, x)

    def search(self, term: np.ndarray, weight: np.ndarray, best: list[tuple], rank, k: int) -> None:
        """Add the shard's documents to the heap ``best`` of (score, -order, entry), ``k`` at most."""

        def offer(score: int, doc: int) -> None:
            entry = (score, *rank(doc))
            if score > 0:
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)

        def interval(lo: int, hi: int, term: np.ndarray, weight: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
            held = a < b
            if held.all():
                pass
            elif held.any():
                term, weight, a, b = term[held], weight[held], a[held], b[held]
            else:
                return
            top = self.maxima(a, b)
            promise = weight * self.impact[top]
            bound = int(promise.sum())
            if bound > 0 and (len(best) < k or bound >= best[0][0]):
                heapq.heappush(todo, (-bound, lo, hi, len(kept)))
                kept.append((term, weight, a, b, top, promise))

        todo: list[tuple[int, int, int, int]] = []
        kept: list[tuple] = []
        interval(0, self.docs, term, weight, self.starts[term], self.ends[term])
        while todo:
            bound, lo, hi, at = heapq.heappop(todo)
            if len(best) == k and -bound < best[0][0]:
                break
            (term, weight, a, b, top, promise), kept[at] = kept[at], None
            if hi - lo <= WHOLE_DOCS:
                n = b - a
                spot = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                score = np.zeros(hi - lo, np.int64)
                np.add.at(score, self.doc[spot] - lo, np.repeat(weight, n) * self.impact[spot])
                least = best[0][0] if len(best) == k else 1
                for d in np.flatnonzero(score >= least).tolist():
                    offer(int(score[d]), lo + d)
                continue
            split = int(self.doc[top[np.argmax(promise)]])
            place = np.searchsorted(self.key, term * self.docs + split)
            hit = (place < b) & (self.key[np.minimum(place, len(self.key) - 1)] == term * self.docs + split)
            offer(int((weight[hit] * self.impact[place[hit]]).sum()), split)
            interval(lo, split, term, weight, a, place)
            interval(split + 1, hi, term, weight, place + hit, b)


def _shards(batches: Iterator[pa.RecordBatch], weight: np.ndarray, documents: int, length: int) -> Iterator[tuple[Shard, list]]:
    """The shards of a task's documents, with their ids."""

    def shard() -> tuple[Shard, list]:
        m = np.array([25 + 75 * x * documents // length for x in n], np.int64)
        doc = np.concatenate(docs)
        tf, t = np.concatenate(tfs), np.concatenate(lists)
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
        return Shard(len(n), doc, t, impact, len(weight)), ids

    ids, n, docs, lists, tfs, held = [], [], [], [], [], 0
    for batch in batches:
        sizes = np.diff(batch.column(2).offsets.to_numpy())
        at = 0
        while at < batch.num_rows:
            room = SHARD_DOCS - len(ids)
            size = sizes[at:at + room]
            fit = max(1, int(np.searchsorted(np.cumsum(size), SHARD_POSTINGS - held, "right")))
            part = batch.slice(at, min(fit, room))
            docs.append(np.repeat(np.arange(len(ids), len(ids) + part.num_rows), size[:part.num_rows]))
            ids += part.column(0).to_pylist()
            n += part.column(1).to_pylist()
            lists.append(part.column(2).flatten().to_numpy())
            tfs.append(part.column(3).flatten().to_numpy())
            held += len(lists[-1])
            at += part.num_rows
            if len(ids) >= SHARD_DOCS or held >= SHARD_POSTINGS:
                yield shard()
                ids, n, docs, lists, tfs, held = [], [], [], [], [], 0
    if ids:
        yield shard()


class _Order:
    """Sorts as what comes first among equal scores: greater is the smaller id, null last."""

    __slots__ = ("id",)

    def __init__(self, id_):
        self.id = id_

    def __lt__(self, other: "_Order") -> bool:
        if self.id is None or other.id is None:
            return self.id is None and other.id is not None
        return self.id > other.id

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Order) and self.id == other.id


def _candidates(found: DataFrame, block, k: int) -> DataFrame:
    """(item, doc_id, score): the ``k`` best documents of each task for each of a block's items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        best: list[list[tuple]] = [[] for _ in b["items"]]
        for shard, ids in _shards(batches, b["weight"], b["documents"], b["length"]):
            for (term, n), heap in zip(b["items"], best, strict=True):
                shard.search(term, n * b["weight"][term], heap, lambda d, ids=ids: (_Order(ids[d]),), k)
        rows = [(i, order.id, score) for i, heap in enumerate(best) for score, order in heap]
        item, doc, score = zip(*rows, strict=True) if rows else ((), (), ())
        kind = pa_kind
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, kind), pa.array(score, pa.int64())],
                                         names=["item", "doc_id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    pa_kind = to_arrow_type(found.schema["doc_id"].dataType)
    return found.mapInArrow(run, f"item int, doc_id {found.schema['doc_id'].dataType.simpleString()}, score bigint")


def _best(df: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring documents of each item."""
    spark = docs.sparkSession
    ready(spark)
    wanted = written(item_terms(items), "item-terms")
    blocks = max(1, math.ceil(wanted.count() / BLOCK_TERMS))
    part = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    out = None
    for number in range(blocks):
        rows = wanted.where(part == number).toArrow()
        vocabulary = {t: i for i, t in enumerate(sorted(set(rows["term"].to_pylist())))}
        items_of: dict = {}
        for item, term, n in zip(*(rows[c].to_pylist() for c in ("item_id", "term", "n")), strict=True):
            items_of.setdefault(item, []).append((vocabulary[term], n))
        names = sorted(items_of, key=lambda x: (x is None, x))
        found = written(postings(docs, spark.sparkContext.broadcast(vocabulary)), "postings")
        total = found.agg(F.sum((F.col("n") > 0).cast("long")).alias("documents"), F.sum("n").alias("length")).first()
        df = document_frequencies(found, len(vocabulary))
        documents = total["documents"] or 0
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        block = spark.sparkContext.broadcast({
            "items": [tuple(np.array(x, np.int64) for x in zip(*items_of[i], strict=True)) for i in names],
            "weight": weight, "documents": documents, "length": total["length"] or 1})
        top = _candidates(found, block, k)
        top = _best(top.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS))), ["item", "part"], k)
        top = _best(top.drop("part"), ["item"], k)
        of = spark.createDataFrame(list(enumerate(names)), f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        top = top.join(F.broadcast(of), "item").select("item_id", "rank", "doc_id", "score")
        out = top if out is None else out.unionByName(top)
    return out
