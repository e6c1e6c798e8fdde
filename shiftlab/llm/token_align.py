"""Alignment of two tokenizers' ids over a corpus, with an identity map as the fast path.

Tokenizer A is byte-level BPE, tokenizer B byte-pair pieces with byte fallback;
both encode space+text.  Neither makes a token across a space that stands
between two characters that are no white space, so a text is cut there and
each distinct piece of text is encoded and aligned once (``tests`` hold this
against encoding whole texts).  Byte offsets where tokens of both end cut the
tokens into groups; the tokens of a group are linked, each of A with each of B.

The identity map is an array from each id of A to B's id of the same bytes.
Links it names, those of exact one-to-one groups, are counted over documents in
vectors as long as A's vocabulary.  Only the other pairs, of irregular groups,
enter the shuffle that counts them.  Counts go back to the documents by vector
and by a bounded table of the most frequent irregular pairs; the rarer pairs,
if there are more than that, by a join.

Results for odd rows: a null or empty text, and one whose tokens of A or B do
not spell space+text (B reads U+2581 as a space), has no tokens: zeros and an
empty ``groups_sha256``.  Each row is a document of its own, also with a null or
repeated id.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlab.llm.store import ready, written
from shiftlab.llm.subwords import PATTERN

A_FILE = "/opt/tokenizers/byte_bpe_50k.json"
B_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: Distinct pieces of text whose alignment a Python worker remembers, as long as the next slice's fit in.
REMEMBERED = 400_000
#: Links of one group beyond which a piece's links are counted instead of listed.
MANY_LINKS = 4096
#: Characters of texts that are aligned at a time, at least one text.
SLICE_CHARS = 1 << 20
#: Irregular pairs (16 bytes each) that may be held in every task; the others join.
HELD_PAIRS = 500_000
#: An id pair as one number: A's id times this plus B's id.
B_SPAN = 1 << 24

_CUT = re.compile(r"(?<=\S) (?=\S)")
_ALIGNED = ("n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
            "same array<int>, same_n array<bigint>, pair array<bigint>, pair_n array<bigint>")


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable
    ones for themselves, the others for the characters from U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabularies:
    """Both tokenizers, the bytes of their ids, and the identity map."""

    def __init__(self, a_json: str, b_model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor()
        self.b.LoadFromSerializedProto(b_model)
        of = _byte_of_char()
        special = {i: t.content.encode() for i, t in self.a.get_added_tokens_decoder().items()}
        self.a_bytes = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            self.a_bytes[i] = special[i] if i in special else bytes(of[c] for c in token)
        self.b_bytes = []
        spelled: dict[bytes, int] = {}
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            raw = bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
            self.b_bytes.append(raw)
            if not (self.b.is_control(i) or self.b.is_unknown(i)):
                if raw not in spelled or self.b.is_byte(spelled[raw]):  # a piece goes before a byte
                    spelled[raw] = i
        self.a_size, self.b_size = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        self.same = np.array([-1 if i in special else spelled.get(x, -1) for i, x in enumerate(self.a_bytes)], np.int64)
        self._ranks = self._by_rank(json.loads(a_json), special)

    def _by_rank(self, file: dict, special: dict[int, bytes]):
        """A's encoder by ranks, about four times as fast, if the file's merges are in the order of their ids."""
        import tiktoken

        merges = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
        ids = file["model"]["vocab"]
        if (file["pre_tokenizer"] or {}).get("use_regex") is not True or file["normalizer"] is not None:
            return None
        own = len(set(ids.values()) - special.keys())
        if [ids[x + y] for x, y in merges] != list(range(own - len(merges), own)):
            return None
        ranks = {raw: i for i, raw in enumerate(self.a_bytes) if i not in special}
        return tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, pieces: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of A and B for each piece, that is for a space and the piece."""
        if self._ranks:
            a = (self._ranks(" " + p) for p in pieces)
        else:
            a = (x.ids for x in self.a.encode_batch([" " + p for p in pieces], add_special_tokens=False))
        return zip(a, self.b.encode(pieces, num_threads=1), strict=True)


class Aligner:
    """Aligned texts, from pieces that are aligned once and kept in flat arrays."""

    def __init__(self, vocabularies: Vocabularies):
        self.v = vocabularies
        self._clear()

    def _clear(self) -> None:
        self._place: dict[str, int] = {}
        self._groups: list[str] = []
        self._counts = array("q")  # n_a, n_b, n_groups, n_links, links' number of distinct pairs
        self._codes, self._times = array("q"), array("q")
        self._odd: dict[int, tuple[bytes, bytes]] = {}  # joined bytes of pieces that a tokenizer does not spell

    def _learn(self, pieces: list[str]) -> None:
        """Encode and align new pieces, all of them in one run of bytes."""
        a_bytes, b_bytes = self.v.a_bytes, self.v.b_bytes
        a, b = map(list, zip(*self.v.encode(pieces), strict=True))
        flat_a, flat_b = list(chain.from_iterable(a)), list(chain.from_iterable(b))
        wants = [b" " + p.encode() for p in pieces]
        n_a, n_b, want = (np.fromiter(map(len, x), np.int64, len(pieces)) for x in (a, b, wants))
        whole = b"".join(wants)
        same = all(b"".join([s[i] for i in ids]) == whole for s, ids in ((a_bytes, flat_a), (b_bytes, flat_b)))
        ids_a, ids_b = np.array(flat_a, np.int64), np.array(flat_b, np.int64)
        end_a, end_b, end = np.cumsum(self.v.a_size[ids_a]), np.cumsum(self.v.b_size[ids_b]), np.cumsum(want)
        if not (same and np.array_equal(end_a[np.cumsum(n_a) - 1], end) and np.array_equal(end_b[np.cumsum(n_b) - 1], end)):
            if len(pieces) == 1:
                self._odd[len(self._groups)] = b"".join([a_bytes[i] for i in flat_a]), b"".join([b_bytes[i] for i in flat_b])
                self._add(pieces, n_a, n_b, np.zeros(1, np.int64), [], [(np.zeros(0, np.int64),) * 2])
                return
            for half in (pieces[:len(pieces) // 2], pieces[len(pieces) // 2:]):
                self._learn(half)
            return
        common = end_a[end_b[np.minimum(np.searchsorted(end_b, end_a), len(end_b) - 1)] == end_a]
        till_a, till_b = np.searchsorted(end_a, common, "right"), np.searchsorted(end_b, common, "right")
        size_a, size_b = np.diff(till_a, prepend=0), np.diff(till_b, prepend=0)
        till = zip((till_a - size_a).tolist(), till_a.tolist(), (till_b - size_b).tolist(), till_b.tolist(), strict=True)
        said = [f"{flat_a[i]}|{flat_b[k]}" if j - i == m - k == 1 else
                f"{','.join(map(str, flat_a[i:j]))}|{','.join(map(str, flat_b[k:m]))}" for i, j, k, m in till]
        n_groups = np.diff(np.searchsorted(common, end, "right"), prepend=0)
        group_ends = np.cumsum(n_groups)
        pairs = []
        for g, h in zip(group_ends - n_groups, group_ends, strict=True) if (size_a * size_b).max() > MANY_LINKS else [(0, len(common))]:
            pairs.append(self._pairs(ids_a, ids_b, till_a[g:h], size_a[g:h], till_b[g:h], size_b[g:h]))
        self._add(pieces, n_a, n_b, n_groups, said, pairs, np.bincount(
            np.repeat(np.arange(len(pieces)), n_groups), size_a * size_b, len(pieces)).astype(np.int64))

    @staticmethod
    def _pairs(ids_a, ids_b, till_a, size_a, till_b, size_b) -> tuple[np.ndarray, np.ndarray]:
        """The codes of the groups' links, each of A with each of B; those of very large groups counted."""
        if (size_a * size_b).max(initial=0) > MANY_LINKS:
            found: Counter[int] = Counter()
            for i, n, j, m in zip(till_a.tolist(), size_a.tolist(), till_b.tolist(), size_b.tolist(), strict=True):
                many = Counter(ids_b[j - m:j].tolist()).items()
                for p, x in Counter(ids_a[i - n:i].tolist()).items():
                    for q, y in many:
                        found[p * B_SPAN + q] += x * y
            return np.array(list(found), np.int64), np.array(list(found.values()), np.int64)
        group = np.repeat(np.arange(len(size_a)), size_a * size_b)
        place = np.arange(len(group)) - np.repeat(np.cumsum(size_a * size_b) - size_a * size_b, size_a * size_b)
        at_a = (till_a - size_a)[group] + place // size_b[group]
        at_b = (till_b - size_b)[group] + place % size_b[group]
        return ids_a[at_a] * B_SPAN + ids_b[at_b], np.ones(len(group), np.int64)

    def _add(self, pieces, n_a, n_b, n_groups, said, pairs, n_links=None) -> None:
        n_links = np.zeros(len(pieces), np.int64) if n_links is None else n_links
        n_codes = n_links if len(pairs) == 1 and len(pieces) > 1 else np.array([len(x) for x, _ in pairs], np.int64)
        for code, times in pairs:
            self._codes.frombytes(code.tobytes())
            self._times.frombytes(times.tobytes())
        self._counts.frombytes(np.stack([n_a, n_b, n_groups, n_links, n_codes], axis=1).astype(np.int64).tobytes())
        at = 0
        for piece, n in zip(pieces, n_groups.tolist(), strict=True):
            self._place[piece] = len(self._groups)
            self._groups.append(";".join(said[at:at + n]))
            at += n

    def texts(self, texts: list[str | None]) -> tuple:
        """The columns of ``_ALIGNED`` for the texts, lists as (ends, values)."""
        cut = [_CUT.split(t) if t else [] for t in texts]
        new = set(chain.from_iterable(cut)) - self._place.keys()
        if len(self._place) + len(new) > REMEMBERED and self._place:
            self._clear()
            new = set(chain.from_iterable(cut))
        ordered = sorted(new)
        for at in range(0, len(ordered), 4096):
            self._learn(ordered[at:at + 4096])
        size = np.fromiter(map(len, cut), np.int64, len(cut))
        at = np.fromiter(map(self._place.__getitem__, chain.from_iterable(cut)), np.int64, int(size.sum()))
        doc = np.repeat(np.arange(len(cut)), size)
        ends = np.cumsum(size)
        without = size == 0
        if self._odd:
            odd = np.isin(at, np.fromiter(self._odd, np.int64, len(self._odd)))
            for d in np.unique(doc[odd]).tolist():
                without[d] = not self._spells(cut[d])
        taken = ~without[doc]
        counts = np.frombuffer(self._counts, np.int64).reshape(-1, 5)
        sums = [np.bincount(doc[taken], counts[at[taken], k], len(cut)).astype(np.int64) for k in range(4)]
        names = at.tolist()
        said = ["" if w else hashlib.sha256(";".join([self._groups[i] for i in names[e - n:e]]).encode()).hexdigest()
                for w, e, n in zip(without.tolist(), ends.tolist(), size.tolist(), strict=True)]
        return *sums, said, *self._links(at[taken], doc[taken], counts[:, 4], len(cut))

    def _links(self, at: np.ndarray, doc: np.ndarray, n_pairs: np.ndarray, n_docs: int) -> tuple:
        """Each document's distinct links with how often, split by the identity map."""
        start = np.cumsum(n_pairs) - n_pairs
        each = n_pairs[at]
        spot = np.repeat(start[at] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        key = (np.repeat(doc, each) << 40) | np.frombuffer(self._codes, np.int64)[spot]
        times = np.frombuffer(self._times, np.int64)[spot]
        order = np.argsort(key)
        key, times = key[order], times[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        key, times = key[first], np.add.reduceat(times, first) if len(first) else times
        pair, doc = key & ((1 << 40) - 1), key >> 40
        a = pair // B_SPAN
        same = self.v.same[a] == pair % B_SPAN
        ends = [np.concatenate([[0], np.cumsum(np.bincount(doc[x], minlength=n_docs))]) for x in (same, ~same)]
        return (ends[0], a[same]), (ends[0], times[same]), (ends[1], pair[~same]), (ends[1], times[~same])

    def _spells(self, pieces: list[str]) -> bool:
        """Whether the tokens' bytes, of which some differ from their piece, still join to the text."""
        want = b"".join([b" " + p.encode() for p in pieces])
        places = [self._place[p] for p in pieces]
        return all(b"".join([self._odd[i][side] if i in self._odd else b" " + p.encode()
                             for p, i in zip(pieces, places, strict=True)]) == want for side in (0, 1))


def _lists(ends: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


#: A Python worker's aligner, kept from task to task.
_KEPT: dict[tuple, Aligner] = {}


def _aligner(files) -> Aligner:
    if files.value["name"] not in _KEPT:
        _KEPT.clear()
        _KEPT[files.value["name"]] = Aligner(Vocabularies(files.value["a"], files.value["b"]))
    return _KEPT[files.value["name"]]


def _sliced(texts: list[str | None]) -> Iterator[slice]:
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= SLICE_CHARS:
            yield slice(at, i + 1)
            at, held = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def aligned(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """(doc_id, ``_ALIGNED``) of each document: sizes, digest, and its distinct links
    with how often, those of the identity map by A's id alone."""
    spark = docs.sparkSession
    ready(spark)
    with open(a_file, encoding="utf-8") as f, open(b_file, "rb") as g:
        files = spark.sparkContext.broadcast({"name": (a_file, b_file), "a": f.read(), "b": g.read()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = None
        for batch in batches:
            aligner = aligner or _aligner(files)
            texts = batch.column(1).to_pylist()
            for s in _sliced(texts):
                *sums, said, same, same_n, pair, pair_n = aligner.texts(texts[s])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[s.start:s.stop], *(pa.array(x, pa.int64()) for x in sums), pa.array(said, pa.string()),
                     _lists(*same, pa.int32()), *(_lists(*x, pa.int64()) for x in (same_n, pair, pair_n))],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "same", "same_n", "pair", "pair_n"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {_ALIGNED}")


def _summed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """A task's document counts: of identity links in one vector, of other pairs by code."""
    vector = np.zeros(width, np.int64)
    pairs, many = [], 0

    def out(same: bool, code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(code), same)), pa.array(code, pa.int64()), pa.array(n, pa.int64())],
                                          names=["same", "code", "n"])

    def together() -> tuple[np.ndarray, np.ndarray]:
        code, back = np.unique(np.concatenate([x for x, _ in pairs]), return_inverse=True)
        return code, np.bincount(back, np.concatenate([n for _, n in pairs])).astype(np.int64)

    for batch in batches:
        vector += np.bincount(batch.column(0).flatten().to_numpy(), minlength=width)
        code, n = np.unique(batch.column(1).flatten().to_numpy(), return_counts=True)
        pairs.append((code, n))
        many += len(code)
        if many > 2_000_000:
            pairs = [together()]
            many = len(pairs[0][0])
            if many > 1_000_000:
                yield out(False, *pairs.pop())
                many = 0
    if pairs:
        yield out(False, *together())
    used = np.flatnonzero(vector)
    if len(used):
        yield out(True, used, vector[used])


def pair_counts(links: DataFrame, width: int) -> DataFrame:
    """(same, code, n): the documents that hold each id pair linked; ``code`` is A's id where
    the identity map names B's, else the pair."""
    ready(links.sparkSession)
    each = links.select("same", "pair").mapInArrow(lambda x: _summed(x, width), "same boolean, code bigint, n bigint")
    return each.groupBy("same", "code").agg(F.sum("n").alias("n"))


def _frequent(pairs: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """The most frequent pairs, as many as may be held, by code; and the count from which they are."""
    steps = {r["e"]: r["c"] for r in pairs.groupBy(F.floor(F.log2("n")).cast("int").alias("e")).agg(F.count(F.lit(1)).alias("c")).collect()}
    least, held = max(steps, default=-1) + 1, 0
    for e in range(least - 1, -1, -1):
        held += steps.get(e, 0)
        if held > HELD_PAIRS:
            break
        least = e
    rows = pairs.where(F.col("n") >= F.lit(2.0) ** least).select("code", "n").toArrow().sort_by("code")
    return rows["code"].to_numpy(), rows["n"].to_numpy(), 0 if least == 0 else 1 << least


def link_counts(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``count_sum`` adds up, over a document's links, in how many documents their id pair
    is linked; ``n_best`` counts the links whose pair is the most frequent of its A id.
    """
    spark = docs.sparkSession
    with open(a_file, encoding="utf-8") as f, open(b_file, "rb") as g:
        v = Vocabularies(f.read(), g.read())
    width = len(v.a_bytes)
    links = written(aligned(docs, a_file, b_file).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = written(pair_counts(links, width), "pairs")
    ident, best = np.zeros(width, np.int64), np.zeros(width, np.int64)
    for a, n in counts.where("same").select("code", "n").toLocalIterator():  # at most the vocabulary
        ident[a] = n
    others = counts.where(~F.col("same"))
    top = others.groupBy((F.col("code") / B_SPAN).cast("bigint").alias("a")).agg(F.max("n").alias("n"))
    for a, n in top.toLocalIterator():
        best[a] = n
    best = np.maximum(best, ident)
    codes, ns, least = _frequent(others)
    held = spark.sparkContext.broadcast((ident, best, codes, ns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ident, best, codes, ns = held.value
        for batch in batches:
            row, same, same_n, pair, pair_n = batch.columns
            total, top = np.zeros((2, batch.num_rows + 1), np.int64)

            def add(doc: np.ndarray, a: np.ndarray, n: np.ndarray, times: np.ndarray) -> None:
                np.add.at(total, doc, n * times)
                np.add.at(top, doc, np.where(n == best[a], times, 0))

            def doc_of(column: pa.Array) -> np.ndarray:
                return np.repeat(np.arange(batch.num_rows), np.diff(column.offsets.to_numpy()))

            a = same.flatten().to_numpy().astype(np.int64)
            add(doc_of(same), a, ident[a], same_n.flatten().to_numpy())
            code, times, doc = pair.flatten().to_numpy(), pair_n.flatten().to_numpy(), doc_of(pair)
            at = np.minimum(np.searchsorted(codes, code), max(len(codes) - 1, 0))
            hit = codes[at] == code if len(codes) else np.zeros(len(code), bool)
            add(doc[hit], code[hit] // B_SPAN, ns[at[hit]] if len(codes) else code[hit], times[hit])
            rest = np.bincount(doc[~hit], minlength=batch.num_rows)
            ends = pa.array(np.concatenate([[0], np.cumsum(rest)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [row, pa.array(top[:-1]), pa.array(total[:-1]),
                 pa.ListArray.from_arrays(ends, pa.array(code[~hit], pa.int64())),
                 pa.ListArray.from_arrays(ends, pa.array(times[~hit], pa.int64()))],
                names=["row", "n_best", "count_sum", "rest", "rest_n"])

    keep = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    if least == 0:  # every pair is held
        kind = docs.schema["doc_id"].dataType.simpleString()
        fixed = f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                done = next(run(iter([batch.select(["row", "same", "same_n", "pair", "pair_n"])])))
                yield pa.RecordBatch.from_arrays([*batch.columns[:6], done.column(1), done.column(2)],
                                                 names=[*batch.schema.names[:6], "n_best", "count_sum"])

        return links.select(*keep, "groups_sha256", "row", "same", "same_n", "pair", "pair_n").mapInArrow(
            whole, f"{fixed}, n_best bigint, count_sum bigint").select(*keep, "n_best", "count_sum", "groups_sha256")
    scored = written(links.select("row", "same", "same_n", "pair", "pair_n").mapInArrow(
        run, "row bigint, n_best bigint, count_sum bigint, rest array<bigint>, rest_n array<bigint>"), "scored")
    best_of = spark.createDataFrame([(int(a), int(best[a])) for a in np.flatnonzero(best)], "a bigint, best bigint")
    rest = (scored.where(F.size("rest") > 0).select("row", F.explode(F.arrays_zip("rest", "rest_n")).alias("r"))
            .select("row", F.col("r.rest").alias("code"), F.col("r.rest_n").alias("times")))
    more = (rest.join(others.where(F.col("n") < least).select("code", "n"), "code")
            .withColumn("a", (F.col("code") / B_SPAN).cast("bigint")).join(F.broadcast(best_of), "a")
            .groupBy("row").agg(F.sum(F.col("n") * F.col("times")).alias("s"),
                                F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("b")))
    return (links.select(*keep, "groups_sha256", "row").join(scored.select("row", "n_best", "count_sum"), "row")
            .join(more, "row", "left")
            .select(*keep, (F.col("n_best") + F.coalesce("b", F.lit(0))).alias("n_best"),
                    (F.col("count_sum") + F.coalesce("s", F.lit(0))).alias("count_sum"), "groups_sha256"))
