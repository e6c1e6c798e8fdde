"""Subword ids of words, from the vocabulary file of a public tokenizer."""

from __future__ import annotations

import base64

import numpy as np

from shiftlab.llm import bytearrays as ba

#: Byte-level BPE ranks; the file is read on the driver and sent to the tasks.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The pattern that splits text before the merges; a fixed value of these files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct words whose ids a task remembers at most.
REMEMBERED = 400_000


def load(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """Ids of each word, computed once for a distinct word."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.end = max(ranks.values()) + 1
        self.size = self.end + 1
        self._one = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._line = ranks.get(b"\n")
        self._known = np.zeros(0, ba.U64), np.zeros(0, np.int64), np.zeros(0, np.int64)  # hashes in order, place of the first id, ids
        self._flat = np.zeros(0, np.int32)

    def _new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per word) of words, a space before each."""
        lines = "\n".join(words)
        if self._line is None or len("".join(lines.split())) != len(lines) - 2 * len(words) + 1:
            plain = [self._line is not None and w[1:].split() == [w[1:]] for w in words]
            together = iter(())
            if any(plain):
                ids, n = self._new([w for w, p in zip(words, plain, strict=True) if p])
                together = iter(np.split(ids, np.cumsum(n)[:-1]))
            out = [next(together) if p else np.array(self._one(w), np.int32) for w, p in zip(words, plain, strict=True)]
            return np.concatenate(out), np.array(list(map(len, out)), np.int64)
        # Without other white space in the words, the pattern ends a piece at each line's end, and only there is its id.
        ids = np.array(self._one(lines), np.int32)
        line = ids == self._line
        return ids[~line], np.diff(np.flatnonzero(np.concatenate([[True], line, [True]]))) - 1

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, alike=None):
        """(ids, ids per word) of words given as spans of lower-cased bytes; ``alike`` is ``distinct_words(hashes)`` if known."""
        distinct, first, back = alike or distinct_words(hashes)
        if len(self._known[0]) + len(distinct) > REMEMBERED:
            self._known, self._flat = tuple(x[:0] for x in self._known), self._flat[:0]
        known, at, size = self._known
        place = np.searchsorted(known, distinct)
        new = np.ones(len(distinct), bool)
        inside = place < len(known)
        new[inside] = known[place[inside]] != distinct[inside]
        if new.any():
            raw, which = data.tobytes(), first[new]
            got, n = self._new([" " + raw[a:b].decode("utf-8", "replace")
                                for a, b in zip(starts[which].tolist(), ends[which].tolist(), strict=True)])
            begin = np.cumsum(n) - n + len(self._flat)
            self._flat = np.concatenate([self._flat, got])
            known, at, size = (np.insert(x, place[new], y) for x, y in ((known, distinct[new]), (at, begin), (size, n)))
            self._known = known, at, size
            place = np.searchsorted(known, distinct)
        n = size[place][back]
        step = np.arange(int(n.sum())) + np.repeat(at[place][back] - (np.cumsum(n) - n), n)
        return self._flat[step], n


def distinct_words(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes in order, place of the first of each, place in them of each word)."""
    return np.unique(hashes, return_index=True, return_inverse=True)


def lowered(data: np.ndarray) -> np.ndarray:
    return ba.LOWER[data]
