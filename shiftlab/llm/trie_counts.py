"""Token counts of a unigram vocabulary by dynamic programming along a trie.

The distinct pre-tokens of a batch, in sorted order, are the paths of a trie; a
node's forward score (the best segmentation of its prefix) is computed once and
kept on a stack while the words below it are visited, so words with a common
prefix share the work.  A terminal stores its word's token count.
"""

from __future__ import annotations

import math
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

from shiftlab.llm import bytearrays as ba
from shiftlab.llm.store import ready

#: A sentencepiece model file: its pieces are the vocabulary; read on the driver.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Words whose counts a task remembers at most, between batches.
REMEMBERED = 400_000


def vocabulary(path: str = PIECES) -> dict[str, float]:
    """Piece -> score: log of a Zipf weight by the piece's place in the file (its order of use)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())
              if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return {p: -math.log(k + 2.7) for k, p in enumerate(pieces)}


class TrieCounter:
    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.lengths = sorted({len(p) for p in pieces})
        #: Score of one byte of a character that no piece holds; below all pieces.
        self.byte = min(pieces.values(), default=0.0) - 10.0

    def counts(self, words: list[str]) -> list[int]:
        """Tokens in the best segmentation of each word; ``words`` sorted and distinct.

        The best has the highest score, then the fewest tokens.  A character may
        always go as its UTF-8 bytes, a token each.
        """
        score, tokens, out, before = [0.0], [0], [], ""
        pieces, lengths, byte = self.pieces, self.lengths, self.byte
        for word in words:
            word = SPACE + word
            shared = len(commonprefix((before, word)))
            del score[shared + 1:], tokens[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                n = len(word[end - 1].encode("utf-8", "replace"))
                best, count = score[end - 1] + n * byte, tokens[end - 1] + n
                for length in lengths:
                    if length > end:
                        break
                    s = pieces.get(word[end - length:end])
                    if s is not None:
                        s += score[end - length]
                        if s > best or s == best and tokens[end - length] + 1 < count:
                            best, count = s, tokens[end - length] + 1
                score.append(best)
                tokens.append(count)
            out.append(tokens[-1])
            before = word
        return out


def _map(shared, text: str, new: list[str]):
    def run(batches):
        counter, known = TrieCounter(shared.value), {}
        for batch in batches:
            if len(known) > REMEMBERED:
                known.clear()
            data, offsets = ba.flat(batch.column(batch.schema.get_field_index(text)))
            parts, spans = [], {}
            for i, j in ba.slices(offsets):
                piece = data[offsets[i]:offsets[j]]
                starts, ends, at = ba.word_spans(piece, offsets[i:j + 1] - offsets[i], ba.NOT_SPACE)
                h = ba.span_hashes(piece, starts, ends)
                distinct, first = np.unique(h, return_index=True)
                raw = piece.tobytes()
                for k, a, b in zip(distinct.tolist(), starts[first].tolist(), ends[first].tolist(), strict=True):
                    if k not in known and k not in spans:
                        spans[k] = raw[a:b].decode("utf-8", "replace")
                parts.append((h, at))
            order = sorted(spans, key=spans.__getitem__)
            known |= zip(order, counter.counts([spans[k] for k in order]), strict=True)
            words, total = [], []
            for h, at in parts:
                distinct, back = np.unique(h, return_inverse=True)
                n = np.fromiter((known[k] for k in distinct.tolist()), np.int64, len(distinct))[back]
                total.append(np.diff(np.concatenate([[0], np.cumsum(n)])[at]))
                words.append(np.diff(at))
            empty = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([
                *batch.columns, pa.array(np.concatenate([empty, *words])), pa.array(np.concatenate([empty, *total]))],
                [*batch.schema.names, *new])

    return run


def token_counts(docs: DataFrame, *, text: str = "text", pieces_path: str = PIECES, prefix: str = "") -> DataFrame:
    """``docs`` with n_pretokens (words between ASCII white space) and n_tokens.

    Counts cover whole texts; null and empty texts have none; repeated rows get
    equal counts; an empty table stays empty.  The new names take ``prefix`` and
    must not be in ``docs``.  Words are told apart by 64-bit hashes.
    """
    new = [f"{prefix}n_pretokens", f"{prefix}n_tokens"]
    if clash := set(new) & set(docs.columns):
        raise ValueError(f"docs already has {sorted(clash)}; give another prefix")
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(pieces_path))
    schema = StructType([*docs.schema.fields, *(StructField(n, LongType()) for n in new)])
    return docs.mapInArrow(_map(shared, text, new), schema)
