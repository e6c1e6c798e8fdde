"""Language identification by compression.

One zstandard raw-content dictionary per language; a text goes to the language
whose dictionary makes it smallest, and a text whose two smallest sizes are too
close is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from shiftlab.llm.store import ready

#: A language's dictionary: from PIECES groups of its texts one text each, cut to PIECE_CHARS.
PIECES = 64
PIECE_CHARS = 4096
#: Bytes compressed at a time, so that the dictionary counts throughout a long text.
CHUNK = 2048
LEVEL = 3
#: Texts up to SHORT bytes are compressed at a level that finds shorter matches.
SHORT, SHORT_LEVEL = 512, 19
#: Rejected below this share of the second smallest size.
MIN_MARGIN = 0.004
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")


def words_only(text: str) -> bytes:
    """The lower-cased words of letters, a space between; so case, digits and ornaments don't count."""
    return " ".join(LETTERS.findall(text.lower())).encode()


def learn(docs: DataFrame, *, text: str = "text", lang: str = "lang", pieces: int = PIECES,
          piece_chars: int = PIECE_CHARS) -> list[tuple[str, bytes]]:
    """(language, dictionary) from labelled rows, languages with more rows first.

    The fit is bounded: at most ``pieces`` texts of ``piece_chars`` characters a
    language, chosen by the hash of the text alone, in one aggregation whose
    groups are already split by that hash.  Null texts and labels don't count.
    """
    rows = docs.select(F.col(text).alias("t"), F.col(lang).alias("l")).where("t IS NOT NULL AND l IS NOT NULL")
    h = F.xxhash64("t")
    best = (rows.groupBy("l", F.pmod(h, F.lit(pieces)).alias("g"))
            .agg(F.min_by(F.substring("t", 1, piece_chars), h).alias("t"), F.count(F.lit(1)).alias("n")))
    found: dict[str, tuple[int, list[str]]] = {}
    for row in best.orderBy("l", "g").toLocalIterator():
        n, parts = found.get(row["l"], (0, []))
        found[row["l"]] = (n + row["n"], [*parts, row["t"]])
    order = sorted(found, key=lambda k: (-found[k][0], k))
    return [(k, words_only("\n".join(found[k][1]))) for k in order]


def _judge(texts: Iterator[str | None], model: list[tuple[str, bytes]]) -> Iterator[tuple[str, float]]:
    packers = [(name, *(_packer(raw, level) for level in (SHORT_LEVEL, LEVEL))) for name, raw in model]
    for text in texts:
        raw = memoryview(words_only(text or ""))
        if not raw.nbytes or not packers:
            yield UNKNOWN, 0.0
            continue
        which = 1 if raw.nbytes <= SHORT else 2
        sizes = [sum(len(p[which].compress(raw[i:i + CHUNK])) for i in range(0, raw.nbytes, CHUNK)) for p in packers]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        second = min((s for k, s in enumerate(sizes) if k != best), default=None)
        yield packers[best][0], 1.0 if second is None else (second - sizes[best]) / second


def _packer(raw: bytes, level: int) -> zstandard.ZstdCompressor:
    dictionary = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_content_size=False,
                                    write_checksum=False, write_dict_id=False)


def identify(docs: DataFrame, model: list[tuple[str, bytes]], *, text: str = "text",
             min_margin: float = MIN_MARGIN, prefix: str = "") -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and rejected.

    ``score`` is the margin of the smallest size to the second as a share of the
    second; ``rejected`` is true below ``min_margin`` and for texts without a
    letter, which are ``und`` like null and empty texts.  Equal sizes go to the
    language with more training rows, then the first name.  An untrained model
    calls everything ``und``.  Whole texts are judged, in chunks; repeated rows
    get equal results.  The new names take ``prefix`` and must not be in ``docs``.
    """
    new = [f"{prefix}{n}" for n in ("lang_pred", "score", "rejected")]
    if clash := set(new) & set(docs.columns):
        raise ValueError(f"docs already has {sorted(clash)}; give another prefix")
    ready(docs.sparkSession)
    # At most PIECES * PIECE_CHARS characters a language.
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*docs.schema.fields, *(StructField(n, k()) for n, k in
                                                zip(new, (StringType, DoubleType, BooleanType), strict=True))])

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            found = list(_judge((x.as_py() for x in column), shared.value))
            yield pa.RecordBatch.from_arrays([
                *batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()),
                pa.array([x[0] == UNKNOWN or x[1] < min_margin for x in found], pa.bool_())],
                [*batch.schema.names, *new])

    return docs.mapInArrow(run, schema)
