"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shiftlab.llm import (
    attention_lm,
    chat_trees,
    decontaminate,
    iblt,
    jaccard_join,
    langid,
    lexical_rmq,
    mixing,
    neighbour_lists,
    pii,
    suffix_dedup,
    token_align,
    trie_counts,
)
from shiftlab.llm.store import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _remainder(doc_id: str, n: int):
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % n


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document by compression; a quarter of the ids is held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(_remainder("doc_id", 4) == 2, F.lit(False))
    model = langid.learn(docs.where(_remainder("doc_id", 4) != 2))
    return langid.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model).drop("text")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in each document: strict spans, and those that the trained classifier adds."""
    spans = written(_table(spark, sf_dir, "documents").select("doc_id", pii.candidates(F.col("text")).alias("spans")), "spans")
    found = spans.select("doc_id", pii.accepted(F.col("spans"), pii.fit(spans)).alias("s"))
    base = F.filter("s", lambda x: x["strict"])
    return found.select("doc_id", *(F.size(pii.of_kind(base, k)).cast("bigint").alias(f"n_{k}") for k in pii.KINDS),
                        F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("s")).alias("spans"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix of sources takes from each document."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram base and self-attention score of each document; a seventh of the ids is held out."""
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(_remainder("doc_id", 7) == 2, F.lit(False)).alias("held_out")
    scored = attention_lm.score(docs, _remainder("doc_id", 7) != 2)
    return scored.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in each document, by suffix arrays over the documents."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find(docs, _table(spark, sf_dir, "benchmark"))
    n_hit = F.size("hit_words").cast("bigint")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"), F.col("longest").alias("longest_match"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT row_number() OVER () AS r, CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT r, item, i AS j, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS k
  FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
hit AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM d, sizes, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS r(i) WHERE len(w) >= n),
found AS (SELECT hit.doc_id, hit.i, hit.n, win.item, win.r, win.j FROM hit JOIN win USING (n, k)),
pos AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit, list(DISTINCT p ORDER BY p) AS ps
  FROM (SELECT DISTINCT doc_id, i, n FROM found) AS f, unnest(range(i, i + n)) AS q(p) GROUP BY doc_id),
longest AS (
  SELECT doc_id, max(c) AS longest_match
  FROM (SELECT doc_id, n + count(*) - 1 AS c
        FROM (SELECT doc_id, r, n, i - j AS diagonal,
                     i - row_number() OVER (PARTITION BY doc_id, r, i - j ORDER BY i) AS g FROM found) AS x
        GROUP BY doc_id, r, n, diagonal, g) AS y GROUP BY doc_id),
items AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS s
  FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       coalesce(longest_match, 0) AS longest_match
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN longest ON d.doc_id = longest.doc_id
LEFT JOIN items ON d.doc_id = items.doc_id
"""


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of each document without strings of 100 bytes that also start earlier."""
    kept = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram-vocabulary tokens of each document, counted along a trie of its batch's words."""
    return trie_counts.token_counts(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked at a Jaccard similarity of 0.8 of 5-word shingles."""
    return (jaccard_join.near_groups(_table(spark, sf_dir, "documents"))
            .select("doc_id", "n_shingles", "component_id"))


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + least(5, len(w)) - 1], ' ')) AS k
  FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s AS x JOIN s AS y ON x.k = y.k AND x.doc_id <> y.doc_id
                    GROUP BY 1, 2) AS p
  JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b WHERE 100 * o >= 80 * (na.c + nb.c - o)),
reach(doc_id, root) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.doc_id AND reach.root < links.b)
SELECT d.doc_id, coalesce(any_value(n.c), 0) AS n_shingles, min(reach.root) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach ON reach.doc_id = d.doc_id GROUP BY d.doc_id
"""

def op9_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as reply trees (a turn answers the one before), formatted and read back."""
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)],
                                  "conv_id bigint, turn bigint, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    messages = rows.withColumn("node", place).select(
        "conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(1.0).alias("score"), "role", "text")
    done = chat_trees.conversations(messages)
    turns = chat_trees.read_turns(F.col("formatted"))
    loss = chat_trees.read_loss(F.col("formatted"), F.col("loss_spans"))
    lines = F.concat_ws("", F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return done.select("conv_id", F.size(turns).cast("bigint").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
                       F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                       F.length("formatted").cast("bigint").alias("formatted_chars"))


OP9_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
  SELECT *, length(role) + length(text)
    + 4 * (length(role || text) - length(replace(role || text, '&', '')))
    + 3 * (length(role || text) - length(replace(role || text, '<', '')))
    + 4 * (length(role || text) - length(replace(replace(role || text, '[', ''), ']', ''))) + 11 AS chars
  FROM c)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invertible Bloom fingerprints of each document and of its edited text."""
    prints = iblt.fingerprints(_table(spark, sf_dir, "documents"))
    return prints.withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest other vectors of every hundredth one, from balanced posting lists."""
    return neighbour_lists.nearest(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 100 == 0)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that rank highest for each benchmark item, from range maxima of posting lists."""
    return lexical_rmq.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
st AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM d WHERE len(terms) > 0),
q AS (
  SELECT item_id, t, count(*) AS c FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) AS x
  GROUP BY item_id, t),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(terms) AS t FROM d) AS x WHERE t IN (SELECT t FROM q) GROUP BY r, t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, st GROUP BY t),
m AS (SELECT r, doc_id, 100 - 75 + ((75 * len(terms) * n_docs) // n_terms) AS m FROM d, st WHERE len(terms) > 0),
s AS (
  SELECT item_id, p.r, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN p USING (t) JOIN w USING (t) JOIN m ON m.r = p.r GROUP BY item_id, p.r),
o AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM s JOIN m ON m.r = s.r WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 10
"""


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's tokens of two public tokenizers, aligned, with corpus counts of the linked ids."""
    return token_align.link_counts(_table(spark, sf_dir, "documents"))


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_pii": op2_pii,
    "op3_mix_sources": op3_mix_sources,
    "op4_lm_score": op4_lm_score,
    "op5_decontaminate": op5_decontaminate,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_chat_trees": op9_chat_trees,
    "op10_fingerprints": op10_fingerprints,
    "op11_neighbours": op11_neighbours,
    "op12_lexical_search": op12_lexical_search,
    "op13_token_alignment": op13_token_alignment,
}
_ORACLE: dict[str, str] = {"op5_decontaminate": OP5_SQL, "op8_ngram_jaccard": OP8_SQL, "op9_chat_trees": OP9_SQL,
                          "op12_lexical_search": OP12_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)
