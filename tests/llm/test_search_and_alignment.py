"""Nearest neighbours, ranked lexical search and tokenizer alignment against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shiftlab.llm import lexical_rmq, neighbour_lists, queries, token_align
from tests.conftest import SF001

# --- nearest neighbours -------------------------------------------------------


def exact(rows, k=10):
    """{query row: [(distance, id)]} over rows of (id, vector); every row asks."""
    out = []
    for i, (q, x) in enumerate(rows):
        if q % 100:
            continue
        near = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y))), v) for j, (v, y) in enumerate(rows) if j != i)
        out += [(q, r + 1, v, d) for r, (d, v) in enumerate(near[:k])]
    return sorted(out)


def neighbours(spark, rows, schema="vec_id bigint, embedding array<float>"):
    df = spark.createDataFrame(rows, schema)
    got = neighbour_lists.nearest(df, "vec_id", "embedding", F.col("id") % 100 == 0).collect()
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got)


def close(a, b):
    assert [x[:3] for x in a] == [x[:3] for x in b]
    assert np.allclose([x[3] for x in a], [x[3] for x in b], rtol=1e-12, atol=0)


def test_neighbours_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    good = [(i, [float(i % 7), float(i % 3), 1.0]) for i in range(0, 420, 7)] + [(100, [1.0, 1.0, 1.0]), (100, [1.0, 1.0, 1.0]), (200, [5.0, 5.0, 5.0])]
    bad = [(300, None), (400, []), (500, [0.0, 0.0, 0.0]), (600, [1.0, None, 2.0]), (700, [nan, 1.0, 2.0]), (800, [inf, 1.0, 2.0]),
           (None, [1.0, 1.0, 1.0]), (900, [1.0, 2.0])]
    close(neighbours(spark, good + bad), exact(good))
    assert neighbours(spark, bad[:7]) == [] and neighbours(spark, []) == []
    assert neighbours(spark, [(0, [1.0]), (5, [3.0])]) == [(0, 1, 5, 2.0)]


def test_neighbours_hot_vector_and_clashing_columns(spark):
    rows = [(i, [1.0, 2.0]) for i in range(350)] + [(1000 + i, [1.0, 2.0 + i]) for i in range(1, 50)]
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], "vec_id bigint, embedding array<double>, id int, list int, score string")
    got = neighbour_lists.nearest(df, "vec_id", "embedding", F.col("id") % 100 == 0).collect()
    close(sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got), exact(rows))


def test_neighbour_lists_recall_and_groups(spark, monkeypatch):
    """Many lists, some dealt over several groups: scores exact, recall of 0.9 on clustered and on unclustered vectors."""
    monkeypatch.setattr(neighbour_lists, "LIST_ROWS", 24)
    monkeypatch.setattr(neighbour_lists, "GROUP_BYTES", 8 * 8 * 60)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8)) * 4
    for x in (rng.normal(size=(1500, 8)), centres[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 8)) * 0.3):
        rows = [(i * 10, v.tolist()) for i, v in enumerate(x)]
        got, want = neighbours(spark, rows, "vec_id bigint, embedding array<double>"), exact(rows)
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert len({x[::2] for x in got} & {x[::2] for x in want}) >= 0.9 * len(want)
        at = dict(rows)
        assert all(abs(d - math.dist(at[q], at[v])) < 1e-12 for q, _, v, d in got)


def test_balanced_leaves_and_graph():
    x = np.random.default_rng(1).normal(size=(1000, 6))
    leaves = neighbour_lists.balanced_leaves(x, 13)
    assert sorted(np.concatenate(leaves).tolist()) == list(range(1000)) and {len(v) for v in leaves} <= {76, 77, 78}
    assert {len(v) for v in neighbour_lists.balanced_leaves(np.ones((40, 3)), 4)} == {10}
    c = neighbour_lists.Centroids(np.stack([x[v].mean(0) for v in leaves] * 9) + np.random.default_rng(2).normal(size=(117, 6)))
    d = neighbour_lists._distances(x, c.points)
    assert (c.walk(x, 24)[0][:, 0] == d.argmin(1)).mean() > 0.98
    row, name, _ = c.within(x, 1.2)
    sets = defaultdict(set)
    for r, n in zip(row.tolist(), name.tolist()):
        sets[r].add(n)
    want = [set(np.flatnonzero(v <= v.min() * 1.2).tolist()) for v in d]
    assert np.mean([len(sets[i] & w) / len(w) for i, w in enumerate(want)]) > 0.98


# --- ranked lexical search ----------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute_ranked(docs, items, k=10):
    held = [(i, Counter(t), len(t)) for i, t in ((i, brute_terms(x)) for i, x in docs) if t]
    n_docs, total = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = defaultdict(Counter)
    for i, text in items:
        asked[i].update(brute_terms(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c, n in held:
            m = 25 + 75 * n * n_docs // total
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                    for t, q in terms.items() if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def corpus(n, seed, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 9 == 0 else f"W{i}" for i in range(words)]
    return [" ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(words)], k=rng.randint(1, 40))) + rng.choice(["", ".", " -x-"]) for _ in range(n)]


def ranked(spark, docs, items):
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = lexical_rmq.ranked(d.withColumn("score", F.lit("x")), b.withColumn("doc_id", F.lit(1))).collect()
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in got), key=str)


def test_lexical_search_odd_rows(spark):
    texts = corpus(80, 1)
    docs = [(i, t) for i, t in enumerate(texts)] + [(900 + i, texts[3]) for i in range(30)] + [(3, texts[3]), (None, texts[3]), (None, None), (950, ""), (951, "... !"),
            (952, "w1 " * 30_000 + "rare")]
    items = [(1, texts[3]), (2, texts[5].upper()), (3, ""), (4, None), (None, "W1 w2"), (5, "nowhere-word"), (6, "w1 rare"), (6, "W1 w1"), (7, "RARE"), (7, "RARE")]
    assert ranked(spark, docs, items) == brute_ranked(docs, items)
    assert ranked(spark, docs[:0], items) == [] and ranked(spark, docs, []) == [] and ranked(spark, [(1, None)], items) == []


def test_lexical_search_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical_rmq, "BLOCK_TERMS", 40)
    docs, items = list(enumerate(corpus(150, 2))), list(enumerate(corpus(25, 3)))
    assert ranked(spark, docs, items) == brute_ranked(docs, items)


def test_interval_splits_over_small_shards(monkeypatch):
    """Splitting down to few documents, over several shards, finds what scoring all does."""
    monkeypatch.setattr(lexical_rmq, "WHOLE_DOCS", 2)
    monkeypatch.setattr(lexical_rmq, "SHARD_DOCS", 70)
    docs, items = list(enumerate(corpus(400, 7))), corpus(20, 8)
    vocabulary = {t: i for i, t in enumerate(sorted({t for x in items for t in brute_terms(x)}))}
    counts = [Counter(t for t in brute_terms(x)) for _, x in docs]
    lists = [[(vocabulary[t], c) for t, c in f.items() if t in vocabulary] for f in counts]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs]), pa.array([c.total() for c in counts]),
                                        pa.array([[t for t, _ in x] for x in lists], pa.list_(pa.int32())),
                                        pa.array([[c for _, c in x] for x in lists], pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "tfs"])
    df = Counter(t for x in lists for t, _ in x)
    weight = np.array([math.floor(1000 * math.log((2 * 400 + 2) / (2 * df[i] + 1))) for i in range(len(vocabulary))], np.int64)
    got = []
    for i, text in enumerate(items):
        terms = Counter(brute_terms(text))
        at, heap = np.array([vocabulary[t] for t in terms], np.int64), []
        for shard, ids in lexical_rmq._shards(iter([batch]), weight, 400, sum(c.total() for c in counts)):
            assert shard.docs <= 70
            shard.search(at, np.array(list(terms.values())) * weight[at], heap, lambda d, ids=ids: (lexical_rmq._Order(ids[d]),), 10)
        got += [(i, r + 1, o.id, s) for r, (s, o) in enumerate(sorted(heap, reverse=True))]
    assert sorted(got, key=str) == brute_ranked(docs, list(enumerate(items)))


def test_range_maxima():
    rng = np.random.default_rng(4)
    doc, term = np.nonzero(rng.random((200, 5)) < 0.6)
    shard = lexical_rmq.Shard(200, doc, term, rng.integers(1, 50, len(doc)), 5)
    for t in range(5):
        a, b = int(shard.starts[t]), int(shard.ends[t])
        for x, y in np.sort(rng.integers(a, b, (200, 2)), axis=1).tolist():
            at = int(shard.maxima(np.array([x]), np.array([y + 1]))[0])
            assert x <= at <= y and shard.impact[at] == shard.impact[x:y + 1].max()


# --- tokenizer alignment ------------------------------------------------------

ODD = ["", " ", "  a", "a  b", "x\n\n y  \t z ", "▁a b", "a ▁", "<s> hi </s> <|endoftext|> ok<unk>", "a b 　c", "日本 語 テスト", "a\x00b c",
       "é x ​ y", "'s 't it's we 're", "\x1c a \x1d b", "ﬁ ½ Å x é", "tab\tb c\r\n d", " " * 3000, "x" * 2000, "🙂 🙂🙂 a", "Hello, World 12345 67",
       "1 2  3   4    5", "\u0085 a b c", "trailing  ", "ÀÉ ÎÕ", "aaaa" * 300 + " " + "ab " * 200, "﻿bom � x", "I'll I 'll  'll"]


def whole_groups(v, text):
    """The groups of a whole text by the two libraries' own encoders; None where the bytes differ."""
    if not text:
        return None
    a, b = v.a.encode(" " + text, add_special_tokens=False).ids, v.b.encode(text)
    x, y = [v.a_bytes[i] for i in a], [v.b_bytes[i] for i in b]
    if b"".join(x) != b" " + text.encode() or b"".join(y) != b" " + text.encode():
        return None
    ends = sorted(set(np.cumsum([len(t) for t in x]).tolist()) & set(np.cumsum([len(t) for t in y]).tolist()))
    out, i, j, at_a, at_b = [], 0, 0, 0, 0
    for end in ends:
        p, q = i, j
        while at_a < end:
            at_a, i = at_a + len(x[i]), i + 1
        while at_b < end:
            at_b, j = at_b + len(y[j]), j + 1
        out.append((a[p:i], b[q:j]))
    return out


def brute_links(v, docs):
    held, count = [], Counter()
    for i, text in docs:
        groups = whole_groups(v, text)
        links = Counter((p, q) for a, b in groups or [] for p in a for q in b)
        count.update(links.keys())
        held.append((i, groups, links))
    top = defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    for i, groups, links in held:
        said = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups or [])
        yield (i, sum(len(a) for a, _ in groups or []), sum(len(b) for _, b in groups or []), len(groups or []), links.total(),
               sum(n for p, n in links.items() if count[p] == top[p[0]]), sum(n * count[p] for p, n in links.items()),
               hashlib.sha256(said.encode()).hexdigest() if groups else "")


@pytest.fixture(scope="module")
def vocabularies():
    with open(token_align.A_FILE, encoding="utf-8") as f, open(token_align.B_FILE, "rb") as g:
        return token_align.Vocabularies(f.read(), g.read())


def test_pieces_encode_like_whole_texts(vocabularies):
    rng = random.Random(3)
    marks = [" ", "  ", "\n", "\t", "a", "É", "'ll", "9", "語", "_", "-", " ", "the", " ", "🙂", "\x1f", "́", ". "]
    texts = ODD + ["".join(rng.choices(marks, k=rng.randint(1, 60))) for _ in range(800)]
    *sums, said, same, same_n, pair, pair_n = token_align.Aligner(vocabularies).texts(texts)
    links = [Counter() for _ in texts]
    for (ends, values), (_, times), identity in ((same, same_n, True), (pair, pair_n, False)):
        for d, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            for x, n in zip(values[a:b].tolist(), times[a:b].tolist()):
                links[d][(x, int(vocabularies.same[x])) if identity else divmod(x, token_align.B_SPAN)] += n
    for d, text in enumerate(texts):
        groups = whole_groups(vocabularies, text) or []
        assert links[d] == Counter((p, q) for a, b in groups for p in a for q in b), text
        assert [int(x[d]) for x in sums] == [sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), links[d].total()], text
        joined = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        assert said[d] == (hashlib.sha256(joined.encode()).hexdigest() if groups else "")


def test_remembered_pieces_may_be_forgotten(vocabularies, monkeypatch):
    monkeypatch.setattr(token_align, "REMEMBERED", 40)
    monkeypatch.setattr(token_align, "MANY_LINKS", 1)
    texts = corpus(60, 11) + ODD
    small, rest = token_align.Aligner(vocabularies), []
    for t in texts:
        rest.append(small.texts([t]))
    monkeypatch.undo()
    whole = token_align.Aligner(vocabularies).texts(texts)
    assert [x[4][0] for x in rest] == whole[4]
    for k in range(5, 9):
        ends, values = whole[k]
        assert [x[k][1].tolist() for x in rest] == [values[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]


@pytest.mark.parametrize("held", [500_000, 20])
def test_link_counts_against_brute_force(spark, vocabularies, monkeypatch, held):
    monkeypatch.setattr(token_align, "HELD_PAIRS", held)
    docs = list(enumerate([*ODD, None, *corpus(40, 12), "Señor ciónmente éanment", "Señor ciónmente éanment"])) + [(None, "a null id éanment"), (5, "a second 5")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("same", F.lit(1)).withColumn("row", F.lit(2)).repartition(3)
    got = token_align.link_counts(df).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(brute_links(vocabularies, docs), key=str)


def test_link_counts_of_empty_table(spark):
    assert token_align.link_counts(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_registered_alignment_on_given_documents(spark, vocabularies):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op13_token_alignment(spark, SF001).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(brute_links(vocabularies, docs), key=str)
