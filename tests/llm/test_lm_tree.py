"""op4: the context decides between all ids, and ids are those of each word alone."""

import math

import numpy as np
from pyspark.sql import functions as F

from shiftlab.llm import attention_lm, subwords
from shiftlab.llm import bytearrays as ba


def test_context_tells_equally_frequent_ids_apart(spark):
    ranks = subwords.load()
    one = subwords.Encoder(ranks)._one
    words = [w for w in (b.decode("ascii", "ignore")[1:] for b in ranks if b[:1] == b" ")
             if len(w) == 4 and w.isalpha() and w.islower() and len(one(" " + w)) == 1][:120]
    first, second = words[:60], words[60:]
    right = [(i, f"{a} {b}") for i, (a, b) in enumerate(zip(first, second, strict=True))]
    wrong = [(1000 + i, f"{first[i]} {second[(i + 7) % 60]}") for i in range(60)]
    learn = [(2000 + k * 60 + i, t) for k in range(16) for i, t in right]
    docs = spark.createDataFrame(right + wrong + learn, "doc_id bigint, text string").coalesce(1)
    got = {r["doc_id"]: r["score"] for r in attention_lm.score(docs, F.col("doc_id") >= 2000).collect()}
    # Both texts hold ids of the same counts: only the word before tells which second one is likely.
    assert sum(got[i] - got[1000 + i] for i in range(60)) / 60 > 0.5


def test_probabilities_of_all_ids_sum_to_one():
    counts = np.array([5, 0, 900, 1, 0, 0, 33, 7])
    leaf, within, weights = attention_lm.leaves(counts)
    model = attention_lm.Model(3, attention_lm.Tree(weights))
    for _ in range(2):
        rows, there = np.tile(np.arange(4), 8)[None], np.ones((1, attention_lm.WINDOW), bool)
        each = [model.log_targets(rows, there, 0, np.full(rows.shape, leaf[i])) + within[i] * math.log(10) for i in range(len(counts))]
        assert np.allclose(np.exp(each).sum(0), 1, atol=1e-5)
        model.w["C"] += 1
    model.w["C"][:] = 0
    got = np.exp(model.log_targets(rows, there, 0, np.full(rows.shape, leaf[2])))
    assert np.allclose(got, 901 / (counts.sum() + len(counts)), rtol=1e-5)


def test_ids_are_those_of_each_word_alone():
    ranks = subwords.load()
    encoder, one = subwords.Encoder(ranks), subwords.Encoder(ranks)._one
    for texts in (["plain words, it's 12 of them", "same words"], ["a b \u0085", "x　 same  y", "new 'll \x1c ok"]):
        data = np.frombuffer(" ".join(texts).encode(), np.uint8)
        starts, ends, _ = ba.word_spans(data, np.array([0, len(data)]), ba.NOT_SPACE)
        ids, n = encoder.ids(data, starts, ends, ba.span_hashes(data, starts, ends))
        raw = data.tobytes()
        wanted = [one(" " + raw[a:b].decode()) for a, b in zip(starts, ends, strict=True)]
        assert n.tolist() == list(map(len, wanted)) and ids.tolist() == [x for w in wanted for x in w]


def test_words_of_a_batch_take_little_memory():
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    ranks = subwords.load()
    texts = [" ".join(f"{chr(97 + (i * k) % 26)}{i * k % 977}" for k in range(4000)) for i in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(texts)], ["id", "text"])
    size = sum(map(len, texts))
    shared = SimpleNamespace(value=(ranks, np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    for run in (attention_lm._count, attention_lm._encode(shared)):
        next(iter(run(iter([batch.slice(0, 1)]))))  # what every task holds
        tracemalloc.start()
        out, = run(iter([batch]))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert out.num_rows and most < 14 * size  # 21 times, with 2 MB of text at once


def test_powers_are_one_table_as_large_as_needed():
    for n in (3, 70_000, 10):
        up, down = ba.powers(n)
        assert len(up) == len(down) == n and (up * down == 1).all() and up[1] == ba.BASE and up[0] == 1
        assert (up[1:] == up[:-1] * ba.BASE).all()
