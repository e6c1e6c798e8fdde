"""Each query against DuckDB or a brute-force version on the small tables, and each operator on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from shiftlab.llm import (
    attention_lm,
    chat_trees,
    decontaminate,
    iblt,
    jaccard_join,
    langid,
    mixing,
    pii,
    suffix_dedup,
    trie_counts,
)
from shiftlab.llm import queries as q

SF = "/root/testdata/sf0.001"
DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def rows_of(spark, name="documents"):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def frame(spark, texts, extra=False):
    rows = [(i, t, "en", f"s{(i or 0) % 2}" if i != 3 else None, None) for i, t in texts]
    df = spark.createDataFrame(rows, DDL)
    # Extra columns whose names clash with the operators' own.
    return df.selectExpr("*", "1 AS h", "2 AS size", "3 AS key", "4 AS rh", "5 AS id") if extra else df


ODD = [(0, None), (1, ""), (2, "  \n\t "), (3, "one"), (4, "the quick brown fox jumps over the lazy dog"),
       (5, "the quick brown fox jumps over the lazy dog"), (5, "the quick brown fox jumps over the lazy dog"),
       (None, "a row without id that has some words to read"), (6, "word " * 30_000)]


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = q.queries()[name](spark, SF)
    want = con.execute(q.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert Counter(map(tuple, got.select(*names).collect())) == Counter(want.fetchall())


def test_language_id(spark):
    docs = {r["doc_id"]: r for r in rows_of(spark)}
    got = q.op1_language_id(spark, SF).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 for r in got)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    held = [r for r in got if r["held_out"]]
    assert sum(docs[r["doc_id"]]["lang"] == r["lang_pred"] for r in held) / len(held) > 0.93


def test_language_id_odd_rows(spark):
    df = frame(spark, ODD, True)
    model = langid.learn(df)
    got = langid.identify(df, model, prefix="x_")
    by = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == len(ODD) and by[0]["x_lang_pred"] == by[2]["x_lang_pred"] == "und" and by[4]["x_lang_pred"] == "en"
    assert langid.identify(df.limit(0), model, prefix="x_").count() == 0
    assert {r["lang_pred"] for r in langid.identify(df, langid.learn(df.limit(0))).collect()} == {"und"}
    with pytest.raises(ValueError):
        langid.identify(df.withColumnRenamed("h", "score"), model)


def base_spans(text):
    """The strict spans by Python's regular expressions."""
    def luhn(d):
        return sum((int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10))) for k, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
                          ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"),
                          ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))
                    or kind == "card" and 13 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


TRICKY = [(0, "é a@b.c_d@e.f x..y@z.w.v @q.r a@b 1.2.3.4.5.6.7.8 256.1.1.1 00255.01.2.3 1.2.3.4"),
          (1, "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111-7 +1 (988) 555-2485 +12 +1234567890123456"),
          (2, "𝒳𝒳 me@x.org +49 30 1234567, tel (212) 555-0100 and mail me at joe [at] example [dot] com"), (3, None), (4, ""),
          (5, "1" * 5000 + " " + "a" * 5000 + "@x.y"), (6, "1 " * 3000 + "1.1.1.1 " * 300)]


def test_personal_data(spark):
    for rows in ([(r["doc_id"], r["text"]) for r in rows_of(spark)], TRICKY):
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        spans = df.select("doc_id", pii.candidates(df["text"]).alias("spans")).cache()
        model = pii.fit(spans)
        got = spans.select("doc_id", pii.accepted(spans["spans"], model).alias("s")).collect()
        texts = dict(rows)
        for r in got:
            strict = [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["s"] if s["strict"]]
            assert strict == base_spans(texts[r["doc_id"]])
        spans.unpersist()


def test_reliabilities_find_the_good_labeler():
    # The first labeler follows the truth in 95 %, the others in 60 %.
    r, counts = random.Random(3), Counter()
    for _ in range(4000):
        y = r.random() < 0.5
        vote = tuple((1 if y else -1) * (1 if r.random() < p else -1) for p in (0.95, 0.6, 0.6))
        counts[vote] += 1
    post, rate = pii.reliabilities([("phone", v, ("free", "free", "9"), n) for v, n in counts.items()])
    assert rate["phone", 0, 1, 1] > 0.85 > 0.75 > rate["phone", 1, 1, 1]
    assert post["phone", (1, -1, -1)] > 0.5 > post["phone", (-1, 1, 1)]


def test_redaction(spark):
    df = frame(spark, [(0, "mail a@b.org or +49 30 1234567 now"), (1, None), (2, ""), (3, "nothing here")], True)
    got = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert got == {0: "mail [EMAIL] or [PHONE] now", 1: None, 2: "", 3: "nothing here"}
    assert pii.redact(df).columns == df.columns and pii.redact(df.limit(0)).count() == 0


def brute_targets(sizes):
    """Targets by raising the level until the capped shares sum up."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        level = (total - sum(2 * sizes[s] for s in capped)) / max(1, sum(w[s] for s in free))
        over = {s for s in free if level * w[s] > 2 * sizes[s]}
        if not over:
            return {s: 2 * sizes[s] if s in capped else level * w[s] for s in names}
        capped |= over


def test_mix(spark):
    rows = rows_of(spark)
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows}
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += size[r["doc_id"]]
    targets = brute_targets(sizes)
    got = q.op3_mix_sources(spark, SF).collect()
    again = q.op3_mix_sources(spark, SF).collect()
    assert sorted(got) == sorted(again) and len(got) == len(rows)
    source, taken = {r["doc_id"]: r["source"] for r in rows}, Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], sizes[s])
        assert math.isclose(r["target"], targets[s], rel_tol=1e-9) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 0.1 * t + max(size.values())


def test_mix_odd_rows(spark):
    got = mixing.mix(frame(spark, ODD, True)).collect()
    assert len(got) == len(ODD) and all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mix(frame(spark, ODD).limit(0)).count() == 0


def test_lm_base(spark):
    rows = rows_of(spark)
    words = {r["doc_id"]: re.findall(rb"[^\x20\x09-\x0D]+", re.sub(
        rb"[A-Z]", lambda m: m[0].lower(), (r["text"] or "").encode())) for r in rows}
    train = [d for d in words if zlib.crc32(str(d).encode()) % 7 != 2]
    counts = Counter(w for d in train for w in [*words[d], None])
    total, distinct = sum(counts.values()), len(counts)
    for frequent in (attention_lm.FREQUENT_WORDS, 50):
        docs = spark.read.parquet(f"{SF}/documents.parquet")
        got = attention_lm.score(docs, q._remainder("doc_id", 7) != 2, frequent_words=frequent, steps=40)
        seen = got.collect()
        assert len(seen) == len(rows)
        for r in seen:
            tokens = [*words[r["doc_id"]], None]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(counts[t] > 0 for t in tokens), total)
            assert math.isclose(r["base_score"], sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in tokens),
                                rel_tol=1e-9)
            assert r["score"] < 0


def test_lm_gradients_and_windows():
    import numpy as np

    r = np.random.RandomState(1)
    m = attention_lm.Model(5)
    m.w = {k: v.astype(np.float64) for k, v in m.w.items()}
    rows = r.randint(0, 50, (2, attention_lm.WINDOW))
    there = np.ones(rows.shape, bool)
    there[0, :5] = False
    target = r.randint(0, 20, rows.shape)
    _, g = m.step(rows, there, target)
    for name in ("Q", "K", "V", "O", "C", "E", "P"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        old, eps = m.w[name][at], 1e-5
        m.w[name][at] = old + eps
        up = m.step(rows, there, target)[0]
        m.w[name][at] = old - eps
        down = m.step(rows, there, target)[0]
        m.w[name][at] = old
        assert abs((up - down) / (2 * eps) - g[name][at]) < 1e-3 * max(1e-2, abs(g[name][at]))
    lengths = np.array([1, 24, 25, 100])
    position, ok, text = attention_lm.windows(lengths, np.cumsum(lengths) - lengths)
    skip = attention_lm.WINDOW - attention_lm.STRIDE
    scored = position[:, skip:][ok[:, skip:]]
    assert sorted(scored.tolist()) == list(range(lengths.sum())) and len(text) == 1 + 1 + 2 + 5


def test_lm_odd_rows(spark):
    df = frame(spark, ODD, True)
    got = attention_lm.score(df, df["doc_id"] < 5, steps=5).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(ODD) and by[0]["n_tokens"] == by[1]["n_tokens"] == by[2]["n_tokens"] == 1
    assert attention_lm.score(df.limit(0), df["doc_id"] < 5, steps=5).count() == 0


def test_lm_learns_from_whole_texts(spark):
    import numpy as np

    head = " ".join(f"w{k % 90}" for k in range(1500))
    texts = [[(k, f"{head} {tail} {k % 7}") for k in range(600)] for tail in ("red green blue " * 30, "blue red green " * 30)]
    ranks = attention_lm.subwords.load()
    counts = np.arange(max(ranks.values()) + 2)[::-1].copy()
    one, two = (attention_lm.fit(spark.createDataFrame(t, "i bigint, text string").select("text"), ranks, counts, steps=1)[0]
                for t in texts)
    assert all(np.isfinite(x).all() for x in one.w.values())
    assert any((one.w[k] != two.w[k]).any() for k in one.NAMES)


def test_lm_takes_every_target_with_its_own_end():
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    ranks = attention_lm.subwords.load()
    encoder = attention_lm.subwords.Encoder(ranks)
    texts = ["one two three " * 2000, None, "", "four"]
    size = encoder.size
    of, row = np.arange(size) % 48, np.arange(size) % 1000
    seen = []
    trainer = attention_lm.Trainer.run
    attention_lm.Trainer.run = lambda self, rows, there, target, passes: seen.append((rows[there], target[there]))
    try:
        shared = SimpleNamespace(value=(ranks, attention_lm.Model().w, of, row))
        out, = attention_lm._trained(shared, 0, 1)([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])])
    finally:
        attention_lm.Trainer.run = trainer
    words = [(t or "").split() for t in texts]
    ids = [[i for w in ws for i in encoder._one(" " + w)] for ws in words]
    wanted = [x for t in ids for x in [*t, encoder.end]]
    before = [x for t in ids for x in [encoder.end, *t]]
    assert out["n"][0].as_py() == len(wanted)
    assert Counter(zip(*(np.concatenate(x).tolist() for x in zip(*seen)))) == Counter(zip(row[before].tolist(), of[wanted].tolist()))


def test_lm_scores_are_the_loss():
    import numpy as np

    r = np.random.RandomState(3)
    for much in (1, 40):  # also where the exponentials leave the range
        m = attention_lm.Model(2)
        m.w["C"] *= np.float32(much)
        rows, there, target = r.randint(0, 900, (3, 32)), np.ones((3, 32), bool), r.randint(0, 48, (3, 32))
        there[1, 20:] = False
        got = m.log_targets(rows, there, 0, target)[there].astype(np.float64)
        assert math.isclose(-np.log(np.exp(got) + 1e-12).mean(), m.step(rows, there, target)[0], rel_tol=1e-4)


@pytest.mark.parametrize("blocks", [1 << 20, 40])
def test_decontaminate_odd_rows(spark, blocks):
    bench = spark.createDataFrame([(1, "The QUICK brown"), (2, None), (3, ""), (None, "lazy dog"), (4, "word " * 12)],
                                  "item_id bigint, text string")
    df = frame(spark, ODD, True)
    got = {r["doc_id"]: r for r in decontaminate.find(df, bench, block_bytes=blocks).collect()}
    assert got[0]["n_words"] == 0 and got[0]["items"] == []
    assert got[4]["hit_words"] == [0, 1, 2, 7, 8] and got[4]["items"] == ["1"]
    assert got[6]["items"] == ["4"] and len(got[6]["hit_words"]) == 30_000
    assert decontaminate.find(df, bench.limit(0)).where("size(hit_words) > 0").count() == 0
    assert decontaminate.find(df.limit(0), bench).count() == 0
    kept = decontaminate.decontaminate(df, bench)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {0, 1, 2, 3, None}


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("window", [1, 3, 5])
def test_longest_matches(spark, window):
    r = random.Random(window)
    text = lambda n, k: " ".join(r.choice("abcd"[:k]) for _ in range(r.randrange(n)))
    items = [(i, text(14, r.choice([2, 3, 4]))) for i in range(12)] + [(20, "x a b c d x y z q"), (21, "u v w p s t")]
    docs = [(i, text(40, r.choice([2, 3, 4]))) for i in range(40)] + [(50, "x a b c d x y z q u v w p s t"), (51, "a " * 500)]
    bench = frame(spark, items).withColumnRenamed("doc_id", "item_id")
    words = {str(i): t.split() for i, t in items}
    for blocks in (1 << 20, 30):
        for row in decontaminate.find(frame(spark, docs), bench, window=window, block_bytes=blocks).collect():
            mine, best = row["text"].split(), {}
            for p in range(len(mine)):
                for w in words.values():
                    for j in range(len(w)):
                        n = common(mine[p:], w[j:])
                        if w and n >= min(window, len(w)):
                            best[p] = max(best.get(p, 0), n)
            want, end = [], 0
            for p, n in sorted(best.items()):
                if p + n > end:
                    want.append((p, n))
                    end = p + n
            assert [(m["start"], m["length"]) for m in row["matches"]] == want
            assert row["longest"] == max(best.values(), default=0)
            for m in row["matches"]:
                assert words[m["item"]][m["item_start"]:][:m["length"]] == mine[m["start"]:][:m["length"]]
    # Words of two items next to each other are two matches.
    two = decontaminate.find(frame(spark, docs), bench, window=window).where("doc_id = 50").first()
    assert [(m["start"], m["length"], m["item"]) for m in two["matches"]][:2] == [(0, 9, "20"), (9, 6, "21")]


def brute_repeats(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            k = raw[p:p + length]
            if k in seen:
                gone[p:p + length] = b"\1" * length
            seen.add(k)
        out[i] = (len(raw), sum(gone), sum(1 for p in range(len(raw)) if gone[p] and not (p and gone[p - 1])),
                  bytes(x for x, g in zip(raw, gone, strict=True) if not g))
    return out


def test_suffix_dedup(spark):
    r = random.Random(5)
    parts = ["".join(r.choice("abc é") for _ in range(r.choice((5, 60, 130, 300)))) for _ in range(12)]
    made = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 6))) or None) for i in range(60)]
    made += [(100, "ab" * 400), (101, "ab" * 70 + "c"), (102, "")]
    for rows in (made, [(x["doc_id"], x["text"]) for x in rows_of(spark)]):
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        got = {x[0]: (x[1], x[2], x[3], bytes(x[4])) for x in suffix_dedup.remove_repeats(df).collect()}
        assert got == brute_repeats(rows, 100)


def test_suffix_dedup_long_text(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 1 << 12)
    r = random.Random(6)
    one = "".join(r.choice("abcdefgh ") for _ in range(9000))
    rows = [(0, one), (1, one[3000:] + "x" + one[:4090]), (2, None)]
    import numpy as np
    import pyarrow as pa

    # The pieces of a long text have the same runs as the whole.
    from shiftlab.llm import bytearrays as ba
    data, offsets = ba.flat(pa.array([one]))
    cut = suffix_dedup._runs(data, offsets, 100, 32)
    monkeypatch.setattr(suffix_dedup, "PIECE", 1 << 21)
    whole = suffix_dedup._runs(data, offsets, 100, 32)
    cover = lambda x: {(int(p), int(a)) for lo, hi, a in zip(*x[1:4], strict=True) for p in range(lo, hi + 1)}
    assert cover(cut) == cover(whole) and len(np.unique(whole[0])) == 1
    got = {x[0]: (x[1], x[2], x[3], bytes(x[4])) for x in suffix_dedup.remove_repeats(
        spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_repeats(rows, 100)


def test_suffix_dedup_odd_rows(spark):
    got = suffix_dedup.remove_repeats(frame(spark, ODD, True)).collect()
    assert len(got) == len(ODD) and {r["n_removed"] for r in got if r["doc_id"] == 5} == {0}
    assert suffix_dedup.remove_repeats(frame(spark, ODD).limit(0)).count() == 0


def test_multikey_order():
    import numpy as np

    r = np.random.RandomState(2)
    words = r.randint(0, 3, (500, 4)).astype(np.uint64)
    tie = r.permutation(500)
    order, again = suffix_dedup.multikey_order(words, (tie,))
    want = sorted(range(500), key=lambda i: (*words[i].tolist(), tie[i]))
    assert order.tolist() == want
    assert again.tolist() == [k > 0 and (words[want[k]] == words[want[k - 1]]).all() for k in range(500)]


def test_trie_counts(spark):
    pieces = trie_counts.vocabulary()
    counter = trie_counts.TrieCounter(pieces)

    def alone(word):
        word, best = trie_counts.SPACE + word, [(0.0, 0)]
        for end in range(1, len(word) + 1):
            n = len(word[end - 1].encode())
            tried = [(best[end - 1][0] + n * counter.byte, -(best[end - 1][1]) - n)]
            tried += [(best[s][0] + pieces[word[s:end]], -best[s][1] - 1) for s in range(end) if word[s:end] in pieces]
            top = max(tried)
            best.append((top[0], -top[1]))
        return best[-1][1]

    words = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "") for r in rows_of(spark)}
    for r in q.op7_token_counts(spark, SF).collect():
        if r["doc_id"] % 10 == 0:
            assert (r["n_pretokens"], r["n_tokens"]) == (len(words[r["doc_id"]]), sum(map(alone, words[r["doc_id"]])))
    got = {r["doc_id"]: r["n_pretokens"] for r in trie_counts.token_counts(frame(spark, ODD, True)).collect()}
    assert got[0] == got[2] == 0 and got[6] == 30_000
    assert trie_counts.token_counts(frame(spark, ODD).limit(0)).count() == 0


def brute_groups(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower() if t else "")
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard_join_chains_and_crowds(spark):
    r = random.Random(9)
    words = [f"w{k}" for k in range(400)]
    rows, n = [], 0
    shared = [r.choice(words) for _ in range(40)]
    for _ in range(6):  # crowds of near copies with a passage that all share
        one = [r.choice(words) for _ in range(120)] + shared
        for _ in range(12):
            two = list(one)
            for _ in range(r.randint(0, 4)):
                two[r.randrange(len(two))] = r.choice(words)
            rows.append((n, " ".join(two)))
            n += 1
    chain = [r.choice(words) for _ in range(100)]
    for _ in range(15):  # each near the one before only
        chain = chain[4:] + [r.choice(words) for _ in range(4)]
        rows.append((n, " ".join(chain)))
        n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "one two"), (n + 3, "ONE  two"), (n + 4, "one")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {x[0]: (x[1], x[2]) for x in jaccard_join.near_groups(df).collect()}
    assert got == brute_groups(rows)


def crowd(r, n, words, edits, copies):
    """Texts of ``n`` words, each one text with some words changed anew."""
    one = [f"w{r.randrange(10 ** 6)}" for _ in range(n)]
    out = []
    for _ in range(copies):
        two = list(one)
        for k in r.sample(range(n), edits(r)):
            two[k] = f"x{r.randrange(10 ** 9)}" if words is None else r.choice(words)
        out.append(" ".join(two))
    return out


def test_jaccard_join_crowds_near_the_threshold(spark):
    r = random.Random(12)
    few = [f"e{k}" for k in range(3)]
    texts = (crowd(r, 200, None, lambda r: r.randint(0, 8), 60)  # edits of their own, some pairs linked
             + crowd(r, 200, few, lambda r: r.randint(3, 7), 60)  # the original is not there, edits repeat
             + crowd(r, 60, few[:1], lambda r: r.randint(1, 4), 60))
    for k in range(20):  # pairs that share many edits, so that far from the rest they are linked
        texts.append(texts[k] + " " + " ".join(f"t{j}" for j in range(40)))
        texts.append(texts[k + 60].replace("w", "w1", 30))
        texts.append(texts[k + 60].replace("w", "w1", 30) + " end")
    rows = list(enumerate(texts))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {x[0]: (x[1], x[2]) for x in jaccard_join.near_groups(df).collect()}
    assert got == brute_groups(rows)
    assert len({g for _, g in got.values()}) > 10


def test_jaccard_join_pairs_grow_with_the_rows(spark, monkeypatch):
    """Long near copies that are all just too far apart: pairs do not grow with their square."""
    made = {}
    written = jaccard_join.written

    def counted(df, name, tidy=True):
        out = written(df, name, tidy)
        if name in ("tried", "shared", "pairs"):
            made[copies] = made.get(copies, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard_join, "written", counted)
    for copies in (50, 200):
        rows = list(enumerate(crowd(random.Random(5), 1500, None, lambda r: 40, copies)))
        got = jaccard_join.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
        assert all(x["component_id"] == x["doc_id"] and not x["n_links"] for x in got) and len(got) == copies
    assert made[200] <= 4 * 200, made


def test_jaccard_join_odd_rows(spark):
    got = jaccard_join.near_groups(frame(spark, ODD, True)).collect()
    by = {r["doc_id"]: r["component_id"] for r in got}
    assert len(got) == len(ODD) and by[5] == by[4] == 4 and by[0] == 0 and by[1] == 1
    assert jaccard_join.near_groups(frame(spark, ODD).limit(0)).count() == 0


ONE_ID = [(3, "a b c d e f g h i j k l m n"), (7, "a  b c d e f g h i j k l m n"), (7, "this text of id seven stands quite alone here"),
          (None, "a b c d e f g h i j k l m n"), (None, "no id and no copy in the whole table of texts"),
          (None, "another text without id that is unlike the others"), (None, "another text without id that is unlike the others"),
          (None, None), (None, ""), (None, " \n"), (None, " \n"), (8, ""), (8, ""), (9, "two rows of one id and of one text"),
          (9, "two rows of one id and of one text"), (None, "mail joe@x.org or leave it as it is, my friend")]


def brute_first(rows):
    """The (id, text) that stay: per group of linked rows the least id, none last; texts without words all."""
    worded = [x for x in rows if (x[1] or "").split()]
    groups = brute_groups([(k, t) for k, (_, t) in enumerate(worded)])
    out = Counter(x for x in rows if not (x[1] or "").split())
    for g in {root for _, root in groups.values()}:
        some = [worded[k] for k, (_, root) in groups.items() if root == g]
        least = min((i is None, i or 0) for i, _ in some)
        yes = sorted({x for x in some if (x[0] is None, x[0] or 0) == least}, key=str)
        assert len(yes) == 1  # the rows below leave no choice
        out[yes[0]] += 1
    return out


def test_pipeline_near_copies(spark):
    df = frame(spark, ONE_ID)
    got = corpus_pipeline.near_copies(spark, df, SF)
    assert got.columns == df.columns
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == brute_first(ONE_ID)
    # Of rows that differ in the text alone one stays, and the same whatever the partitions.
    long = " ".join(f"w{k}" for k in range(200))
    near = [(None, f"{long} {k}") for k in range(9)]
    one, = {tuple(map(tuple, corpus_pipeline.near_copies(spark, frame(spark, near).repartition(n), SF).select("text").collect())) for n in (1, 5)}
    assert len(one) == 1
    assert corpus_pipeline.near_copies(spark, df.limit(0), SF).count() == 0


def test_pipeline(spark, tmpdir_path):
    bench = "one passage of a benchmark item that is ten words and more long"
    rows = ONE_ID + [(40, f"before it {bench} and after"), (None, f"{bench} once more")]
    spark.createDataFrame([(1, bench)], "item_id bigint, text string").write.parquet(f"{tmpdir_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    docs.unionByName(frame(spark, rows).select(*docs.columns)).write.parquet(f"{tmpdir_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmpdir_path}/documents.parquet")
    known = corpus_pipeline.language(spark, docs, tmpdir_path).collect()
    kept = brute_first([(r["doc_id"], r["text"]) for r in known])
    clean, left = [], Counter(kept)
    for r in known:
        if left[r["doc_id"], r["text"]] and bench not in (r["text"] or ""):
            left[r["doc_id"], r["text"]] -= 1
            clean.append(r)
    want = corpus_pipeline.mix(spark, corpus_pipeline.personal_data(spark, spark.createDataFrame(clean, docs.schema), ""), "")
    got = corpus_pipeline.run(spark, tmpdir_path)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect())) and got.count()


def test_sketches_bound_the_distance():
    import numpy as np

    r = np.random.RandomState(4)
    for na, nb, common in ((10, 900, 5), (300, 310, 290), (1, 1, 0)):
        both = r.randint(0, 1 << 62, na + nb - common).astype(np.uint64)
        a, b = np.sort(both[:na]), np.sort(both[na - common:])
        x, = jaccard_join.wide_sketches(a, np.array([0, na]))
        y, = jaccard_join.wide_sketches(b, np.array([0, nb]))
        assert jaccard_join.apart(x, y) <= na + nb - 2 * common


def test_reply_trees(spark):
    rows = [("c", 1, None, 1.0, "user", "hi"), ("c", 2, 1, 1.0, "assistant", "a</s>\n&lt;[x]"), ("c", 3, 1, 3.0, "assistant", "b"),
            ("c", 4, 3, 0.0, "user", None), ("c", 5, 2, 9.0, None, "z"), ("d", 1, 2, 1.0, "user", "x"), ("d", 2, 1, 1.0, "user", "y"),
            ("e", 7, 99, None, "assistant", ""), ("e", 7, 99, None, "assistant", ""), (None, 1, None, 1.0, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id string, node bigint, parent bigint, score double, role string, text string")
    df = df.selectExpr("*", "1 AS conv", "2 AS leaf", "3 AS m")
    got = chat_trees.conversations(df, branches=5)
    got = got.select("conv_id", "branch", "leaf", chat_trees.read_turns(got["formatted"]).alias("t"),
                     chat_trees.read_loss(got["formatted"], got["loss_spans"]).alias("loss")).collect()
    seen = {(r[0], r[1]): (r[2], [tuple(x) for x in r[3]], r[4]) for r in got}
    assert seen == {
        ("c", 1): (5, [("user", "hi"), ("assistant", "a</s>\n&lt;[x]"), ("", "z")], "a</s>\n&lt;[x]"),
        ("c", 2): (4, [("user", "hi"), ("assistant", "b"), ("user", "")], "b"),
        ("e", 1): (7, [("assistant", "")], ""),
        (None, 1): (1, [("user", "q")], "")}
    assert chat_trees.conversations(df.limit(0)).count() == 0


def test_reply_trees_without_conversation_and_ties(spark):
    rows = [(None, 1, None, "user", "q"), (None, 2, 1, "assistant", "x" * 300_000), (None, 3, 1, "assistant", "tie"),
            (0, 1, None, "user", "zero"), (-7, 1, None, "assistant", "minus")]
    df = spark.createDataFrame(rows, "conv_id bigint, node bigint, parent bigint, role string, text string").selectExpr("*", "1.0 AS score")
    got = chat_trees.conversations(df, branches=2)
    got = {(r[0], r[1]): (r[2], [tuple(x) for x in r[3]]) for r in got.select(
        "conv_id", "branch", "leaf", chat_trees.read_turns(got["formatted"])).collect()}
    assert got == {(None, 1): (2, [("user", "q"), ("assistant", "x" * 300_000)]), (None, 2): (3, [("user", "q"), ("assistant", "tie")]),
                   (0, 1): (1, [("user", "zero")]), (-7, 1): (1, [("assistant", "minus")])}


def test_reply_trees_deep(spark):
    df = spark.range(1, 71).selectExpr("1 AS conv_id", "id AS node", "if(id > 1, id - 1, NULL) AS parent", "0 AS score",
                                       "'user' AS role", "cast(id AS string) AS text")
    got = chat_trees.conversations(df)
    turns = got.select(chat_trees.read_turns(got["formatted"])).first()[0]
    assert [t["text"] for t in turns] == [str(k) for k in range(1, 71)]


def edited(rows):
    rows = sorted(rows)
    out = {}
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(t) // 4
        out[i] = (len(t), hashlib.sha256((t[:len(t) - cut] + after[:cut]).encode()).hexdigest())
    return out


def test_fingerprints(spark):
    rows = [(r["doc_id"], r["text"]) for r in rows_of(spark)]
    got = q.op10_fingerprints(spark, SF).collect()
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in got} == edited(rows)
    prints = {}
    for r in got:
        assert prints.setdefault(dict(rows)[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
    assert sum(r["near_edited"] for r in got) > 20 * sum(r["near_next"] for r in got)


def test_fingerprint_likeness_is_exact(spark):
    r = random.Random(8)
    lines = [f"line {k} of the text" for k in range(400)]
    texts = ["\n".join(r.sample(lines, n)) for n in (1, 3, 20, 20, 150, 390, 380)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {x["doc_id"]: x["near_next"] for x in iblt.fingerprints(df).collect()}
    for k, t in enumerate(texts):
        a, b = set(t.split("\n")), set(texts[(k + 1) % len(texts)].split("\n"))
        assert math.isclose(got[k], len(a & b) / len(a | b))


def test_fingerprints_of_texts_without_separators(spark):
    r = random.Random(12)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 10))) for _ in range(3000)]
    kinds = [lambda n: " ".join(r.choices(words, k=n // 7)), lambda n: "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(n)),
             lambda n: ", ".join(r.choices(words, k=n // 8)), lambda n: "\t".join(str(r.random()) for _ in range(n // 18))]
    texts = [kind(n) for n in (450, 2000, 33_000) for kind in kinds] + [f"{r.choice(words)} " * 900, " " * 5000 + "a" * 5000]
    got = {x["doc_id"]: x for x in iblt.fingerprints(frame(spark, list(enumerate(texts)))).collect()}
    for k in range(len(texts)):
        assert got[k]["near_edited"] > (0.25 if 500 < len(texts[k]) and k < 12 else 0), (k, got[k]["near_edited"])
        assert k >= 12 or got[k]["near_next"] < 0.05
    # An insertion changes the pieces around it alone, and the pieces are the whole text.
    long = kinds[0](20_000)
    df = spark.createDataFrame([(long,), (long[:9000] + " some new words " + long[9000:],)], "text string")
    (a, p), (b, _) = df.select(iblt.digests(df["text"]), iblt._cut(df["text"])).collect()
    assert "".join(p) == long and len(a) > 100 and len(set(a) - set(b)) <= 4
    # No text of some length loses all likeness while three quarters of it are unchanged.
    assert not [x["doc_id"] for x in q.op10_fingerprints(spark, SF).collect() if x["n_chars"] >= 400 and x["near_edited"] == 0]


def test_fingerprints_odd_rows(spark):
    got = iblt.fingerprints(frame(spark, ODD, True)).collect()
    assert len(got) == len(ODD)
    assert iblt.fingerprints(frame(spark, ODD[:1])).first()["near_next"] == 1.0
    assert iblt.fingerprints(frame(spark, ODD).limit(0)).count() == 0
