"""Language-model scoring with a small causal self-attention model in numpy.

The model predicts the next subword id from the ids before it in its window.  An
id is a leaf of a Huffman tree over the corpus counts (plus one), and
``P(id | context)`` is the product of the turns on the way to it; each node has a
vector of its own, and starts with the odds of the counts.  Every id that the
training texts hold has a leaf and an embedding; the ids that none of them holds
share one leaf equally, as nothing tells them apart.  Weights are fitted on every
window of every training text, and counts of ids and of words cover all of them too.

The ids are written once and read by the counts, the fit and the scores.  Fitting
goes in ``ROUNDS`` jobs.  A round takes its share of the texts by hash,
each task steps from the weights so far through all windows of its rows, and the
new weights are the tasks' weights averaged by their targets.  The tasks follow
the table's partitions, so other partitions give slightly other weights.

A text is the ids of its words and an end.  Windows overlap: each holds
``WINDOW`` inputs and scores the last ``STRIDE`` of its targets, so each target
is scored once and, but for the first, has ``WINDOW - STRIDE`` ids before it at
least.  Windows of many texts make one batch with a mask for what lies before
the text's start and after each position.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from shiftlab.llm import bytearrays as ba
from shiftlab.llm import subwords
from shiftlab.llm.store import ready, written

WINDOW, STRIDE, WIDTH = 32, 24, 8
#: Leaves of a model without counts.
LEAVES = 1024
#: Nodes from the root on whose gradients are products of matrices.
NEAR = 64
#: Jobs of the fit; steps of BATCH windows that a small corpus gets by passing over it more than once.
ROUNDS, STEPS, BATCH, RATE = 4, 150, 128, 0.02
#: Weights are averaged as whole numbers of this part, so that the order of tasks does not matter; so many a row.
PART, ACROSS = 1 << 40, 8
#: Words whose counts every task holds (16 bytes each); the others meet their counts in a join.
FREQUENT_WORDS = 200_000
#: Bytes of an Arrow batch, and of the texts whose words are held as arrays at once (each word and byte takes some tens of bytes).
BATCH_BYTES, TEXT_BYTES = str(4 << 20), 512 << 10
END_HASH = 0x5851F42D4C957F2D
F32 = np.float32


def leaves(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(leaf of each id, log10 P(id | leaf), weights of the leaves) from corpus counts.

    Ids that occur come first, the most frequent at 0; the others share the last leaf.
    """
    order = np.lexsort((np.arange(len(counts)), -counts))
    seen = int((counts > 0).sum())
    leaf = np.empty(len(counts), np.int64)
    leaf[order] = np.minimum(np.arange(len(counts)), seen)
    rest = len(counts) - seen
    weights = np.append(counts[order[:seen]] + 1.0, [float(rest)] if rest else [])
    return leaf, np.where(leaf < seen, 0.0, -math.log10(max(rest, 1))), weights


class Tree:
    """The ways from the root of a Huffman tree to its leaves.

    ``node`` and ``turn`` (1 or -1) from ``at[i]`` to ``at[i + 1]`` lead to leaf i;
    ``odds`` are the log odds of each node's turn 1 by the weights.  Node 0 is the root.
    """

    def __init__(self, weights: np.ndarray):
        n = len(weights)
        up, turn, odds = np.zeros(2 * n, np.int64), np.ones(2 * n, F32), np.zeros(max(n - 1, 0))
        heap = [(w, i) for i, w in enumerate(np.asarray(weights, float).tolist())]
        heapq.heapify(heap)
        for new in range(n, 2 * n - 1):
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            up[i] = up[j] = new
            turn[i] = -1
            odds[2 * n - 2 - new] = math.log(b / a)
            heapq.heappush(heap, (a + b, new))
        leaf, place, ways = np.arange(n), np.arange(n), []
        while True:
            below = place < 2 * n - 2
            leaf, place = leaf[below], place[below]
            if not len(leaf):
                break
            ways.append((leaf, 2 * n - 2 - up[place], turn[place]))
            place = up[place]
        leaf, self.node, self.turn = (np.concatenate(x) for x in zip(*ways, strict=True)) if ways else (
            np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, F32))
        order = np.argsort(leaf, kind="stable")
        self.node, self.turn = self.node[order], self.turn[order]
        self.at = np.concatenate([[0], np.cumsum(np.bincount(leaf, minlength=n))])
        self.odds, self.size = odds.astype(F32), n

    def ways(self, target: np.ndarray):
        """(place in ``target``, node, turn) of every turn to the target leaves."""
        first = self.at[target]
        n = self.at[target + 1] - first
        of = np.repeat(np.arange(len(target)), n)
        first -= np.cumsum(n) - n
        step = first.take(of)
        step += np.arange(len(of))
        return of, self.node.take(step), self.turn.take(step)


class Model:
    """Single-head causal attention with a residual and a softmax over the leaves of a tree, turn by turn."""

    NAMES = ("E", "P", "Q", "K", "V", "O", "C", "B")

    def __init__(self, seed: int = 7, tree: Tree | None = None):
        r = np.random.RandomState(seed)
        self.tree = tree or Tree(np.ones(LEAVES))
        d, n = WIDTH, self.tree.size
        shapes = {"E": (n, d), "P": (WINDOW, d), "Q": (d, d), "K": (d, d), "V": (d, d), "O": (d, d), "C": (n - 1, d)}
        self.w = {k: (r.standard_normal(s) * (0.3 if k in "EP" else 1 / math.sqrt(d))).astype(F32)
                  for k, s in shapes.items()}
        self.w["C"] *= F32(0.1)
        self.w["B"] = self.tree.odds.copy()

    def _turns(self, y: np.ndarray, target: np.ndarray):
        """(place in ``target``, node, turn, log odds of the turn taken) of every turn to the targets of ``y``'s rows."""
        of, node, turn = self.tree.ways(target)
        z = y.take(of, 0)
        z *= self.w["C"].take(node, 0)
        z = z @ np.ones(WIDTH, z.dtype)
        z += self.w["B"].take(node)
        z *= turn
        return of, node, turn, z

    def _attend(self, x: np.ndarray, there: np.ndarray, skip: int):
        """(queries, keys, values, weights, heads' output) for inputs from ``skip`` on."""
        w, n = self.w, x.shape[1]
        q, k, v = x[:, skip:] @ (w["Q"] * F32(1 / math.sqrt(WIDTH))), x @ w["K"], x @ w["V"]
        s = q @ k.transpose(0, 2, 1)
        _exp(s)
        s *= np.tri(n, dtype=s.dtype)[skip:]
        if not there.all():
            s *= there[:, None, :]
        s /= s @ np.ones((n, 1), s.dtype) + F32(1e-30)
        return q, k, v, s, s @ v

    def log_targets(self, rows: np.ndarray, there: np.ndarray, skip: int, target: np.ndarray) -> np.ndarray:
        """log P of the ``target`` leaves of the inputs from ``skip`` on; (windows, targets)."""
        w = self.w
        x = w["E"].take(rows, 0)
        x += w["P"]
        o = self._attend(x, there, skip)[-1]
        y = x[:, skip:] + o @ w["O"]
        of, _, _, z = self._turns(y.reshape(-1, WIDTH), target.reshape(-1))
        return np.bincount(of, _log_sigmoid(z)[0], target.size).reshape(target.shape)

    def step(self, rows: np.ndarray, there: np.ndarray, target: np.ndarray) -> tuple[float, dict]:
        """(loss, gradients) over all targets of a batch of windows."""
        w, scale = self.w, F32(1 / math.sqrt(WIDTH))
        x = w["E"].take(rows, 0)
        x += w["P"]
        q, k, v, a, o = self._attend(x, there, 0)
        y = x + o @ w["O"]
        flat = lambda m: m.reshape(-1, m.shape[-1])
        some = np.flatnonzero(there)
        y = flat(y).take(some, 0)
        of, turned, turn, z = self._turns(y, target[there])
        log, e = _log_sigmoid(z)
        loss = float(-np.log(np.exp(np.bincount(of, log, len(some))) + 1e-12).mean())
        # Of a turn's logit: 1 less its probability, against the turn.
        dz = turn * np.where(z > 0, e, 1) / (1 + e)
        dz /= -max(len(some), 1)
        dz = dz.astype(z.dtype, copy=False)
        m, near = len(w["B"]), turned < NEAR
        # Most turns are at the nodes near the root: products with a matrix of targets and nodes; the others one by one.
        top, far, near = np.zeros((len(some), NEAR), z.dtype), np.flatnonzero(~near), np.flatnonzero(near)
        cell = of.take(near)
        cell *= NEAR
        cell += turned.take(near)
        top.reshape(-1)[cell] = dz.take(near)
        top = top[:, :m]
        of, node, dz_far = of.take(far), turned.take(far), dz.take(far)[:, None]
        ys, c = y.take(of, 0), w["C"].take(node, 0)
        ys *= dz_far
        c *= dz_far
        g = {"C": _sums(node, ys, m).astype(z.dtype), "B": np.bincount(turned, dz, m)}
        g["C"][:NEAR] += top.T @ y
        # A target's part; what lies outside the text takes the row of zeros behind them.
        part = np.zeros((len(some) + 1, WIDTH), x.dtype)
        np.matmul(top, w["C"][:NEAR], out=part[:-1])
        if len(of):
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            to = of.take(first)
            part[to] = part.take(to, 0) + np.add.reduceat(c, first)
        of = np.full(there.size, len(some))
        of[some] = np.arange(len(some))
        dy = part.take(of, 0).reshape(x.shape)
        g["O"] = flat(o).T @ flat(dy)
        do = dy @ w["O"].T
        ds = do @ v.transpose(0, 2, 1)
        ds *= a
        ds -= a * (ds @ np.ones((ds.shape[-1], 1), ds.dtype))
        dq, dk, dv = ds @ k * scale, ds.transpose(0, 2, 1) @ q, a.transpose(0, 2, 1) @ do
        dx = dy + dq @ w["Q"].T + dk @ w["K"].T + dv @ w["V"].T
        for name, m in (("Q", dq), ("K", dk), ("V", dv)):
            g[name] = flat(x).T @ flat(m)
        if len(some) < there.size:
            dx[~there] = 0
        g["P"] = dx.sum(0)
        g["E"] = _sums(rows.reshape(-1), flat(dx), len(w["E"]))
        return loss, g


def _sums(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of each place below ``n``."""
    cell = at[:, None] * WIDTH + np.arange(WIDTH)
    return np.bincount(cell.reshape(-1), rows.reshape(-1), n * WIDTH).reshape(n, WIDTH)


def _exp(z: np.ndarray) -> None:
    """exp of ``z`` in place, less the largest of the last axis where that could leave the range."""
    if max(z.max(initial=0), -z.min(initial=0)) > 60:
        z -= z.max(-1, keepdims=True)
    np.exp(z, out=z)


def _log_sigmoid(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log of the logistic function of ``z``, and exp(-abs(z))."""
    e = np.exp(-np.abs(z))
    return np.minimum(z, 0) - np.log(1 + e), e


class Trainer:
    """Adam steps of a model through all windows that it is given."""

    def __init__(self, model: Model, rate: float, seed: int):
        self.model, self.rate, self.t, self.r = model, rate, 0, np.random.RandomState(seed)
        self.m = {k: np.zeros_like(v) for k, v in model.w.items()}
        self.s = {k: np.zeros_like(v) for k, v in model.w.items()}

    def run(self, rows: np.ndarray, there: np.ndarray, target: np.ndarray, passes: int) -> list[float]:
        """The losses of the steps; each pass takes every window once, in random order."""
        losses = []
        for _ in range(passes):
            order = self.r.permutation(len(rows))
            for i in range(0, len(order), BATCH):
                pick = order[i:i + BATCH]
                loss, g = self.model.step(rows[pick].astype(np.int64), there[pick], target[pick].astype(np.int64))
                losses.append(loss)
                self.t += 1
                t, rate = self.t, self.rate / math.sqrt(1 + self.t / STEPS)
                for k, x in g.items():
                    x, m, s = x.astype(F32, copy=False), self.m[k], self.s[k]
                    d = x - m
                    d *= F32(0.1)
                    m += d
                    np.multiply(x, x, out=d)
                    d -= s
                    d *= F32(0.01)
                    s += d
                    np.multiply(s, F32(1 / (1 - 0.99 ** t)), out=d)
                    np.sqrt(d, out=d)
                    d += F32(1e-8)
                    self.model.w[k] -= np.divide(F32(rate / (1 - 0.9 ** t)) * m, d, out=d)
        return losses


def windows(lengths: np.ndarray, first: np.ndarray, stride: int = STRIDE):
    """(positions of inputs, whether they are in the text, text) of overlapping windows.

    A text of n targets has inputs ``first .. first + n - 1``; input i comes
    just before target i.
    """
    count = -(-lengths // stride)
    text = np.repeat(np.arange(len(lengths)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    local = (k * stride - (WINDOW - stride))[:, None] + np.arange(WINDOW)
    there = (local >= 0) & (local < lengths[text][:, None])
    return np.where(there, first[text][:, None] + local, 0), there, text


def laid_out(ids: np.ndarray, at: np.ndarray, end: int, stride: int):
    """(inputs, targets, positions, whether in the text, text) of texts, each its ids and then the end."""
    targets = np.insert(ids, at[1:], end)
    inputs = np.insert(ids, at[:-1], end)  # the end stands for the beginning too
    return inputs, targets, *windows(np.diff(at) + 1, at[:-1] + np.arange(len(at) - 1), stride)


def text_log10(ids: np.ndarray, at: np.ndarray, end: int, model: Model, of: np.ndarray, row: np.ndarray,
               within: np.ndarray, block: int = 128) -> np.ndarray:
    """log10 P of each text, whose ids are ``ids[at[i]:at[i + 1]]`` and then the end."""
    n = len(at) - 1
    inputs, targets, position, there, text = laid_out(ids, at, end, STRIDE)
    total = np.bincount(np.repeat(np.arange(n), np.diff(at) + 1), within[targets], n)
    skip = WINDOW - STRIDE
    rows, wanted = row[inputs], of[targets]
    for i in range(0, len(position), block):
        p, t = position[i:i + block], there[i:i + block]
        got = model.log_targets(rows[p], t, skip, wanted[p[:, skip:]])
        got[~t[:, skip:]] = 0
        np.add.at(total, text[i:i + block], got.sum(-1, dtype=np.float64) / math.log(10))
    return total


def _words(batch: pa.RecordBatch):
    """(first row, lower-cased bytes, starts, ends, word offsets, hashes) of slices of a batch."""
    data, offsets = ba.flat(batch.column(batch.schema.get_field_index("text")))
    for i, j in ba.slices(offsets, TEXT_BYTES):
        low = subwords.lowered(data[offsets[i]:offsets[j]])
        starts, ends, at = ba.word_spans(low, offsets[i:j + 1] - offsets[i], ba.NOT_SPACE)
        yield i, low, starts, ends, at, ba.span_hashes(low, starts, ends)


def _kind(size: int) -> np.dtype:
    """Of a written id."""
    return np.dtype("<u2" if size <= 1 << 16 else "<u4")


class Ids:
    """The ids of a batch's texts: the written ones, or else those of the texts themselves."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.end, self.encoder = ranks, max(ranks.values()) + 1, None

    def of(self, batch: pa.RecordBatch):
        """(ids, offsets) of slices of a batch."""
        if "ids" in batch.schema.names:
            data, offsets = ba.flat(batch.column(batch.schema.get_field_index("ids")))
            kind = _kind(self.end + 1)
            for i, j in ba.slices(offsets):
                yield (np.frombuffer(data[offsets[i]:offsets[j]].tobytes(), kind).astype(np.int64),
                       (offsets[i:j + 1] - offsets[i]) // kind.itemsize)
            return
        self.encoder = self.encoder or subwords.Encoder(self.ranks)
        for _, low, starts, ends, at, h in _words(batch):
            ids, n = self.encoder.ids(low, starts, ends, h)
            yield ids, np.concatenate([[0], np.cumsum(n)])[at]


def _count(batches):
    """(key, n): counts of words by hash in a batch, ends included."""
    for batch in batches:
        words = [np.array([[END_HASH], [batch.num_rows]], ba.U64)]
        for *_, h in _words(batch):
            h, c = np.unique(h, return_counts=True)
            words.append(np.stack([h, c.astype(ba.U64)]))
        pairs = np.concatenate(words, 1)
        h, back = np.unique(pairs[0], return_inverse=True)
        n = np.bincount(back, pairs[1].astype(np.float64)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([ba.signed(h), pa.array(n)], ["key", "n"])


def _count_ids(shared):
    """(key, n): how often each id occurs in a task's texts, ends included."""
    def run(batches):
        reader = Ids(shared.value)
        n = np.zeros(reader.end + 1, np.int64)
        for batch in batches:
            for ids, at in reader.of(batch):
                n += np.bincount(ids, minlength=len(n))
                n[reader.end] += len(at) - 1
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n[seen])], ["key", "n"])

    return run


def _encode(shared):
    """A row's n_tokens, ids, and base terms: those of frequent words summed, others listed."""
    def run(batches):
        ranks, frequent, counts = shared.value
        encoder, log_counts = subwords.Encoder(ranks), np.log10(counts + 1.0)
        kind = _kind(encoder.size)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_tokens", "known", "logs", "rare", "times", "ids")}
            for _, low, starts, ends, at, h in _words(batch):
                text = ba.texts_of(at)
                alike = subwords.distinct_words(h)
                ids, n = encoder.ids(low, starts, ends, h, alike)
                id_at = np.concatenate([[0], np.cumsum(n)])[at] * kind.itemsize
                raw = ids.astype(kind).tobytes()
                out["ids"] += [raw[i:j] for i, j in zip(id_at[:-1].tolist(), id_at[1:].tolist(), strict=True)]
                out["n_tokens"].append(np.diff(at) + 1)
                distinct, _, back = alike
                k = np.searchsorted(frequent, distinct) if len(frequent) else np.zeros(len(distinct), np.int64)
                k[k == len(frequent)] = 0
                found = frequent[k] == distinct if len(frequent) else np.zeros(len(distinct), bool)
                k, found = k.take(back), found.take(back)
                texts = len(at) - 1
                out["known"].append(np.bincount(text[found], minlength=texts))
                out["logs"].append(np.bincount(text[found], log_counts[k[found]], texts))
                text, h = text[~found], h[~found]
                order = np.lexsort((h, text))
                text, h = text[order], h[order]
                new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])])) \
                    if len(h) else np.zeros(0, np.int64)
                times = np.diff(np.append(new, len(h)))
                border = np.searchsorted(text[new], np.arange(1, texts))
                out["rare"] += [x.view(np.int64) for x in np.split(h[new], border)]
                out["times"] += np.split(times.astype(np.int32), border)
            if not out["ids"]:
                continue
            flat = {k: np.concatenate(out[k]) for k in ("n_tokens", "known", "logs")}
            yield pa.RecordBatch.from_arrays([
                *(c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name != "text"),
                pa.array(flat["n_tokens"].astype(np.int64)), pa.array(flat["known"].astype(np.int64)),
                pa.array(flat["logs"].astype(np.float64)),
                pa.array(out["rare"], pa.list_(pa.int64())), pa.array(out["times"], pa.list_(pa.int32())),
                pa.array(out["ids"], pa.binary())],
                [*(x for x in batch.schema.names if x != "text"), *out])

    return run


def _score(shared):
    """A row's LM score, beside its other columns but the ids."""
    def run(batches):
        ranks, model, leaf, within = shared.value
        reader = Ids(ranks)
        for batch in batches:
            got = [text_log10(ids, at, reader.end, model, leaf, leaf, within) for ids, at in reader.of(batch)]
            if got:
                kept = [name for name in batch.schema.names if name != "ids"]
                yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in kept), pa.array(np.concatenate(got))],
                                                 [*kept, "score"])

    return run


def _trained(shared, k: int, passes: int, total: int = 1):
    """(place, values, targets) of the weights after all windows of a task's texts: whole parts times its share of ``total``."""
    def run(batches):
        ranks, start, of, row, *tree = shared.value
        reader, model, seen = Ids(ranks), Model(7, *tree), 0
        model.w = {name: x.copy() for name, x in start.items()}
        trainer = Trainer(model, RATE * (1 - k / ROUNDS), 11 + k)
        for batch in batches:
            for ids, at in reader.of(batch):
                inputs, targets, position, there, _ = laid_out(ids, at, reader.end, WINDOW)
                seen += len(targets)
                inputs, targets = row.astype(np.int32)[inputs], of.astype(np.int32)[targets]
                trainer.run(inputs[position], there, targets[position], passes)
        if seen:
            flat = np.concatenate([model.w[name].reshape(-1) for name in Model.NAMES]).astype(np.float64)
            flat = np.rint(np.resize(flat, (-(-len(flat) // ACROSS), ACROSS)) * (PART * (seen / total))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(len(flat), dtype=np.int32)), *(pa.array(x) for x in flat.T),
                pa.array(np.full(len(flat), seen, np.int64))], ["place", *(f"v{j}" for j in range(ACROSS)), "n"])

    return run


def fit(train: DataFrame, ranks: dict[bytes, int], counts: np.ndarray, *, steps: int = STEPS):
    """(model, leaf of each id, log10 P of the id in its leaf) of a corpus, given the counts of its ids.

    ``train`` holds a column ``ids`` of written ids, or else a column ``text``.  The
    weights see every window of every text.  A corpus with fewer than ``steps`` batches
    of windows is passed over again until about as many.  The driver gets the averaged
    weights alone, a row for each eight.
    """
    spark = train.sparkSession
    leaf, within, weights = leaves(counts)
    model = Model(7, Tree(weights))
    model.w["E"][int((counts > 0).sum()):] = 0  # no training text has these
    total = max(1, int(counts.sum()))
    passes = min(steps, max(1, math.ceil(steps * BATCH * WINDOW / total)))
    values = [f"v{j}" for j in range(ACROSS)]
    of_round = F.pmod(F.xxhash64("ids" if "ids" in train.columns else "text"), F.lit(ROUNDS))
    for k in range(ROUNDS):
        shared = spark.sparkContext.broadcast((ranks, model.w, leaf, leaf, model.tree))
        mean = (train.where(of_round == k)
                .mapInArrow(_trained(shared, k, passes, total), f"place int, {', '.join(f'{v} bigint' for v in values)}, n bigint")
                .groupBy("place").agg(*(F.sum(v).alias(v) for v in values), F.sum("n").alias("n"))
                .select("place", *((F.col(v) / F.col("n") * (total / PART)).alias(v) for v in values)).orderBy("place").toArrow())
        if mean.num_rows:
            flat, at = np.stack([mean[v].to_numpy() for v in values], 1).reshape(-1), 0
            for name in Model.NAMES:
                x = model.w[name]
                model.w[name] = flat[at:at + x.size].reshape(x.shape).astype(F32)
                at += x.size
        shared.destroy()
    return model, leaf, within


def score(docs: DataFrame, train_on: Column, *, doc_id: str = "doc_id", text: str = "text",
          ranks_path: str = subwords.RANKS, frequent_words: int = FREQUENT_WORDS, **fitting) -> DataFrame:
    """(``doc_id``, n_tokens, n_known, train_tokens, base_score, score): a row for each row of ``docs``.

    ``score`` is the model's log10 probability of the text (its subword ids and
    the end).  ``base_score`` is the add-one unigram score of its words and the
    end over the words of the rows where ``train_on`` holds (null: not): sum of
    log10((c + 1) / (N + V + 1)).  Words are lower-cased (A-Z), split at ASCII
    white space and compared by 64-bit hashes.  A null text is an empty one: just
    the end.  Repeated rows get equal scores; with no training rows all counts
    are 0 and the weights stay as initialised; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ready(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    ranks = subwords.load(ranks_path)
    learn = F.coalesce(train_on, F.lit(False))
    base = docs.select(F.col(doc_id).alias("id"), F.xxhash64(doc_id, text).alias("rh"), learn.alias("learn"),
                       F.col(text).alias("text"))
    words = written(docs.where(learn).select(F.col(text).alias("text")).mapInArrow(_count, "key bigint, n bigint")
                    .groupBy(F.col("key").alias("h")).agg(F.sum("n").alias("c")), "lm-counts")
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = words.orderBy(F.desc("c"), "h").limit(frequent_words).toArrow()
    frequent = top["h"].to_numpy().view(np.uint64)
    order = np.argsort(frequent)
    shared = spark.sparkContext.broadcast((ranks, frequent[order], top["c"].to_numpy()[order]))
    schema = StructType([*base.drop("text").schema.fields, *(
        StructField(f.name, f.dataType) for f in StructType.fromDDL(
            "n_tokens bigint, known bigint, logs double, rare array<bigint>, times array<int>, ids binary"))])
    coded = written(base.mapInArrow(_encode(shared), schema), "lm-ids")
    train = coded.where("learn").select("ids")
    sent = spark.sparkContext.broadcast(ranks)
    ids = (train.mapInArrow(_count_ids(sent), "key bigint, n bigint")
           .groupBy("key").agg(F.sum("n").alias("n")).toArrow())  # at most one row an id of the vocabulary
    per_id = np.zeros(max(ranks.values()) + 2, np.int64)
    per_id[ids["key"].to_numpy()] = ids["n"].to_numpy()
    model, leaf, within = fit(train, ranks, per_id, **fitting)
    shared = spark.sparkContext.broadcast((ranks, model, leaf, within))
    known = coded.select("id", "rh", "n_tokens", "known", "logs", "ids")
    scored = written(known.mapInArrow(_score(shared), StructType([
        *known.drop("ids").schema.fields, *StructType.fromDDL("score double").fields])), "lm-scored")
    rare = (coded.where(F.size("rare") > 0).select("rh", "rare", "times").dropDuplicates(["rh"])
            .select("rh", F.inline(F.arrays_zip("rare", "times")).alias("h", "times"))
            .join(words, "h").groupBy("rh")
            .agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more_logs")))
    end = words.where(F.col("h") == F.lit(END_HASH)).agg(F.coalesce(F.max("c"), F.lit(0))).first()[0]
    full = scored.join(rare, "rh", "left").na.fill(0, ["more"]).na.fill(0.0, ["more_logs"])
    known = F.col("known") + F.col("more") + (1 if end else 0)
    logs = (F.col("logs") + F.col("more_logs") + F.lit(math.log10(end + 1))
            - F.col("n_tokens") * F.lit(math.log10(total + distinct + 1)))
    return full.select(F.col("id").alias(doc_id), "n_tokens", known.cast("bigint").alias("n_known"),
                       F.lit(int(total)).cast("bigint").alias("train_tokens"), logs.alias("base_score"), "score")
