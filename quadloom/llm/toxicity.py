"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is its own embedding (hashed) beside the mean of the embeddings
of its character n-grams (3 to 5). Overlapping windows of ``WINDOW`` words, ``STRIDE`` apart and covering every word,
run through one GRU in each direction; attention weighs the states, a logistic unit scores
them, and a text's score is that of its worst window.

Labels are of whole texts. Training therefore picks from each text the window that counts: at
first the one with the highest log-odds of an n-gram, later the network's own worst window
(for clean texts too, which makes them hard negatives).
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.llm.common import column, documents, gather, map_batches, spans, spool, words
from quadloom.llm.langid import bucket

WINDOW, STRIDE = 32, 16
WORD_ROWS, CHAR_ROWS, WORD_DIM, CHAR_DIM, HIDDEN, ORDERS = 1 << 13, 1 << 16, 4, 12, 16, (3, 4, 5)
#: Bounds of the fit: labelled documents of each class (by a hash of doc_id), and bytes of texts in all.
TRAIN_DOCS, TRAIN_BYTES = 2400, 64 << 20
EPOCHS, OWN_FROM, BATCH, RATE, DECAY, THRESHOLD = 10, 5, 128, 0.01, 1e-4, 0.7
#: An n-gram's log-odds count from so many training texts on.
LEAST_TEXTS = 4
#: Part of the words whose own embedding is hidden in training, so that n-grams must do.
HIDE = 0.5
CACHE_WORDS = 200_000
_PLAIN = bytes(32 if b < 128 and not chr(b).isalnum() else b for b in range(256))


def tokens(text: bytes) -> list[bytes]:
    """Words of letters and digits; A-Z lower-cased."""
    return words(text.lower().translate(_PLAIN))


def word_inputs(vocabulary: list[bytes]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Embedding row of each word; for each order the rows of all character n-grams, and the words' offsets among them."""
    hashed = np.frombuffer(b"".join([xxhash.xxh32_digest(w) for w in vocabulary]), ">u4").astype(np.int64) % WORD_ROWS
    data = np.frombuffer(b"".join([b"\x01" + w + b"\x02" for w in vocabulary]), np.uint8)
    owner = np.repeat(np.arange(len(vocabulary)), np.fromiter((len(w) + 2 for w in vocabulary), np.int64, len(vocabulary)))
    found = []
    for order in ORDERS:
        n = max(len(data) - order + 1, 0)
        key = np.full(n, order, np.uint64)
        for i in range(order):
            key = key << np.uint64(8) | data[i : i + n]
        inside = owner[:n] == owner[len(owner) - n :]
        rows = ((key[inside] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % CHAR_ROWS
        found.append((rows, spans(np.bincount(owner[:n][inside], minlength=len(vocabulary)))))
    return hashed, found


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs, some of which may be empty."""
    padded = np.concatenate([values, np.zeros((1, *values.shape[1:]), values.dtype)])
    out = np.add.reduceat(padded, at[:-1], axis=0)
    out[np.diff(at) == 0] = 0
    return out


def windows(n: int) -> np.ndarray:
    """Starts of the windows over n words (at least one)."""
    return np.arange(0, max(n - WINDOW + STRIDE, 1), STRIDE) if n > WINDOW else np.zeros(1, np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters p; arrays lead with the direction (forwards, backwards)."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        deal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        self.p = {
            "word": deal(WORD_ROWS, WORD_DIM, scale=0.1), "char": deal(CHAR_ROWS, CHAR_DIM, scale=0.3), "w": deal(2, d, 3 * h, scale=0.3), "u": deal(2, h, 3 * h, scale=0.3),
            "b": np.zeros((2, 1, 3 * h), np.float32), "a": deal(2 * h, h, scale=0.3), "v": deal(h, scale=0.3), "o": deal(2 * h, scale=0.3), "c": np.zeros(1, np.float32),
        }

    def embed(self, vocabulary: list[bytes]) -> tuple[np.ndarray, tuple]:
        own, grams = word_inputs(vocabulary)
        n = np.maximum(sum(np.diff(at) for _, at in grams), 1)[:, None]
        sums = sum(_sums(self.p["char"][rows], at) for rows, at in grams)
        return np.concatenate([self.p["word"][own], sums / np.sqrt(n)], axis=1).astype(np.float32), (own, grams, np.sqrt(n))

    def project(self, x: np.ndarray) -> np.ndarray:
        """Input parts of the gates, (direction, word, 3 * HIDDEN)."""
        return x @ self.p["w"] + self.p["b"]

    def gates(self, vocabulary: list[bytes]) -> np.ndarray:
        """project(embed()) of many words, some at a time."""
        out = np.empty((2, len(vocabulary), 3 * HIDDEN), np.float32)
        for i in range(0, len(vocabulary), 1 << 14):
            out[:, i : i + (1 << 14)] = self.project(self.embed(vocabulary[i : i + (1 << 14)])[0])
        return out

    def states(self, gates: np.ndarray, index: np.ndarray, mask: np.ndarray | None, keep: bool = False):
        """States (time, direction, window, HIDDEN) over windows of word numbers; keep: also what training needs."""
        n, h, u = index.shape[1], HIDDEN, self.p["u"]
        state = np.zeros((2, len(index), h), np.float32)
        out, saved = np.empty((n, 2, len(index), h), np.float32), []
        for t in range(n):
            x = np.stack([gates[0][index[:, t]], gates[1][index[:, n - 1 - t]]])
            s = state @ u[:, :, : 2 * h]
            s += x[:, :, : 2 * h]
            s = _sigmoid(s)
            z, r = s[:, :, :h], s[:, :, h:]
            rh = r * state
            q = np.tanh(x[:, :, 2 * h :] + rh @ u[:, :, 2 * h :])
            new = state + z * (q - state)
            if mask is not None:
                m = np.stack([mask[:, t], mask[:, n - 1 - t]])[:, :, None]
                new = np.where(m, new, state)
            if keep:
                saved.append((state, z, r, q, rh))
            state = out[t] = new
        return out, saved

    def score(self, gates: np.ndarray, index: np.ndarray, mask: np.ndarray | None, keep: bool = False):
        """Probability of each window."""
        out, saved = self.states(gates, index, mask, keep)
        both = np.concatenate([out[:, 0], out[::-1, 1]], axis=2)
        e = np.tanh(both @ self.p["a"])
        logit = e @ self.p["v"]
        if mask is not None:
            logit = np.where(mask.T, logit, np.float32(-1e9))
        weight = np.exp(logit - logit.max(0))
        weight /= weight.sum(0)
        pooled = (weight[:, :, None] * both).sum(0)
        p = _sigmoid(pooled @ self.p["o"] + self.p["c"])
        return (p, (saved, both, e, weight, pooled)) if keep else p

    def gradients(self, x: np.ndarray, parts: tuple, index: np.ndarray, mask: np.ndarray, label: np.ndarray, share: np.ndarray) -> dict:
        """Of the cross-entropy, share being the weights of the windows."""
        p, h, n = self.p, HIDDEN, index.shape[1]
        gates = self.project(x)
        y, (saved, both, e, weight, pooled) = self.score(gates, index, mask, keep=True)
        g: dict[str, np.ndarray] = {}
        d = ((y - label) * share).astype(np.float32)
        g["o"], g["c"] = pooled.T @ d, np.array([d.sum()], np.float32)
        d_pooled = d[:, None] * p["o"]
        d_weight = (both * d_pooled).sum(2)
        d_logit = weight * (d_weight - (weight * d_weight).sum(0))
        g["v"] = np.einsum("tb,tbk->k", d_logit, e)
        d_e = d_logit[:, :, None] * p["v"] * (1 - e * e)
        g["a"] = np.einsum("tbi,tbk->ik", both, d_e)
        d_both = weight[:, :, None] * d_pooled + d_e @ p["a"].T
        d_out = np.stack([d_both[:, :, :h], d_both[::-1, :, h:]], axis=1)
        d_gates = np.zeros_like(gates)
        g["u"], carry = np.zeros_like(p["u"]), np.zeros((2, len(index), h), np.float32)
        u_zr, u_q = p["u"][:, :, : 2 * h].transpose(0, 2, 1), p["u"][:, :, 2 * h :].transpose(0, 2, 1)
        for t in range(n - 1, -1, -1):
            state, z, r, q, rh = saved[t]
            m = np.stack([mask[:, t], mask[:, n - 1 - t]])[:, :, None]
            total = d_out[t] + carry
            dn = np.where(m, total, 0)
            dq = dn * z * (1 - q * q)
            dz = dn * (q - state) * z * (1 - z)
            d_rh = dq @ u_q
            dr = d_rh * state * r * (1 - r)
            zr = np.concatenate([dz, dr], axis=2)
            g["u"][:, :, : 2 * h] += state.transpose(0, 2, 1) @ zr
            g["u"][:, :, 2 * h :] += rh.transpose(0, 2, 1) @ dq
            carry = np.where(m, dn * (1 - z) + d_rh * r + zr @ u_zr, total)
            step = np.concatenate([zr, dq], axis=2)
            np.add.at(d_gates[0], index[:, t], step[0])
            np.add.at(d_gates[1], index[:, n - 1 - t], step[1])
        g["b"] = d_gates.sum(1, keepdims=True)
        g["w"] = x.T @ d_gates
        dx = (d_gates @ p["w"].transpose(0, 2, 1)).sum(0)
        own, grams, count = parts
        g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        np.add.at(g["word"], own, dx[:, :WORD_DIM])
        for rows, at in grams:
            np.add.at(g["char"], rows, np.repeat((dx[:, WORD_DIM:] / count).astype(np.float32), np.diff(at), axis=0))
        return g


class _Texts:
    """Numbered words and all windows of some texts."""

    def __init__(self, texts: list[bytes]) -> None:
        split = [tokens(t) for t in texts]
        number: dict[bytes, int] = {}
        self.docs = [np.array([number.setdefault(w, len(number)) for w in ws], np.int32) for ws in split]
        self.vocabulary = list(number)
        starts = [windows(len(d)) if len(d) else np.empty(0, np.int64) for d in self.docs]
        self.owner = np.repeat(np.arange(len(texts)), list(map(len, starts)))
        self.index, self.mask = np.zeros((len(self.owner), WINDOW), np.int32), np.zeros((len(self.owner), WINDOW), bool)
        at = 0
        for d, some in zip(self.docs, starts, strict=True):
            for s in some.tolist():
                part = d[s : s + WINDOW]
                self.index[at, : len(part)], self.mask[at, : len(part)] = part, True
                at += 1

    def worst(self, score: np.ndarray) -> np.ndarray:
        """The window of each text with the highest score."""
        order = np.lexsort((-score, self.owner))
        return order[np.unique(self.owner[order], return_index=True)[1]]


def train(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> Network | None:
    """None unless both labels are there."""
    data = _Texts(texts)
    if not len(data.owner) or len(set(labels[np.unique(data.owner)].tolist())) < 2:
        return None
    net, rng = Network(seed), np.random.default_rng(seed)
    y = labels.astype(np.float32)
    # Log-odds of n-grams by the texts that hold them; a window is as good as its best n-gram.
    _, grams = word_inputs(data.vocabulary)
    held = np.zeros((2, CHAR_ROWS), np.float32)
    for d, label in zip(data.docs, labels, strict=True):
        if len(d):
            used = np.unique(d)
            held[int(label), np.unique(np.concatenate([gather(rows, at[used], np.diff(at)[used]) for rows, at in grams]))] += 1
    odds = np.log((held[1] + 0.5) / (y.sum() + 1)) - np.log((held[0] + 0.5) / (len(y) - y.sum() + 1))
    odds[held.sum(0) < LEAST_TEXTS] = 0
    word_odds = np.max([np.maximum.reduceat(np.append(odds[rows], 0), at[:-1]) * (np.diff(at) > 0) for rows, at in grams], axis=0)
    score = np.concatenate([np.where(data.mask[i : i + 4096], word_odds[data.index[i : i + 4096]], 0).sum(1) for i in range(0, len(data.owner), 4096)])
    del grams
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    for epoch in range(EPOCHS):
        if epoch >= OWN_FROM:
            gates = net.gates(data.vocabulary)
            score = np.concatenate([net.score(gates, data.index[i : i + 2048], data.mask[i : i + 2048]) for i in range(0, len(data.owner), 2048)])
            del gates
        chosen = data.worst(score)
        clean = np.flatnonzero(labels[data.owner] == 0)
        chosen = rng.permutation(np.concatenate([chosen, rng.choice(clean, min(len(chosen) // 2, len(clean)), replace=False)]))
        target = y[data.owner[chosen]]
        balance = np.where(target == 1, len(target) / max(2 * target.sum(), 1), len(target) / max(2 * (len(target) - target.sum()), 1)).astype(np.float32)
        for i in range(0, len(chosen), BATCH):
            some = chosen[i : i + BATCH]
            index, mask = data.index[some], data.mask[some]
            used, small = np.unique(index, return_inverse=True)
            x, parts = net.embed([data.vocabulary[k] for k in used])
            x[rng.random(len(x)) < HIDE, :WORD_DIM] = 0
            step += 1
            for k, g in net.gradients(x, parts, small.reshape(index.shape), mask, target[i : i + BATCH], balance[i : i + BATCH] / len(some)).items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                net.p[k] = net.p[k] * (1 - DECAY) - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
    return net


class Scorer:
    """Scores texts; keeps the gate inputs of words it has met, a bounded number of them."""

    def __init__(self, net: Network) -> None:
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.gates = np.empty((2, 0, 3 * HIDDEN), np.float32)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        split = [tokens(t) for t in texts]
        every = [w for ws in split for w in ws]
        out = np.zeros(len(texts))
        if not every:
            return out
        new = set(every).difference(self.number)
        if len(self.number) + len(new) > CACHE_WORDS:
            self.clear()
            new = set(every)
        if new:
            listed = list(new)
            self.gates = np.concatenate([self.gates, self.net.project(self.net.embed(listed)[0])], axis=1)
            self.number.update(zip(listed, range(len(self.number), len(self.number) + len(listed)), strict=True))
        numbers = np.fromiter(map(self.number.__getitem__, every), np.int64, len(every))
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        begin = spans(sizes)
        starts = [windows(int(n)) if n else np.empty(0, np.int64) for n in sizes]
        owner = np.repeat(np.arange(len(texts)), list(map(len, starts)))
        start = np.concatenate(starts)
        left = sizes[owner] - start
        for some, masked in ((np.flatnonzero(left >= WINDOW), False), (np.flatnonzero(left < WINDOW), True)):
            for i in range(0, len(some), 2048):
                part = some[i : i + 2048]
                at = (begin[owner[part]] + start[part])[:, None] + np.arange(WINDOW)
                mask = np.arange(WINDOW) < left[part][:, None] if masked else None
                index = numbers[np.minimum(at, len(numbers) - 1)]
                np.maximum.at(out, owner[part], self.net.score(self.gates, index, mask))
        return out


#: The worker's scorer, by the model it was made for.
_scorers: dict[str, Scorer] = {}


def score_texts(docs: DataFrame, net: Network | None) -> DataFrame:
    """One row per row: doc_id, score, predicted (score >= THRESHOLD).

    A null text, a text without words, and every text where nothing could be learned scores 0.
    Repeated rows and null doc_ids stay as they are; an empty table gives no rows.
    """
    model, name = docs.sparkSession.sparkContext.broadcast(net), uuid.uuid4().hex

    def per_batch(batch: pa.RecordBatch) -> dict:
        texts = column(batch, "text")
        if model.value is None:
            score = np.zeros(len(texts))
        else:
            if name not in _scorers:
                _scorers.clear()
                _scorers[name] = Scorer(model.value)
            score = _scorers[name].scores(texts)
        return {"doc_id": batch.column(0), "score": score, "predicted": (score >= THRESHOLD).astype(np.int32)}

    return map_batches(documents(docs), per_batch, "doc_id long, score double, predicted int")


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> Network | None:
    """Learn from the labelled rows whose crc32(doc_id) mod 3 is not 1, a bounded sample of each class.

    Of rows that share a doc_id the first by text teaches. Texts come in the order of the hash until
    ``train_bytes`` are full; those that don't fit, whole, teach nothing.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").filter(bucket(F.col("doc_id"), 3) != 1)
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None
    share = F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(1 << 30))
    most = {k: int((1 << 30) * min(1.0, train_docs / n)) for k, n in sizes.items()}
    known = known.filter(share < F.when(F.col("toxic") == 1, most[1]).otherwise(most[0])).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = documents(docs).filter("text is not null").join(F.broadcast(known), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # a bounded sample
    rows = spool(rows, "toxicity-sample")
    left_out, held = [], 0
    for doc, size in rows.orderBy(share, "doc_id").select("doc_id", F.octet_length("text")).collect():
        if held + size <= train_bytes:
            held += size
        else:
            left_out.append(doc)
    some = rows.filter(~F.col("doc_id").isin(left_out)).orderBy("doc_id").collect()
    return train([r["text"].encode() for r in some], np.array([r["toxic"] for r in some], np.int64)) if some else None


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_texts(docs, fit(docs, labels)).select("doc_id", F.coalesce(bucket(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")
