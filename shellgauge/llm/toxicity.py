"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A text is words (lower-cased; runs of ASCII letters, digits and non-ASCII bytes). A word's input is the
embedding of the word, if training met it in enough documents, beside the mean embedding of its hashed character n-grams
(UTF-8 bytes, with word edges). Overlapping windows of WINDOW words, STEP apart, cover the
whole text; the network reads each window in both directions, attention pools its states, and the
text's score is that of its highest window, calibrated. An empty text is one window of padding.

Training takes a sample of at most about POSITIVE and NEGATIVE labelled documents by hash. Labels are of whole
documents, so training alternates: score all windows, take each document's highest (of negatives two and
a random one), then fit the network to those by Adam with gradients through time. Embeddings start from the classes'
log odds of words and n-grams. A fifth of the sample scales the score to a probability.

Null texts count as empty. With no label, or one class only, the score is the share of that class. Rows are
kept one by one; only the kept columns pass.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, map_slices

WINDOW, STEP = 32, 24
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 6, 10, 8, 8
BUCKETS = 1 << 14
NGRAMS = (3, 4, 5)
POSITIVE, NEGATIVE = 1000, 1500
MIN_DOCS, MAX_WORDS = 4, 20_000
ROUNDS, PASSES, BATCH, RATE, DECAY = 4, 3, 128, 0.01, 1e-4
#: Windows that the network reads at once.
CHUNK = 2048

_FOLD = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_FOLD).split()


def numbered(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Word ids of all texts in a row, where each text begins, and the words by id."""
    names: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
    ids, starts = [], [0]
    for t in texts:
        ws = words(t)
        ids.append(np.fromiter(map(names.__getitem__, ws), np.int32, len(ws)))
        starts.append(starts[-1] + len(ws))
    return np.concatenate(ids) if ids else np.zeros(0, np.int32), np.array(starts), list(names)


def char_ngrams(vocab: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words in a row, and where each word's begin (one more at the end)."""
    data = np.frombuffer(b"".join([b"^" + w + b"$" for w in vocab]), np.uint8).astype(np.uint64)
    ends = np.cumsum(np.fromiter((len(w) + 2 for w in vocab), np.int64, len(vocab)))
    left = np.repeat(ends, np.diff(np.concatenate([[0], ends]))) - np.arange(len(data))  # bytes from here to the word's end
    word = np.repeat(np.arange(len(vocab)), np.diff(np.concatenate([[0], ends])))
    found, owner = [], []
    h = np.zeros(len(data), np.uint64)
    for n in range(1, max(NGRAMS) + 1):
        h = h[: len(data) - n + 1] * np.uint64(0x100000001B3) + data[n - 1 :] + np.uint64(1)
        if n in NGRAMS:
            at = np.flatnonzero(left[: len(h)] >= n)
            mixed = h[at] * np.uint64(0x9E3779B97F4A7C15)
            found.append((mixed >> np.uint64(40)).astype(np.int64) % BUCKETS)
            owner.append(word[at])
    buckets, owners = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owners, kind="stable")
    return buckets[order].astype(np.int32), np.searchsorted(owners[order], np.arange(len(vocab) + 1))


def windows(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, length and text of each window; at least one for each text."""
    size = np.diff(starts)
    number = np.maximum(1, -(-np.maximum(size - (WINDOW - STEP), 0) // STEP))
    text = np.repeat(np.arange(len(size)), number)
    k = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    first = starts[:-1][text] + k * STEP
    return first, np.minimum(WINDOW, starts[1:][text] - first), text


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    """Parameters by name; float32."""

    def __init__(self, vocab: dict[bytes, int], seed: int = 0):
        rng = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN

        def normal(*shape, scale):
            return (rng.normal(size=shape) * scale).astype(np.float32)

        self.vocab = vocab
        self.p: dict[str, np.ndarray] = {
            "word": normal(len(vocab) + 1, WORD_DIM, scale=0.05),
            "char": normal(BUCKETS, CHAR_DIM, scale=0.05),
            "att_w": normal(2 * h, ATTENTION, scale=0.3),
            "att_b": np.zeros(ATTENTION, np.float32),
            "att_v": normal(ATTENTION, scale=0.5),
            "out_w": normal(2 * h, scale=0.5),
            "out_b": np.zeros(1, np.float32),
        }
        for way in ("f", "b"):
            self.p |= {f"{way}_x": normal(d, 3 * h, scale=d**-0.5), f"{way}_h": normal(h, 3 * h, scale=h**-0.5), f"{way}_b": np.zeros(3 * h, np.float32)}
        self.platt = (1.0, 0.0)

    def inputs(self, vocab: list[bytes]) -> tuple[np.ndarray, tuple]:
        """Input vector of each word; one row of zeros more, for padding."""
        out = np.zeros((len(vocab) + 1, WORD_DIM + CHAR_DIM), np.float32)
        if not vocab:
            return out, (np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(1, np.int64))
        known = np.fromiter((self.vocab.get(w, 0) for w in vocab), np.int32, len(vocab))
        buckets, at = char_ngrams(vocab)
        out[:-1, :WORD_DIM] = self.p["word"][known]
        sums = np.zeros((len(vocab), CHAR_DIM), np.float32)
        some = np.flatnonzero(np.diff(at))
        if len(some):
            sums[some] = np.add.reduceat(self.p["char"][buckets], at[:-1][some], axis=0)
        out[:-1, WORD_DIM:] = sums / np.sqrt(np.maximum(np.diff(at), 1))[:, None]
        return out, (known, buckets, at)

    def states(self, x: np.ndarray, ids: np.ndarray, way: str, keep: bool = False):
        """States of one direction: windows x WINDOW x HIDDEN. Padding (last id) keeps the state."""
        h_n, pad = HIDDEN, len(x) - 1
        wx = x @ self.p[f"{way}_x"] + self.p[f"{way}_b"]
        u = self.p[f"{way}_h"]
        h = np.zeros((len(ids), h_n), np.float32)
        out = np.empty((WINDOW, len(ids), h_n), np.float32)
        cache = []
        for t in range(WINDOW) if way == "f" else range(WINDOW - 1, -1, -1):
            col = ids[:, t]
            a, g = wx[col], h @ u
            gates = sigmoid(a[:, : 2 * h_n] + g[:, : 2 * h_n])
            z, r = gates[:, :h_n], gates[:, h_n:]
            n = np.tanh(a[:, 2 * h_n :] + r * g[:, 2 * h_n :])
            new = n + z * (h - n)
            dead = col == pad
            if dead.any():
                new[dead] = h[dead]
            if keep:
                cache.append((t, h, z, r, n, g[:, 2 * h_n :], dead))
            h = out[t] = new
        return out, cache

    def forward(self, x: np.ndarray, ids: np.ndarray, keep: bool = False):
        f, cf = self.states(x, ids, "f", keep)
        b, cb = self.states(x, ids, "b", keep)
        s = np.concatenate([f, b], axis=2)
        t = np.tanh(s @ self.p["att_w"] + self.p["att_b"])
        e = t @ self.p["att_v"]
        e[ids.T == len(x) - 1] = -30  # padding; a window of padding only attends to it evenly
        e = np.exp(e - e.max(axis=0))
        att = e / e.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", att, s)
        logit = pooled @ self.p["out_w"] + self.p["out_b"][0]
        return (logit, (s, t, att, pooled, cf, cb)) if keep else logit

    def gradients(self, vocab: list[bytes], ids: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Of the weighted logistic loss of some windows."""
        p, h_n = self.p, HIDDEN
        x, (known, buckets, at) = self.inputs(vocab)
        logit, (s, t, att, pooled, cf, cb) = self.forward(x, ids, keep=True)
        prob = sigmoid(logit)
        loss = float(-(weight * np.where(y > 0, np.log(prob + 1e-7), np.log(1 - prob + 1e-7))).sum())
        d_logit = weight * (prob - y)
        g = {"out_w": pooled.T @ d_logit, "out_b": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * p["out_w"]
        d_s = att[:, :, None] * d_pooled[None]
        d_att = np.einsum("bh,tbh->tb", d_pooled, s)
        d_e = att * (d_att - (att * d_att).sum(axis=0))
        g["att_v"] = np.einsum("tb,tba->a", d_e, t)
        d_t = d_e[:, :, None] * p["att_v"] * (1 - t * t)
        g["att_w"] = np.einsum("tbh,tba->ha", s, d_t)
        g["att_b"] = d_t.sum(axis=(0, 1))
        d_s += d_t @ p["att_w"].T
        d_x = np.zeros_like(x)
        for way, cache, part in (("f", cf, d_s[:, :, :h_n]), ("b", cb, d_s[:, :, h_n:])):
            u, d_h = p[f"{way}_h"], np.zeros((len(ids), h_n), np.float32)
            d_u, d_wx = np.zeros_like(u), np.zeros((len(x), 3 * h_n), np.float32)
            for step, h, z, r, n, gn, dead in reversed(cache):
                d_h = d_h + part[step]
                live = ~dead[:, None]
                d_z, d_n = d_h * (h - n) * z * (1 - z) * live, d_h * (1 - z) * (1 - n * n) * live
                d_r = d_n * gn * r * (1 - r)
                d_a = np.concatenate([d_z, d_r, d_n], axis=1)
                d_g = np.concatenate([d_z, d_r, d_n * r], axis=1)
                np.add.at(d_wx, ids[:, step], d_a)
                d_u += h.T @ d_g
                d_h = np.where(live, d_h * z, d_h) + d_g @ u.T
            d_wx[-1] = 0
            g[f"{way}_h"], g[f"{way}_x"], g[f"{way}_b"] = d_u, x.T @ d_wx, d_wx.sum(axis=0)
            d_x += d_wx @ p[f"{way}_x"].T
        g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        np.add.at(g["word"], known, d_x[:-1, :WORD_DIM])
        each = np.diff(at)
        np.add.at(g["char"], buckets, np.repeat(d_x[:-1, WORD_DIM:] / np.sqrt(np.maximum(each, 1))[:, None], each, axis=0))
        return g, loss

    def window_logits(self, ids: np.ndarray, starts: np.ndarray, vocab: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Logit and text of each window of some texts."""
        x, _ = self.inputs(vocab)
        first, size, text = windows(starts)
        out = np.empty(len(first), np.float32)
        for i in range(0, len(first), CHUNK):
            out[i : i + CHUNK] = self.forward(x, window_ids(ids, first[i : i + CHUNK], size[i : i + CHUNK], len(vocab)))
        return out, text

    def scores(self, texts: list[str | None]) -> np.ndarray:
        ids, starts, vocab = numbered(texts)
        logit, text = self.window_logits(ids, starts, vocab)
        top = np.maximum.reduceat(logit, np.searchsorted(text, np.arange(len(texts)))).astype(float)
        a, b = self.platt
        return 1 / (1 + np.exp(-np.clip(a * top + b, -30, 30)))


def window_ids(ids: np.ndarray, first: np.ndarray, size: np.ndarray, pad: int) -> np.ndarray:
    at = first[:, None] + np.arange(WINDOW)
    live = np.arange(WINDOW) < size[:, None]
    return np.where(live, np.append(ids, pad)[np.minimum(at, len(ids))], pad).astype(np.int32)


class Constant:
    def __init__(self, score: float):
        self.score = score

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return np.full(len(texts), self.score)


def train(texts: list[str], y: np.ndarray, seed: int = 0) -> Network:
    """Fits a network to labelled texts."""
    from .pii import platt

    rng = np.random.default_rng(seed)
    empty = max(1, len(texts) // 50)  # texts without words are not toxic
    texts, y = [*texts, *[""] * empty], np.concatenate([y, np.zeros(empty)])
    check = np.arange(len(texts)) % 5 == 4
    ids, starts, words_ = numbered(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    # words by the number of training texts they are in
    pairs = np.unique(owner[~check[owner]] * np.int64(len(words_)) + ids[~check[owner]])
    text_of, word_of = pairs // max(1, len(words_)), pairs % max(1, len(words_))
    df = np.bincount(word_of, minlength=len(words_))
    df1 = np.bincount(word_of, y[text_of], len(words_))
    common = np.flatnonzero(df >= MIN_DOCS)
    common = common[np.lexsort((common, -df[common]))][:MAX_WORDS]
    net = Network({words_[w]: i + 1 for i, w in enumerate(common)}, seed)
    n1, n0 = y[~check].sum(), (1 - y[~check]).sum()

    def odds(d1, d):
        return np.clip(np.log((d1 + 0.5) / (n1 + 1)) - np.log((d - d1 + 0.5) / (n0 + 1)), -4, 4)

    net.p["word"][1:, 0] = np.where(df[common] >= 8, 0.5 * odds(df1[common], df[common]), 0)
    buckets, at = char_ngrams(words_)
    gram_word = np.repeat(np.arange(len(words_)), np.diff(at))
    # texts with an n-gram, counted once for each of its words and text
    gram_df = np.bincount(buckets, df[gram_word], BUCKETS)
    gram_df1 = np.bincount(buckets, df1[gram_word], BUCKETS)
    w1, w0 = max(1.0, df1.sum()), max(1.0, (df - df1).sum())
    net.p["char"][:, 0] = 0.5 * np.clip(np.log((gram_df1 + 2) / w1) - np.log((gram_df - gram_df1 + 2 * w0 / w1) / w0), -4, 4)
    first, size, text = windows(starts)
    prior, _ = net.inputs(words_)
    logit = np.array([prior[window_ids(ids, first[i : i + CHUNK], size[i : i + CHUNK], len(words_))][:, :, [0, WORD_DIM]].max(axis=1).sum(axis=1) for i in range(0, len(first), CHUNK)], object)
    logit = np.concatenate(list(logit)).astype(np.float32)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    steps = 0
    for _ in range(ROUNDS):
        chosen, label = [], []
        order = np.lexsort((-logit, text))
        begin = np.searchsorted(text[order], np.arange(len(texts) + 1))
        for d in np.flatnonzero(~check):
            own = order[begin[d] : begin[d + 1]]
            take = own[:1] if y[d] else np.unique(np.concatenate([own[:2], rng.choice(own, 1)]))
            chosen += take.tolist()
            label += [y[d]] * len(take)
        chosen, label = np.array(chosen), np.array(label, np.float32)
        weight = np.where(label > 0, 0.5 / max(1, (label > 0).sum()), 0.5 / max(1, (label == 0).sum())).astype(np.float32) * len(label)
        for _ in range(PASSES):
            for batch in np.array_split(rng.permutation(len(chosen)), -(-len(chosen) // BATCH)):
                w = window_ids(ids, first[chosen[batch]], size[chosen[batch]], len(words_))
                used, w = np.unique(w, return_inverse=True)
                w = w.reshape(len(batch), WINDOW)
                if used[-1] == len(words_):
                    used = used[:-1]
                g, _ = net.gradients([words_[u] for u in used], w.astype(np.int32), label[batch], weight[batch] / len(batch))
                steps += 1
                for k, grad in g.items():
                    grad = grad + DECAY * net.p[k]
                    m, v = moment[k]
                    m += 0.1 * (grad - m)
                    v += 0.01 * (grad * grad - v)
                    net.p[k] -= (RATE * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.99**steps)) + 1e-8)).astype(np.float32)
        logit, _ = net.window_logits(ids, starts, words_)
    top = np.maximum.reduceat(logit, np.searchsorted(text, np.arange(len(texts)))).astype(float)
    use = check if min(y[check].sum(), (1 - y[check]).sum()) >= 5 else np.ones(len(texts), bool)
    target = np.where(y[use] > 0, (y[use].sum() + 1) / (y[use].sum() + 2), 1 / ((1 - y[use]).sum() + 2))
    net.platt = platt(top[use], target, np.ones(use.sum()))
    return net


def learn(docs: DataFrame, labels: DataFrame, allowed: Column, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Network | Constant:
    """Trains on labelled documents whose key passes ``allowed`` (an expression over ``key``).

    The sampled keys are broadcast: they are bounded by POSITIVE and NEGATIVE.
    """
    known = labels.where(allowed & F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(F.when(F.col(label) > 0, 1).otherwise(0)).alias("y_"))
    sizes = {r["y_"]: r["n"] for r in known.groupBy("y_").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Constant(float(next(iter(sizes), 0)))
    rate = F.when(F.col("y_") == 1, min(1.0, POSITIVE / sizes[1])).otherwise(min(1.0, NEGATIVE / sizes[0]))
    picked = known.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1_000_000)) < rate * 1e6)
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("t_")).join(F.broadcast(picked), key).select(F.xxhash64(F.col(key).cast("string"), F.lit(7)).alias("o_"), "t_", "y_").collect()
    rows.sort(key=lambda r: (r["o_"], r["t_"]))
    y = np.array([r["y_"] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return Constant(float(y[0]) if len(y) else 0.0)
    return train([r["t_"] for r in rows], y)


def score(df: DataFrame, net: Network | Constant, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """The kept columns, score and predicted."""
    shared = df.sparkSession.sparkContext.broadcast(net)

    def make():
        def fn(part):
            s = shared.value.scores(part.column(part.schema.get_field_index(text)).to_pylist())
            return {"score": pa.array(s, pa.float64()), "predicted": pa.array((s >= 0.5).astype(np.int32), pa.int32())}

        return fn

    return map_slices(df.select(*dict.fromkeys([*keep, text])), make, "score double, predicted int", keep, text)


def op3_bigru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = crc_mod("doc_id", 5) == 0
    return score(docs, learn(docs, labels, ~held)).select("doc_id", held.alias("held_out"), "score", "predicted")


QUERIES = {"op3_bigru": op3_bigru}
SQL: dict[str, str] = {}
