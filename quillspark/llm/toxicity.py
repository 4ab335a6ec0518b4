"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs.

A text is cut into overlapping windows of words, all of it. A word's inputs are a vector of its
own, if it is in the vocabulary, and the mean of the vectors of its hashed character 3-grams;
the letters alone count, in lower case. Two gated recurrent layers read a window forwards and
backwards, attention pools their states, and a logistic unit scores the window. A text's score
is that of its highest window. The network is trained in numpy at the driver, on a bounded
sample of labelled texts, each by the window that scores highest at that time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import bound_batches
from quillspark.llm.words import Chunk, buffers, chunks, mix, places, randoms

WINDOW_WORDS = 24
STRIDE_WORDS = 16
#: Labelled texts at most for each class, taken by a hash of doc_id, and the longest that training reads.
TRAINING_ROWS = 2000
TRAINING_CHARS = 20_000
VOCABULARY = 4096
CHAR_BUCKETS = 4096
#: Texts of either class a word must be in to get a vector of its own.
LEAST_TEXTS = 3
WORD_SIZE, CHAR_SIZE, STATE = 6, 4, 8
#: Passes over the sample at least; more over a small one, until so many steps are made.
EPOCHS, MOST_EPOCHS, LEAST_STEPS = 6, 24, 240
BATCH = 128
FOLDS = 5
#: Windows read side by side.
SIDE_BY_SIDE = 4096

_U = np.uint64
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = randoms(256, 21)


@dataclass
class Words:
    """Distinct words of a chunk: their hashes, character 3-grams with the word of each, and each word's index."""

    kinds: np.ndarray
    index: np.ndarray
    grams: np.ndarray
    owner: np.ndarray


def read_words(c: Chunk) -> Words:
    """Words by their letters alone; a word without letters has hash 0 and no 3-grams."""
    if not len(c.starts):
        return Words(np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    head = c.starts[0]
    data, starts = c.data[head:], c.starts - head
    letter = _LETTER[data]
    before = np.append(0, np.cumsum(letter))
    place = before[:-1] - np.repeat(before[starts], np.diff(np.append(starts, len(data))))
    value = np.where(letter, _VALUE[_LOWER[data]], _U(0))
    value *= places(int(place.max()) + 1)[place]
    hashes = np.add.reduceat(value, starts)
    kinds, first, index = np.unique(hashes, return_index=True, return_inverse=True)
    # the letters of the distinct words, framed by zeros
    letters = _LOWER[data[letter]]
    size = (before[np.append(starts[1:], len(data))] - before[starts])[first]
    begin = before[starts][first]
    framed = np.where(size > 0, size + 2, 0)
    ends = np.cumsum(framed)
    owner = np.repeat(np.arange(len(kinds)), framed)
    inner = np.arange(int(framed.sum())) - np.repeat(ends - framed, framed)
    inside = (inner > 0) & (inner <= size[owner])
    chars = np.zeros(len(owner), np.uint32)
    chars[inside] = letters[(begin[owner] + inner - 1)[inside]]
    if len(chars) < 3:
        return Words(kinds, index, np.zeros(0, np.int64), np.zeros(0, np.int64))
    grams = ((chars[:-2] << np.uint32(16) | chars[1:-1] << np.uint32(8) | chars[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - (CHAR_BUCKETS.bit_length() - 1))
    whole = owner[:-2] == owner[2:]
    return Words(kinds, index, grams[whole].astype(np.int64), owner[:-2][whole])


@dataclass
class Network:
    """The vocabulary as sorted hashes, and the weights by name."""

    vocabulary: np.ndarray
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def inputs(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Each distinct word's row in the vocabulary, the last if it isn't in it, and its input."""
        at = np.searchsorted(self.vocabulary, w.kinds)
        at[at == len(self.vocabulary)] = 0
        row = np.where(self.vocabulary[at] == w.kinds, at, len(self.vocabulary)) if len(self.vocabulary) else np.zeros(len(w.kinds), np.int64)
        n = np.bincount(w.owner, minlength=len(w.kinds))
        chars = np.column_stack([np.bincount(w.owner, self.weights["C"][w.grams, j], len(w.kinds)) for j in range(CHAR_SIZE)]) / np.maximum(1, n)[:, None]
        return row, np.hstack([self.weights["E"][row], chars]).astype(np.float32)

    def logits(self, x: np.ndarray, index: np.ndarray) -> np.ndarray:
        """Of windows given as rows of places in x, by time; x has a last row for padding, which is skipped."""
        out = np.zeros(len(index), np.float32)
        gates = [np.ascontiguousarray(x @ self.weights[f"W{d}"] + self.weights[f"b{d}"]) for d in "fb"]
        for lo in range(0, len(index), SIDE_BY_SIDE):
            out[lo : lo + SIDE_BY_SIDE] = self._forward(gates, index[lo : lo + SIDE_BY_SIDE].T, len(x) - 1)[0]
        return out

    def _forward(self, gates: list[np.ndarray], index: np.ndarray, padding: int) -> tuple:
        p, (t, n) = self.weights, index.shape
        states = np.zeros((t, n, 2 * STATE), np.float32)
        kept = []
        real = index != padding
        whole = bool(real.all())
        for d, (name, g) in enumerate(zip("fb", gates, strict=True)):
            h = np.zeros((n, STATE), np.float32)
            cols = slice(d * STATE, (d + 1) * STATE)
            steps = []
            for k in range(t) if name == "f" else range(t - 1, -1, -1):
                a = g[index[k]]
                zr = _sigmoid(a[:, : 2 * STATE] + h @ p[f"U{name}"])
                z, r = zr[:, :STATE], zr[:, STATE:]
                rh = r * h
                c = np.tanh(a[:, 2 * STATE :] + rh @ p[f"V{name}"])
                new = h + z * (c - h)
                if not whole:
                    new = np.where(real[k][:, None], new, h)
                steps.append((k, h, z, r, c))
                h = new
                states[k, :, cols] = h
            kept.append(steps)
        u = np.tanh(states @ p["A"])
        e = np.where(real, u @ p["a"], np.float32(-30))
        e = np.exp(e - e.max(0))
        alpha = e / e.sum(0)
        pooled = (alpha[:, :, None] * states).sum(0) * real.any(0)[:, None]
        return pooled @ p["o"] + p["c"][0], kept, states, u, alpha, pooled, real

    def gradients(self, x: np.ndarray, index: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the weighted log loss, by the weights and by the inputs x."""
        p, padding, index = self.weights, len(x) - 1, index.T
        gates = [x @ p[f"W{d}"] + p[f"b{d}"] for d in "fb"]
        logit, kept, states, u, alpha, pooled, real = self._forward(gates, index, padding)
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        d_logit = ((_sigmoid(logit) - label) * weight / len(label)).astype(np.float32)
        grad["o"], grad["c"] = pooled.T @ d_logit, np.array([d_logit.sum()], np.float32)
        d_pooled = d_logit[:, None] * p["o"]
        d_states = alpha[:, :, None] * d_pooled
        d_alpha = (states * d_pooled).sum(2)
        d_e = alpha * (d_alpha - (alpha * d_alpha).sum(0)) * real
        grad["a"] = (u * d_e[:, :, None]).sum((0, 1))
        d_u = d_e[:, :, None] * p["a"] * (1 - u * u)
        grad["A"] = np.tensordot(states, d_u, ([0, 1], [0, 1]))
        d_states = d_states + d_u @ p["A"].T
        d_x = np.zeros_like(x)
        for d, name in enumerate("fb"):
            d_h = np.zeros((index.shape[1], STATE), np.float32)
            d_gate = np.zeros((len(x), 3 * STATE), np.float32)
            for k, h, z, r, c in reversed(kept[d]):
                d_new = d_h + d_states[k, :, d * STATE : (d + 1) * STATE]
                m = real[k][:, None]
                live = d_new * m
                d_c = live * z * (1 - c * c)
                d_z = live * (c - h) * z * (1 - z)
                d_rh = d_c @ p[f"V{name}"].T
                d_r = d_rh * h * r * (1 - r)
                d_zr = np.hstack([d_z, d_r])
                grad[f"U{name}"] += h.T @ d_zr
                grad[f"V{name}"] += (r * h).T @ d_c
                d_h = d_new * ~m + live * (1 - z) + d_rh * r + d_zr @ p[f"U{name}"].T
                np.add.at(d_gate, index[k], np.hstack([d_zr, d_c]))
            grad[f"W{name}"], grad[f"b{name}"] = x.T @ d_gate, d_gate[:padding].sum(0)
            d_x += d_gate @ p[f"W{name}"].T
        return grad, d_x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def window_index(bounds: np.ndarray, index: np.ndarray, padding: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows of texts as rows of word indices, and the text of each; together they cover every word.

    A text's last window ends with it; a text shorter than a window is padded; one without words has none.
    """
    sizes = np.diff(bounds)
    n = np.where(sizes > 0, np.maximum(1, -(-(sizes - WINDOW_WORDS) // STRIDE_WORDS) + 1), 0)
    text = np.repeat(np.arange(len(sizes)), n)
    number = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    start = np.minimum(number * STRIDE_WORDS, np.maximum(0, sizes[text] - WINDOW_WORDS))
    place = start[:, None] + np.arange(WINDOW_WORDS)
    inside = place < sizes[text][:, None]
    at = np.minimum(bounds[:-1][text][:, None] + place, max(0, len(index) - 1))
    return np.where(inside, index[at] if len(index) else padding, padding), text


def text_scores(net: Network, c: Chunk) -> np.ndarray:
    w = read_words(c)
    scores = np.zeros(c.rows)
    if len(w.kinds):
        _, x = net.inputs(w)
        x = np.vstack([x, np.zeros((1, x.shape[1]), np.float32)])
        windows, text = window_index(c.bounds, w.index, len(x) - 1)
        best = np.full(c.rows, -np.inf)
        np.maximum.at(best, text, net.logits(x, windows).astype(float))
        scores = 1 / (1 + np.exp(-np.maximum(best, -700)))
        scores[np.isinf(best)] = 0
    return scores


def train(texts: list[str], toxic: list[int], seed: int = 5) -> Network:
    """A network from labelled texts. The same texts in the same order give the same network."""
    rng = np.random.default_rng(seed)
    label = np.array(toxic, np.float32)
    data, _ = buffers(pa.array(texts, pa.string()))
    c = next(iter(chunks(pa.array(texts, pa.string()), limit=max(1, len(data) + 1))), None)
    size = WORD_SIZE + CHAR_SIZE
    shapes = {"A": (2 * STATE, STATE), "a": (STATE,), "o": (2 * STATE,), **{f"{k}{d}": s for d in "fb" for k, s in (("W", (size, 3 * STATE)), ("U", (STATE, 2 * STATE)), ("V", (STATE, STATE)))}}
    weights = {k: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32) for k, s in shapes.items()}
    weights |= {"bf": np.zeros(3 * STATE, np.float32), "bb": np.zeros(3 * STATE, np.float32), "c": np.full(1, -2, np.float32), "C": (rng.standard_normal((CHAR_BUCKETS, CHAR_SIZE)) * 0.1).astype(np.float32)}
    if c is None or not len(c.starts) or not 0 < label.sum() < len(label):
        return Network(np.zeros(0, _U), weights | {"E": np.zeros((1, WORD_SIZE), np.float32), "c": np.full(1, 4.0 if len(label) and label.all() else -4.0, np.float32)})
    w = read_words(c)
    text = np.repeat(np.arange(len(texts)), np.diff(c.bounds))
    pair = np.unique(w.index.astype(np.int64) * len(texts) + text)
    kind, owner = pair // len(texts), (pair % len(texts))
    positive = np.bincount(kind, label[owner], len(w.kinds))
    negative = np.bincount(kind, 1 - label[owner], len(w.kinds))
    odds = np.log((positive + 0.5) / (label.sum() + 1)) - np.log((negative + 0.5) / (len(label) - label.sum() + 1))
    often = np.flatnonzero((positive + negative >= LEAST_TEXTS) & (w.kinds != 0))
    often = np.sort(often[np.argsort(-np.abs(odds[often]) * np.sqrt((positive + negative)[often]), kind="stable")[:VOCABULARY]])
    vectors = (rng.standard_normal((len(often) + 1, WORD_SIZE)) * 0.1).astype(np.float32)
    vectors[:-1, 0] = odds[often] / 2
    vectors[-1] = 0
    net = Network(w.kinds[often], weights | {"E": vectors})
    strength = np.zeros(len(w.kinds))
    strength[often] = odds[often]
    windows, window_text = window_index(c.bounds, w.index, len(w.kinds))
    rank = np.append(strength, -9)[windows].max(1)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.weights.items()}
    gram_n, step = np.bincount(w.owner, minlength=len(w.kinds)), 0
    weight = np.ones(len(label), np.float32)
    for _ in range(min(MOST_EPOCHS, max(EPOCHS, -(-LEAST_STEPS * BATCH // (2 * len(texts)))))):
        order = np.lexsort((rank, window_text))
        last = np.append(np.flatnonzero(np.diff(window_text[order])), len(order) - 1)
        chosen = order[last]  # the highest window of each text with words
        extra = rng.integers(0, len(windows), len(chosen))
        extra = extra[label[window_text[extra]] == 0]
        chosen = rng.permutation(np.concatenate([chosen, extra]))
        for lo in range(0, len(chosen), BATCH):
            batch = chosen[lo : lo + BATCH]
            used, local = np.unique(windows[batch], return_inverse=True)
            used = used[used < len(w.kinds)]
            local = np.where(windows[batch] == len(w.kinds), len(used), local.reshape(len(batch), -1))
            mine = np.isin(w.owner, used)
            part = Words(w.kinds[used], np.zeros(0, np.int64), w.grams[mine], np.searchsorted(used, w.owner[mine]))
            row, x = net.inputs(part)
            x = np.vstack([x, np.zeros((1, size), np.float32)])
            own = window_text[batch]
            grad, d_x = net.gradients(x, local, label[own], weight[own])
            grad["E"] = np.zeros_like(net.weights["E"])
            np.add.at(grad["E"], row, d_x[:-1, :WORD_SIZE])
            grad["E"][-1] = 0
            grad["C"] = np.zeros_like(net.weights["C"])
            np.add.at(grad["C"], part.grams, (d_x[:-1, WORD_SIZE:] / np.maximum(1, gram_n[used])[:, None])[part.owner])
            step += 1
            for k, g in grad.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                net.weights[k] -= (0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        _, x = net.inputs(w)
        rank = net.logits(np.vstack([x, np.zeros((1, size), np.float32)]), windows)
    return net


def _score(batches: Iterator[pa.RecordBatch], net) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in chunks(batch.column("text")):
            score = text_scores(net.value, c)
            rest = batch.slice(c.first, c.rows).drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*rest.schema.names, "score", "predicted"])


def fold() -> F.Column:
    """A document's fold, 0 to 4, by the CRC-32 of its id as text; 0 is held out. A null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def sample(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, chars: int = TRAINING_CHARS) -> tuple[list[str], list[int]]:
    """Labelled texts outside the held-out fold: at most rows of each class, distinct, none longer than chars."""
    ids = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(fold() != 0)
    ids = ids.withColumn("by", F.xxhash64("doc_id"))
    chosen = None
    for toxic in (0, 1):
        some = ids.where(F.col("toxic") == toxic).orderBy("by", "doc_id").limit(rows)
        chosen = some if chosen is None else chosen.unionByName(some)
    # 2 * rows ids at most, so they go to every task whatever the size of the tables
    found = docs.select("doc_id", "text").where(F.length("text") <= chars).join(F.broadcast(chosen), "doc_id").select("by", "doc_id", "text", "toxic").toPandas()
    found = found.sort_values(["by", "doc_id", "text"]).drop_duplicates("text")
    return found["text"].tolist(), found["toxic"].astype(int).tolist()


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, score and predicted of every document; every word of its text is in a window.

    docs has doc_id and text; other columns are ignored. A null or blank text scores 0. Repeated
    rows each keep theirs; an empty table gives no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    sent = spark.sparkContext.broadcast(net)
    return docs.select("doc_id", "text").mapInArrow(lambda it: _score(it, sent), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def op7(docs: DataFrame, labels: DataFrame) -> DataFrame:
    net = train(*sample(docs, labels))
    return score(docs, net).select("doc_id", (fold() == 0).alias("held_out"), "score", "predicted")
