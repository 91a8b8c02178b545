"""Quality classifier: supervised subword embeddings.

Method.  A document is the average of hashed vectors of its words, word pairs, word shapes and
character n-grams; a softmax layer turns the average into class probabilities; vectors and layer
are trained by plain numpy stochastic gradient descent on a bounded sample of labelled rows
(labelled.SAMPLE_ROWS a class).  Both maps are linear, so for scoring each bucket's vector is
multiplied with the layer once, and a document costs one lookup a feature.

Cases: null and empty texts score the class prior; very long texts are scored whole; ties and
repeated rows score alike; without labels of both classes every score is the prior (0.5 without
labels); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE, BASE_INV, BYTE_A, SPACES, U64, Chunk, chunks_of, column, ints, mix, powers, prefix, read, word_hashes, words_of
from .labelled import Sample, held_out, sample

BITS = 17
DIM = 8
EPOCHS = 12
BATCH = 32
RATE = 0.5
GRAMS = (3, 5)
THRESHOLD = 0.7

_SHAPE = np.full(256, ord("o"), np.uint8)  # letters x/X, digits, the rest as it is
_SHAPE[0x21:0x7F] = np.arange(0x21, 0x7F)
_SHAPE[0x30:0x3A], _SHAPE[0x41:0x5B], _SHAPE[0x61:0x7B], _SHAPE[0x80:] = ord("0"), ord("X"), ord("x"), ord("x")


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    return (mix(h + U64(kind * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> U64(64 - BITS)).astype(np.int32)


def features(c: Chunk) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text number) of every feature, one kind after another: a few arrays of a chunk's size."""
    start, end, n = words_of(c, SPACES)
    doc = np.repeat(np.arange(c.n, dtype=np.int32), n)
    words = word_hashes(c, start, end)
    yield _bucket(words, 1), doc
    ends = c.data[end - 1] if len(end) else c.data[:0]
    shape = _SHAPE[c.data[start]].astype(np.int64) if len(start) else np.zeros(0, np.int64)
    second = _SHAPE[c.data[np.minimum(start + 1, end - 1)]] if len(start) else shape
    shape = (shape * 256 + second) * 256 + _SHAPE[ends]
    yield _bucket(shape.astype(U64) * U64(64) + np.minimum(end - start, 20).astype(U64), 2), doc
    if len(words) > 1:
        same = doc[1:] == doc[:-1]
        pair = np.where(words[1:] == words[:-1], U64(7), words[1:] * U64(3) + words[:-1])  # a repeated word is one feature, whatever the word
        yield _bucket(pair[same], 3), doc[1:][same]
        both = shape[1:].astype(U64) * U64(1 << 32) + shape[:-1].astype(U64)
        yield _bucket(both[same], 4), doc[1:][same]
    pre = prefix(BYTE_A[c.data], BASE)
    owner = np.repeat(np.arange(c.n, dtype=np.int32), c.lens + 1)[: len(c.data)]
    owner[(c.starts + c.lens)[:-1]] = -1  # the space after a text is not its own: what follows in the chunk must not matter
    for g in GRAMS:
        if len(c.data) >= g:
            at = len(c.data) - g + 1
            inside = (owner[:at] == owner[g - 1 :]) & (owner[:at] >= 0)
            h = (pre[g:] - pre[:at]) * powers(BASE_INV, at)
            yield _bucket(h[inside], 8 + g), owner[:at][inside]


def train(own: Sample, seed: int = 5) -> tuple[np.ndarray, float, float]:
    """Logit of each bucket, scale-free bias, and the prior logit.  Texts of both classes count alike while training; the prior is put back after."""
    prior = float(np.log(max(own.share, 1e-3) / max(1 - own.share, 1e-3))) if 0 < own.share < 1 or own.labels else 0.0
    y = np.array(own.labels, np.int64)
    if not len(y) or y.min() == y.max():
        return np.zeros(1 << BITS, np.float32), 0.0, prior
    cols: list = [None] * len(y)
    at = 0
    for c in chunks_of(pa.array(own.texts, pa.string()), 1 << 20):
        kinds = list(features(c))
        b, d = np.concatenate([x for x, _ in kinds]), np.concatenate([x for _, x in kinds])
        key, cnt = np.unique(d.astype(np.int64) << BITS | b, return_counts=True)
        who, what = key >> BITS, (key & ((1 << BITS) - 1)).astype(np.int32)
        cut = np.searchsorted(who, np.arange(c.n + 1))
        for i in range(c.n):
            part = slice(cut[i], cut[i + 1])
            cols[at + i] = (what[part], (cnt[part] / max(1, cnt[part].sum())).astype(np.float32))
        at += c.n
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    out = np.zeros((DIM, 2), np.float32)
    bias = np.zeros(2, np.float32)
    weight = (len(y) / (2 * np.bincount(y, minlength=2)))[y].astype(np.float32)
    steps, done = EPOCHS * (len(y) // BATCH + 1), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for k in range(0, len(y), BATCH):
            rows = order[k : k + BATCH]
            rate, done = RATE * (1 - done / steps), done + 1
            size = np.array([len(cols[i][0]) for i in rows])
            if not size.sum():
                continue
            what, share = np.concatenate([cols[i][0] for i in rows]), np.concatenate([cols[i][1] for i in rows])
            who, some = np.repeat(np.arange(len(rows)), size), np.flatnonzero(size)
            hidden = np.zeros((len(rows), DIM), np.float32)
            hidden[some] = np.add.reduceat(emb[what] * share[:, None], (np.cumsum(size) - size)[some])
            z = hidden @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p *= weight[rows, None]
            back = p @ out.T
            out -= rate * hidden.T @ p / len(rows) * 8
            bias -= rate * p.mean(0)
            near = np.argsort(what, kind="stable")  # one sum a bucket
            what, step = what[near], (np.float32(-rate * 8) * share)[near, None] * back[who[near]]
            first = np.flatnonzero(np.concatenate([[True], what[1:] != what[:-1]]))
            emb[what[first]] += np.add.reduceat(step, first)
    logit = emb @ (out[:, 1] - out[:, 0])
    return logit.astype(np.float32), float(bias[1] - bias[0]), prior


def score(docs: DataFrame, model: tuple[np.ndarray, float, float], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of every row.  The model is of fixed size (2**BITS floats)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logit, bias, prior = sent.value
        for b in batches:
            keys = column(b, "doc_id")
            for c in chunks_of(column(b, "text"), 1 << 20):
                total, n = np.zeros(c.n), np.zeros(c.n)
                for bucket, doc in features(c):
                    total += np.bincount(doc, logit[bucket], c.n)
                    n += np.bincount(doc, minlength=c.n)
                z = np.where(n > 0, total / np.maximum(n, 1) + bias + prior, prior)
                s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
                yield pa.RecordBatch.from_arrays([keys[c.rows], pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return score(docs, train(sample(docs, labels, "quality"))).select("doc_id", held_out().alias("held_out"), F.col("score"), "predicted")
