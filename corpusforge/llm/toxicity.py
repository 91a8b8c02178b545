"""Toxicity by weak supervision.

Method.  Dozens of voters look at a document: every entry of a lexicon of insults, every stem mined
from the labelled training rows, and patterns (several entries, entries and shouting, entries in
a short text, density, none in many words); each votes toxic, clean or abstains.  A generative
label model is fitted by expectation maximisation on the votes of labelled and unlabelled rows: it
estimates each voter's rates under both classes, a row's label being one more voter whose own
accuracy is estimated with the others', and voters whose votes stay correlated given the class
share one voice.  Its posterior labels, of all these rows, train a logistic regression on words
and word stems, which scores every whole text.

Cases: null and empty texts have no features and score the bias; very long texts are scored
whole; repeated rows and ties score alike; without labels only lexicon and patterns vote; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE, BASE_INV, BYTE_A, LOWER, NOT_ALNUM, STAGE_BYTES, U64, Chunk, chunks_of, column, mix, prefix, read, spans_hash, words_of
from .labelled import Sample, held_out, sample, unlabelled

THRESHOLD = 0.3
PREFIXES = (4, 5, 6, 7)
MINED = 1024  # stems kept, by weight of evidence
KEPT = 4096  # features of the classifier
SURPRISE = 3.5  # standard errors by which a feature must stand out
GOLD = 5.0  # greatest log odds of a label as a voter; its accuracy is estimated
SPARSE = 250  # an entry votes if it is at least one word in so many
#: Insults that start the lexicon (English, German, French, Spanish).
LEXICON = (
    "idiot moron stupid loser trash scum clown pathetic worthless disgusting dumb imbecile bastard asshole bitch "
    "trottel dummkopf abschaum arschloch idioten connard crétin imbécile ordure salaud basura escoria imbécil estúpido idiota"
).split()


def features(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature hash, text number) of every word and of its stems of PREFIXES bytes; the number of words of each text."""
    start, end, n = words_of(c, NOT_ALNUM)
    doc = np.repeat(np.arange(c.n, dtype=np.int64), n)
    pre = prefix(BYTE_A[LOWER][c.data], BASE)
    out, who = [mix(spans_hash(pre, start, end, BASE_INV) + U64(1))], [doc]
    for k in PREFIXES:
        long = end - start > k
        out.append(mix(spans_hash(pre, start[long], start[long] + k, BASE_INV) + U64(1 + k)))
        who.append(doc[long])
    return np.concatenate(out), np.concatenate(who), n


def strength(n: np.ndarray, words: np.ndarray, insult: np.ndarray) -> np.ndarray:
    """Value of a feature that a text of so many words holds n times: grows with its density, less than in proportion, at any length; an insult of the lexicon counts 1 more wherever it stands."""
    return np.sqrt(n / (1 + words / 100)) + insult


def word_feature(word: str) -> np.uint64:
    raw = np.frombuffer(word.encode(), np.uint8)
    pre = prefix(BYTE_A[LOWER][raw], BASE)
    return mix(spans_hash(pre, np.array([0]), np.array([len(raw)]), BASE_INV) + U64(1))[0]


INSULTS = np.unique(np.array([word_feature(w) for w in LEXICON], U64))


@dataclass
class Counts:
    """Features by document of the sample, as sorted triples."""

    doc: np.ndarray
    feature: np.ndarray
    n: np.ndarray
    words: np.ndarray
    bangs: np.ndarray
    docs: int


def count(texts: list[str]) -> Counts:
    parts, base, words, bangs = [], 0, [], []
    for c in chunks_of(pa.array(texts, pa.string()), 1 << 20):
        f, d, n_words = features(c)
        order = np.lexsort((f, d))
        f, d = f[order], d[order]
        new = np.flatnonzero(np.concatenate([[True], (f[1:] != f[:-1]) | (d[1:] != d[:-1])])) if len(f) else np.zeros(0, np.int64)
        parts.append((d[new] + base, f[new], np.diff(np.concatenate([new, [len(f)]]))))
        words.append(n_words)
        bang = np.concatenate([[0], np.cumsum(c.data == 0x21)])
        bangs.append(bang[c.starts + c.lens] - bang[c.starts])
        base += c.n
    if not parts:
        z = np.zeros(0, np.int64)
        return Counts(z, z.astype(U64), z, z, z, 0)
    d, f, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    return Counts(d, f, n, np.concatenate(words), np.concatenate(bangs), base)


def surprise(hits: np.ndarray, of: np.ndarray, share: float) -> np.ndarray:
    """Standard errors by which `hits` of `of` documents exceed the share that chance would give."""
    share = min(max(share, 1e-3), 1 - 1e-3)
    return (hits - of * share) / np.sqrt(np.maximum(of, 1) * share * (1 - share))


def mine(x: Counts, y: np.ndarray) -> np.ndarray:
    """Features that stand for the toxic class in the labelled rows: dense in several toxic documents and in few clean ones."""
    if not len(y) or y.min() == y.max():
        return np.zeros(0, U64)
    thick = x.n * SPARSE >= x.words[x.doc]
    feats, at = np.unique(x.feature[thick], return_inverse=True)
    toxic = np.bincount(at, y[x.doc[thick]] == 1, len(feats))
    clean = np.bincount(at, y[x.doc[thick]] == 0, len(feats))
    strong = surprise(toxic, toxic + clean, y.mean())
    pick = np.flatnonzero((toxic >= 2) & (strong >= SURPRISE) & (clean <= 0.35 * toxic))
    pick = pick[np.argsort(-strong[pick], kind="stable")][:MINED]
    return feats[pick]


PATTERNS = 8


def votes(x: Counts, entries: np.ndarray) -> np.ndarray:
    """documents x voters: 1 toxic, -1 clean, 0 abstains.  One voter an entry, then the patterns."""
    table = np.zeros((x.docs, len(entries) + PATTERNS), np.int8)
    hits = np.zeros(x.docs)
    if len(entries):
        order = np.argsort(entries)
        at = np.minimum(np.searchsorted(entries[order], x.feature), len(entries) - 1)
        known = entries[order][at] == x.feature
        hit = known & ((x.n * SPARSE >= x.words[x.doc]) | np.isin(x.feature, INSULTS))
        table[x.doc[hit], order[at[hit]]] = 1
        hits = np.bincount(x.doc[known], x.n[known], x.docs)
    kinds, words = table[:, : len(entries)].sum(1), np.maximum(x.words, 1)
    for k, (toxic, clean) in enumerate((
        (kinds >= 2, kinds == 0),  # several entries, or none
        (kinds >= 4, kinds < 1),
        ((kinds > 0) & (x.bangs > 0), (kinds == 0) & (x.bangs == 0)),  # an entry and shouting
        ((kinds > 0) & (words <= 60), np.zeros(x.docs, bool)),  # an entry in a short text
        (hits >= 0.02 * words, hits == 0),  # density
        (hits >= 0.05 * words, hits < 0.002 * words),
        (np.zeros(x.docs, bool), (hits == 0) & (words >= 20)),  # many words without one
        (np.zeros(x.docs, bool), (hits == 0) & (words >= 200)),
    )):
        table[:, len(entries) + k] = np.where(toxic, 1, np.where(clean, -1, 0))
    return table


def label_model(table: np.ndarray, prior: float, gold: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Posterior of the toxic class: per-voter rates by EM, one voice for each group of correlated voters.

    gold: 1, 0, or -1 where a row has no label; labels are one more voter, whose rates are estimated
    like the others' and whose log odds GOLD bounds.
    """
    n, m = table.shape
    pos, neg = (table == 1).astype(np.float32), (table == -1).astype(np.float32)
    prior = min(max(prior, 0.01), 0.5)
    used = np.flatnonzero((pos.sum(0) + neg.sum(0)) > 0)
    if not n or not len(used):
        return np.full(n, prior)
    pos, neg = pos[:, used], neg[:, used]
    vote = pos.sum(1) > 0
    q = np.where(gold == 1, 0.95, np.where(gold == 0, 0.02, np.where(vote, 0.8, prior / 4)))
    share, yes, no = np.ones(len(used)), gold == 1, gold == 0
    for step in range(rounds):
        w1, w0 = q.sum() + 2, (1 - q).sum() + 2
        rates = [((q @ pos + 0.2) / w1, (q @ neg + 0.2) / w1), (((1 - q) @ pos + 0.02) / w0, ((1 - q) @ neg + 0.2) / w0)]
        right = [(q @ yes + 1) / (q @ (yes | no) + 1.1), ((1 - q) @ no + 1) / ((1 - q) @ (yes | no) + 1.1)]  # of labels, by class
        told = np.where(yes, np.log(right[0] / (1 - right[1])), np.where(no, np.log((1 - right[0]) / right[1]), 0.0)).clip(-GOLD, GOLD)
        if step in (3, 10):  # correlations of what the class leaves unexplained
            resid = pos - neg - np.outer(q, rates[0][0] - rates[0][1]) - np.outer(1 - q, rates[1][0] - rates[1][1])
            resid = resid.astype(np.float32)
            norm = np.sqrt((resid * resid).sum(0)) + 1e-6
            corr = (resid / norm).T @ (resid / norm)
            share = 1 / np.maximum(1, (np.abs(corr) > 0.5).sum(1))
        z = np.log(prior / (1 - prior)) + pos @ (share * np.log(rates[0][0] / rates[1][0])) + neg @ (share * np.log(rates[0][1] / rates[1][1]))
        none = 1 - pos - neg
        z = z + none @ (share * np.log((1 - rates[0][0] - rates[0][1]).clip(1e-3) / (1 - rates[1][0] - rates[1][1]).clip(1e-3)))
        q = 1 / (1 + np.exp(-np.clip(np.clip(z, -6, 6) + told, -30, 30)))
    return q


def fit_once(x: Counts, y: np.ndarray, toxic_share: float, rounds: int = 150) -> tuple[np.ndarray, np.ndarray, float]:
    """Sorted feature hashes, their weights, bias: mining, label model, logistic regression."""
    told = np.flatnonzero(y >= 0)
    mined = mine(part(x, told), y[told])
    entries = np.unique(np.concatenate([INSULTS, mined]))
    if not x.docs:
        return entries, np.full(len(entries), 4.0), -3.0
    q = label_model(votes(x, entries), toxic_share if len(told) else 0.1, y)
    thick = x.n * SPARSE >= x.words[x.doc]
    feats, at = np.unique(x.feature[thick], return_inverse=True)
    seen = np.bincount(at, minlength=len(feats))
    mass = np.bincount(at, q[x.doc[thick]], len(feats))
    far = surprise(mass, seen, q.mean())
    strong = np.flatnonzero((seen >= 3) & (far >= SURPRISE))
    strong = strong[np.argsort(-far[strong], kind="stable")][:KEPT]
    keep = np.unique(np.concatenate([feats[strong], entries]))
    j = np.minimum(np.searchsorted(keep, x.feature), len(keep) - 1)
    ok = keep[j] == x.feature
    d, j = x.doc[ok], j[ok]
    v = strength(x.n[ok], x.words[d], np.isin(keep, INSULTS)[j])
    w, b = np.zeros(len(keep)), float(np.log(max(toxic_share, 0.02) / max(1 - toxic_share, 0.02)))
    w[np.isin(keep, entries)] = 1.0
    g2, gb2 = np.full(len(keep), 1e-4), 1e-4
    weight = np.where(q > 0.5, max(toxic_share, 0.02) / max(1e-9, (q > 0.5).mean()), (1 - toxic_share) / max(1e-9, (q <= 0.5).mean()))
    for _ in range(rounds):  # AdaGrad on all rows, log loss against posterior labels
        z = np.bincount(d, w[j] * v, x.docs) + b
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        r = (p - q) * weight / x.docs
        g = np.bincount(j, r[d] * v, len(keep)) + 1e-5 * w
        g2 += g * g
        w = np.maximum(w - 0.4 * g / np.sqrt(g2), 0)  # evidence only ever adds up
        gb2 += r.sum() ** 2
        b -= 0.4 * r.sum() / np.sqrt(gb2)
    live = w > 0.02
    return keep[live], w[live], float(b)


def part(x: Counts, rows: np.ndarray) -> Counts:
    """The counts of some documents, renumbered."""
    new = np.full(x.docs, -1, np.int64)
    new[rows] = np.arange(len(rows))
    ok = new[x.doc] >= 0
    return Counts(new[x.doc[ok]], x.feature[ok], x.n[ok], x.words[rows], x.bangs[rows], len(rows))


def distinct(x: Counts) -> np.ndarray:
    """The first of each set of (near) copies: documents whose three least feature hashes agree."""
    first = np.searchsorted(x.doc, np.arange(x.docs))
    last = np.searchsorted(x.doc, np.arange(x.docs), "right")
    key = np.stack([np.where(first + k < last, x.feature[np.minimum(first + k, max(len(x.feature) - 1, 0))], U64(0)) for k in range(3)], 1) if len(x.feature) else np.zeros((x.docs, 3), U64)
    return np.sort(np.unique(key, axis=0, return_index=True)[1]) if x.docs else np.zeros(0, np.int64)


def logits(x: Counts, model: tuple[np.ndarray, np.ndarray, float]) -> np.ndarray:
    keep, w, b = model
    j = np.minimum(np.searchsorted(keep, x.feature), len(keep) - 1)
    ok = keep[j] == x.feature
    return np.bincount(x.doc[ok], w[j[ok]] * strength(x.n[ok], x.words[x.doc[ok]], np.isin(keep, INSULTS)[j[ok]]), x.docs) + b


def train(own: Sample, unlabelled: list[str] | None = None, folds: int = 3) -> tuple[np.ndarray, np.ndarray, float]:
    """fit_once() on all rows; its bias is set on scores that each labelled row gets from a model fitted without it."""
    x = count([*own.texts, *(unlabelled or [])])
    y = np.array([*own.labels, *[-1] * len(unlabelled or [])], np.int64)
    rows = distinct(x)  # copies would make any of their words look like evidence
    x, y = part(x, rows), y[rows]
    keep, w, b = fit_once(x, y, own.share)
    told = np.flatnonzero(y >= 0)
    if len(told) and min((y == 1).sum(), (y == 0).sum()) >= 2 * folds:
        fold, z = np.full(len(y), -1), np.zeros(len(y))
        fold[told] = np.random.default_rng(7).permutation(len(told)) % folds
        for k in range(folds):
            z[fold == k] = logits(part(x, np.flatnonzero(fold == k)), fit_once(part(x, np.flatnonzero(fold != k)), y[fold != k], own.share))
        b += calibration(z[told], y[told])
    return keep, w, float(b)


def calibration(z: np.ndarray, y: np.ndarray) -> float:
    """Shift of the bias that puts THRESHOLD where recall less false alarms is best: near the lower end of the scores that are about as good."""
    cuts = np.unique(z)
    pos, neg = np.sort(z[y == 1]), np.sort(z[y == 0])
    gain = (1 - np.searchsorted(pos, cuts) / len(pos)) - 8 * (1 - np.searchsorted(neg, cuts) / len(neg))
    best = int(np.argmax(gain))
    low = cuts[best - 1] if best else cuts[best] - 1
    near = cuts[gain >= gain[best] - 0.004]
    lo, hi = min(low, near.min()), max(cuts[best], near.max())
    return float(np.log(THRESHOLD / (1 - THRESHOLD)) - (lo + 0.2 * (hi - lo)))


def scores_of(c: Chunk, model: tuple[np.ndarray, np.ndarray, float]) -> np.ndarray:
    keep, w, bias = model
    f, d, n_words = features(c)
    j = np.minimum(np.searchsorted(keep, f), len(keep) - 1)
    hit = keep[j] == f
    pair, n = np.unique(d[hit] * len(keep) + j[hit], return_counts=True)
    at, who = pair % len(keep), pair // len(keep)
    z = np.bincount(who, w[at] * strength(n, n_words[who], np.isin(keep, INSULTS)[at]), c.n) + bias
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of every row.  The model holds at most KEPT + MINED features."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks_of(column(b, "text"), 1 << 20):
                s = scores_of(c, sent.value)
                yield pa.RecordBatch.from_arrays([column(b, "doc_id").slice(c.rows.start, c.n), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def reject(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that score below the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [scores_of(c, sent.value) for c in chunks_of(column(b, "text"), STAGE_BYTES)]
            yield b.filter(pa.array(np.concatenate(s) < threshold)) if s else b

    return docs.mapInArrow(run, docs.schema)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    return train(sample(docs, labels, "toxic"), unlabelled(docs, labels))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return score(docs, fit(docs, labels)).select("doc_id", held_out().alias("held_out"), F.col("score"), "predicted")
