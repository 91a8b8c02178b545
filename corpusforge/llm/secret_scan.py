"""Secret scan: candidates by character runs, false positives removed by a random forest.

Method.  Runs of token characters are cut at '=' (padding at a run's end stays) and at rules of
RULE equal signs.  Pieces of MIN_LENGTH or more that hold a digit or follow a quote, '=' or ':',
and pieces of NAMED_LENGTH or more that follow a secret's name and a sign of assignment or a
blank, are candidates (numpy over the bytes); so is a whole run with a digit and no such piece.
No candidate is too long, and all of its bytes are judged.  A forest of decision trees
judges length, character transitions and classes, dictionary coverage, path signs and the
neighbouring words.  It is trained from labelled findings: rows of (before, value, after,
label); labelled_findings() makes a seeded set of known shapes, and callers may give their own.

Cases: null and empty texts have no candidates; very long texts are scanned whole; repeated rows
are scanned alike; an empty table gives an empty result; extra columns are kept by redact() and
ignored by scan().
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import STAGE_BYTES, Chunk, chunks_of, column, covered, read, ship

MIN_LENGTH, NAMED_LENGTH = 16, 6
RULE = 4
NEAR = 48  # bytes of context on either side
THRESHOLD = 0.5
TREES, DEPTH, LEAF = 40, 9, 4
MASK = b"[SECRET]"

TOKEN = np.zeros(256, bool)
TOKEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *b"+/_-=.~"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_SIGN = np.zeros(256, bool)
_SIGN[[*b"=.-/+~_"]] = True
_RULES, _TAIL = np.flatnonzero(_SIGN).astype(np.uint8), np.frombuffer(b".-~", np.uint8)
_NAME = re.compile(rb"(?i)(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|apikey|access[_-]?key|auth|bearer|credential|private[_-]?key|client[_-]?id|signature)[a-z_\-]*[\"']?\s*(?:=|:|=>|\s)\s*[\"']?$")
#: The names of _NAME with their sign, over lower-case bytes: a value starts where a match ends.
_NAMED = re.compile(rb"(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|apikey|access[_-]?key|auth|bearer|credential|private[_-]?key|client[_-]?id|signature)[a-z_\-]*[\"']?\s*(?:=>|=|:|\s)\s*[\"']?")
_ASSIGN = re.compile(rb"(?:=|:|=>)\s*[\"']?$")
_SAFE = re.compile(rb"(?i)(?:sha-?(?:1|256|512)|md5|checksum|digest|commit|revision|rev|etag|uuid|guid|build|version|integrity|phone|card|isbn|order|invoice|id)\W{0,4}$")
_DUMMY = re.compile(rb"(?i)example|sample|placeholder|changeme|your[_-]|xxxx|dummy|test|foobar|lorem|1234567|abcdef|000000")
_HEX = re.compile(rb"^(?:[0-9a-f]+|[0-9A-F]+)$")
_UUID = re.compile(rb"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")
_KNOWN = re.compile(rb"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|xox[abprs]-|sk[-_](?:live|test|proj)?|AIza|eyJ[A-Za-z0-9_-]+\.|glpat-)")
_PATH = re.compile(rb"(?:^|[\\/])[\w.-]+[\\/][\w.-]+|\.(?:com|org|net|html?|png|jpg|js|css|py|json|txt)\b|^www\.|^https?")
#: Frequent English words and stems for dictionary coverage (fixed values).
WORDS = (
    "with that this from have will your about which their there would these other into more some could them than then been first people water after where little only round year came show every good under name very through form sentence great think help line before turn cause much mean differ move right same tell does three want well also play small home read hand port large spell even land here must high such follow change went light kind need house picture again animal point mother world near build self earth father head stand page should country found answer school grow study still learn plant cover food four between state keep never last thought city tree cross farm hard start might story draw left late while press close night real life north open seem together next white children begin walk example ease paper group always music those both mark often letter until mile river feet care second book carry took science room friend began idea fish mountain stop once base hear horse sure watch color face wood main user data"
).split()
_WORDS = frozenset(w for w in WORDS if len(w) >= 3)


def _transitions() -> np.ndarray:
    """Log probabilities of character pairs in dictionary words, less those of uniform characters."""
    n = np.full((256, 256), 0.02)
    for a in WORDS:
        w = f"{a}"
        for x, y in zip(w, w[1:], strict=False):
            n[ord(x), ord(y)] += 1
    lower = n[97:123, 97:123]
    n[65:91, 65:91] = lower
    return np.log(n / n.sum(1, keepdims=True)) - np.log(1 / 64)


_PAIRS = _transitions()


def coverage(value: str) -> float:
    """Share of the value's letters that dictionary words of three letters or more cover (greedy, longest first)."""
    low, covered, i = value.lower(), 0, 0
    while i < len(low):
        for k in range(min(9, len(low) - i), 2, -1):
            if low[i : i + k] in _WORDS:
                covered, i = covered + k, i + k
                break
        else:
            i += 1
    return covered / max(1, len(low))


def features(before: bytes, value: bytes, after: bytes) -> list[float]:
    v = np.frombuffer(value, np.uint8)
    n = len(v)
    _, counts = np.unique(v, return_counts=True)
    p = counts / n
    kind = np.where(_DIGIT[v], 0, np.where((v >= 97) & (v <= 122), 1, np.where((v >= 65) & (v <= 90), 2, 3)))
    share = np.bincount(kind, minlength=4) / n
    switches = float((kind[1:] != kind[:-1]).mean()) if n > 1 else 0.0
    pairs = float(_PAIRS[v[:-1], v[1:]].mean()) if n > 1 else 0.0
    repeat = float((v[1:] == v[:-1]).mean()) if n > 1 else 0.0
    text = value.decode("latin-1")
    return [
        float(n), float(-(p * np.log2(p)).sum()), *share.tolist(), switches, pairs, repeat, len(counts) / n,
        coverage(text), float(bool(_HEX.match(value))), float(bool(_UUID.match(value))), float(bool(_KNOWN.match(value))), float(bool(_PATH.search(value))), float(value.count(b".") + value.count(b"/")),
        float(bool(_NAME.search(before))), float(bool(_ASSIGN.search(before))), float(before[-1:] in (b'"', b"'") and after[:1] in (b'"', b"'")), float(bool(_SAFE.search(before))),
        float(bool(_DUMMY.search(value))), float(before[-1:] == b"@" or after[:1] == b"@" or b"@" in after[:12]), float(n % 4 == 0), float(max(0, n - 64)),
    ]


def labelled_findings(n: int = 4000, seed: int = 17) -> list[tuple[bytes, bytes, bytes, int]]:
    """Seeded findings (before, value, after, label) of known shapes: secrets, and what scanners mistake for them."""
    r = random.Random(seed)
    hexes, b64, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    prose = lambda: " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 6)))
    names = "token secret password passwd api_key apikey access_key auth_token client_secret private_key bearer SECRET_KEY API_TOKEN Token TOKEN db_password".split()
    safe = "commit sha256 sha1 md5 checksum digest revision etag uuid build integrity version id".split()
    out = []
    for i in range(n):
        lead = prose() + " "
        if i % 2:
            value = r.choice([lambda: pick(hexes, r.choice([32, 40, 40, 48, 64])), lambda: pick(hexes, 40).upper(), lambda: pick(alnum, r.randint(20, 64)), lambda: pick(b64, r.randint(24, 88)), lambda: "AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), lambda: r.choice(["ghp_", "gho_"]) + pick(alnum, 36), lambda: "sk_live_" + pick(alnum, 24), lambda: "xoxb-" + pick("0123456789", 12) + "-" + pick(alnum, 24), lambda: "eyJ" + pick(alnum, 24) + "." + pick(alnum, 40) + "." + pick(alnum, 43), lambda: "AIza" + pick(alnum, 35)])()
            if i % 16 == 1:  # without a digit, or short
                value = r.choice([lambda: pick(alnum[:52], r.randint(12, 32)), lambda: pick(alnum, r.randint(8, 15)), lambda: r.choice("-_").join(r.choice(WORDS) for _ in range(r.randint(3, 5))), lambda: "".join(r.choice(WORDS) for _ in range(r.randint(3, 6))), lambda: r.choice(WORDS) + r.choice(WORDS + [""]) + pick("0123456789", r.randint(2, 4))])()
            elif i % 64 == 3:  # longer than a line
                value = pick(r.choice([b64, alnum, alnum + "-_"]), r.choice([400, 1200, 3000]))
            q = r.choice(['"', '"', "'", ""])
            before = lead + r.choice(names) + r.choice([" = ", "=", ": ", ":", " => "]) + q
            after = q + r.choice([" ", "\n", ";", ",", "!! ", "%%% "]) + prose()
            out.append((before[-NEAR:].encode(), value.encode(), after[:NEAR].encode(), 1))
        else:
            kind = r.randrange(12)
            before, after = lead, r.choice([" ", ".", ", ", "\n"]) + prose()
            if kind == 0:
                value, before = pick(hexes, r.choice([32, 40, 64])), lead + r.choice(safe) + r.choice([" ", ": ", "=", " = "])
            elif kind == 1:
                value, before = "-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12)), lead + r.choice(["", "uuid ", "id: "])
            elif kind == 2:
                value = pick("0123456789", r.randint(16, 22))
            elif kind == 3:
                value = "".join(r.choice(syllables) for _ in range(r.randint(8, 14))) + r.choice(["", "1", "22"])
            elif kind == 4:
                value = "/".join(r.choice(WORDS) for _ in range(r.randint(3, 6))) + r.choice([".html", ".png", "2024", ""])
            elif kind == 5:
                value = "".join(r.choice(WORDS).capitalize() for _ in range(r.randint(3, 5))) + r.choice(["", "2", "V3"])
            elif kind == 6:
                value, before = r.choice(["your_api_key_here_123", "xxxxxxxxxxxxxxxxxxxx1", "example_token_placeholder_1", "changeme_changeme_1", "test_secret_000000000000", "1234567890abcdef1234"]), lead + r.choice(names) + ' = "'
                after = '"' + after
            elif kind == 7:
                value, after = "mail" + pick("0123456789", 2) + ".example." + r.choice(["com", "org"]), " " + prose()
                before = lead + pick("0123456789", 2) + "@"
            elif kind == 8:
                value = pick("0123456789", 4) + "-" + pick("0123456789", 2) + "-" + pick("0123456789", 2) + "T" + pick("0123456789", 6)
            elif kind == 9:
                value = r.choice("ab01-=_.") * r.randint(16, 40) + r.choice(["1", "0"])
            elif kind == 10:  # prose after a name
                value, before = r.choice([lambda: "".join(r.choice(syllables) for _ in range(r.randint(3, 7))), lambda: r.choice([w for w in WORDS if len(w) >= 6])])(), lead + r.choice(names) + r.choice([" ", " ", " ", ": "])
            elif i % 5 == 0:  # data of a picture or an archive
                value, before = pick(b64, r.choice([100, 400, 1200, 3000])), lead + r.choice(["base64,", "", 'src="data:image/png;base64,'])
            else:
                value = "-".join(r.choice(WORDS) for _ in range(r.randint(4, 9))) + r.choice(["", "1", "2024"])
            out.append((before[-NEAR:].encode(), value.encode(), after[:NEAR].encode(), 0))
    return out


@dataclass
class Forest:
    """Trees as arrays: feature (-1: leaf), threshold, left child (right is next), share of secrets."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, left, share in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH + 1):
                f = feature[at]
                go = np.where(x[np.arange(len(x)), np.maximum(f, 0)] <= threshold[at], left[at], left[at] + 1)
                at = np.where(f < 0, at, go)
            total += share[at]
        return total / max(1, len(self.trees))


def train(findings: list[tuple[bytes, bytes, bytes, int]], trees: int = TREES, seed: int = 29) -> Forest:
    """Bootstrap samples, a random third of the features at each split, Gini impurity."""
    x = np.array([features(a, v, z) for a, v, z, _ in findings])
    y = np.array([label for *_, label in findings], float)
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        feature, threshold, left, share = [-1], [0.0], [0], [0.0]
        todo = [(0, rng.integers(0, len(y), len(y)), 0)]
        while todo:
            node, rows, depth = todo.pop()
            share[node] = float(y[rows].mean())
            if depth >= DEPTH or len(rows) < 2 * LEAF or share[node] in (0.0, 1.0):
                continue
            best = (np.inf, -1, 0.0)
            for f in rng.choice(x.shape[1], max(2, x.shape[1] // 3), replace=False):
                order = np.argsort(x[rows, f], kind="stable")
                v, c = x[rows[order], f], np.cumsum(y[rows[order]])
                cut = np.flatnonzero(v[1:] > v[:-1]) + 1
                cut = cut[(cut >= LEAF) & (cut <= len(rows) - LEAF)]
                if len(cut):
                    a, b = c[cut - 1], c[-1] - c[cut - 1]
                    gini = a * (1 - a / cut) + b * (1 - b / (len(rows) - cut))
                    k = int(np.argmin(gini))
                    if gini[k] < best[0]:
                        best = (gini[k], int(f), float(v[cut[k] - 1] + v[cut[k]]) / 2)
            if best[1] < 0:
                continue
            low = x[rows, best[1]] <= best[2]
            feature[node], threshold[node], left[node] = best[1], best[2], len(feature)
            for part in (rows[low], rows[~low]):
                feature.append(-1)
                threshold.append(0.0)
                left.append(0)
                share.append(0.0)
                todo.append((len(feature) - 1, part, depth + 1))
        out.append((np.array(feature), np.array(threshold), np.array(left), np.array(share)))
    return Forest(out)


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of marked places."""
    wide = np.concatenate([[False], inside, [False]])
    edge = np.flatnonzero(wide[1:] != wide[:-1])
    return edge[0::2], edge[1::2]


def pieces(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the parts that '=' and rules leave of the runs of token characters."""
    first = np.flatnonzero(np.concatenate([[True], data[1:] != data[:-1]])) if len(data) else np.zeros(0, np.int64)
    last = np.concatenate([first[1:], [len(data)]])[: len(first)]
    sign, goes_on = data[first], np.concatenate([inside, [False]])[last]
    cut = (sign == 0x3D) & goes_on | np.isin(sign, _RULES) & (last - first >= RULE)
    return spans(inside & ~covered(first[cut], (last - first)[cut], len(data)))


def named_starts(c: Chunk) -> np.ndarray:
    """Where a value begins that follows a secret's name, at most NEAR bytes before it and in the same text."""
    found = np.array([(m.start(), m.end()) for m in _NAMED.finditer(bytes(c.raw).lower())], np.int64).reshape(-1, 2)
    same = np.searchsorted(c.starts, found[:, 0], "right") == np.searchsorted(c.starts, found[:, 1], "right")
    return found[same & (found[:, 1] - found[:, 0] <= NEAR), 1]


def candidates(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every candidate of the chunk."""
    inside = TOKEN[c.data]
    digits, others = (np.concatenate([[0], np.cumsum(x)]) for x in (_DIGIT[c.data], inside & ~_SIGN[c.data]))

    def kept(start: np.ndarray, end: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Those of some length that are not signs alone."""
        ok = (end - start >= least) & (others[end] > others[start])
        return start[ok], end[ok]

    upto = np.maximum.accumulate(np.where(np.isin(c.data, _TAIL), 0, np.arange(1, len(c.data) + 1)))  # the last place before a tail of signs
    start, end = kept(*pieces(c.data, inside), NAMED_LENGTH)
    named = np.isin(start, named_starts(c))
    after = np.isin(c.data[np.maximum(start - 1, 0)], np.frombuffer(b"\"'=:", np.uint8)) & (start > 0)
    wanted = named | (end - start >= MIN_LENGTH) & ((digits[end] > digits[start]) | after)
    start, end, named = start[wanted], end[wanted], named[wanted]
    end = upto[end - 1]
    ok = end - start >= np.where(named, NAMED_LENGTH, MIN_LENGTH)
    start, end = start[ok], end[ok]
    whole, to = kept(*spans(inside), MIN_LENGTH)  # name=value in one run is one candidate if no part of it is
    bare = (digits[to] > digits[whole]) & (np.searchsorted(start, whole) == np.searchsorted(start, to))
    whole, to = whole[bare], upto[to[bare] - 1]
    long = to - whole >= MIN_LENGTH
    start, end = np.concatenate([start, whole[long]]), np.concatenate([end, to[long]])
    order = np.argsort(start, kind="stable")
    return start[order], end[order]


def findings_of(c: Chunk, forest: Forest) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, start, end (bytes of the chunk) and score of every candidate."""
    start, end = candidates(c)
    doc = np.searchsorted(c.starts, start, "right") - 1
    if not len(start):
        return doc, start, end, np.zeros(0)
    rows = []
    for d, s, e in zip(doc.tolist(), start.tolist(), end.tolist(), strict=True):
        lo, hi = int(c.starts[d]), int(c.starts[d] + c.lens[d])
        rows.append(features(c.raw[max(lo, s - NEAR) : s].tobytes(), c.raw[s:e].tobytes(), c.raw[e : min(hi, e + NEAR)].tobytes()))
    return doc, start, end, forest.score(np.array(rows))


_made: list[Forest] = []


def default_forest() -> Forest:
    if not _made:
        _made.append(train(labelled_findings()))
    return _made[0]


def scan(docs: DataFrame, forest: Forest | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, start (bytes from the text's begin), n_bytes, score, is_secret, value_sha256 of every candidate."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(forest or default_forest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = column(b, "doc_id")
            for c in chunks_of(column(b, "text")):
                doc, start, end, score = findings_of(c, sent.value)
                sha = [hashlib.sha256(c.raw[s:e]).hexdigest() for s, e in zip(start.tolist(), end.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([keys.slice(c.rows.start, c.n).take(pa.array(doc)), pa.array(start - c.starts[doc]), pa.array(end - start), pa.array(score), pa.array(score >= threshold), pa.array(sha, pa.string())], ["doc_id", "start", "n_bytes", "score", "is_secret", "value_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, n_bytes long, score double, is_secret boolean, value_sha256 string")


def redact(docs: DataFrame, forest: Forest | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with every secret in text replaced by MASK; n_chars follows, if there is one."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(forest or default_forest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = column(b, "text").to_pylist()
            for c in chunks_of(column(b, "text"), STAGE_BYTES):
                doc, start, end, score = findings_of(c, sent.value)
                hit = np.flatnonzero(score >= threshold)
                hit = hit[np.argsort(doc[hit], kind="stable")]
                held, first = np.unique(doc[hit], return_index=True)
                for d, own in zip(held.tolist(), np.split(hit, first[1:]), strict=False):
                    parts, at = [], int(c.starts[d])
                    for s, e in zip(start[own].tolist(), end[own].tolist(), strict=True):
                        parts += [c.raw[at:s].tobytes(), MASK]
                        at = e
                    parts.append(c.raw[at : int(c.starts[d] + c.lens[d])].tobytes())
                    text[c.rows.start + d] = b"".join(parts).decode()
            yield b.set_column(b.schema.get_field_index("text"), "text", pa.array(text, pa.string()))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
