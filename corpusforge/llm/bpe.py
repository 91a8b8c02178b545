"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding from offsets.

Method.  Each code point has a class (array lookup).  A class is a transition function of a
small automaton; composing functions is associative, so the state after every code point is a
prefix scan over function numbers (a composition table, doubling steps).  Most functions are
constant, so the scan stops as soon as every composite is constant.  Token starts are then read
off neighbouring states; no regular expression runs over the text.  The slices go through a
bounded cache of pair merges; misses are merged together as padded matrices.

Cases: null and empty text have no tokens; white space, very long texts and repeated rows are
ordinary; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import STAGE_BYTES, Chunk, chunks_of, column, ranges, read, ship

# Automaton states: what the last code point was.
START, LETTER, NUMBER, OTHER, WHITE, BLANK, QUOTE, SHORT, PEND_E, PEND_L = range(10)
# Code point classes.
C_LETTER, C_STMD, C_RV, C_L, C_E, C_NUMBER, C_OTHER, C_QUOTE, C_BLANK, C_WHITE, C_RESET = range(11)
CACHE_SLICES = 200_000
MATRIX_BYTES = 128  # longer slices are merged with a heap


def _classes() -> np.ndarray:
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, C_OTHER, np.uint8)
    shift = lambda i: i if i < 0xD800 else i + 0x800
    for kind, pattern in ((C_LETTER, r"\p{L}+"), (C_NUMBER, r"\p{N}+"), (C_WHITE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, points):
            out[shift(m.start()) : shift(m.end() - 1) + 1] = kind
    for kind, chars in ((C_STMD, "stmd"), (C_RV, "rv"), (C_L, "l"), (C_E, "e"), (C_QUOTE, "'"), (C_BLANK, " ")):
        out[[ord(x) for x in chars]] = kind
    return out


def _functions() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Closure of the class functions under composition: table of functions, composition, constants."""
    k = 10
    base = {c: [s] * k for c, s in ((C_LETTER, LETTER), (C_NUMBER, NUMBER), (C_OTHER, OTHER), (C_BLANK, BLANK), (C_WHITE, WHITE), (C_RESET, START))}
    for c, moves in ((C_STMD, {QUOTE: SHORT}), (C_RV, {QUOTE: PEND_E}), (C_L, {QUOTE: PEND_L, PEND_L: SHORT}), (C_E, {PEND_E: SHORT})):
        base[c] = [moves.get(s, LETTER) for s in range(k)]
    base[C_QUOTE] = [OTHER if s in (OTHER, BLANK, QUOTE) else QUOTE for s in range(k)]
    known = {tuple(base[c]): c for c in range(11)}
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in list(known):
            for h in (tuple(g[x] for x in f), tuple(f[x] for x in g)):
                if h not in known:
                    known[h] = len(known)
                    todo.append(h)
    made = sorted(known, key=known.get)
    compose = np.array([[known[tuple(g[x] for x in f)] for g in made] for f in made], np.uint8)  # f first, then g
    return np.array(made, np.uint8), compose, np.array([len(set(f)) == 1 for f in made])


_lazy: dict = {}


def _tables():
    if "t" not in _lazy:
        _lazy["t"] = (_classes(), *_functions())
    return _lazy["t"]


def states(kinds: np.ndarray) -> np.ndarray:
    """State after every code point: an inclusive scan of function composition, by doubling."""
    _, made, compose, constant = _tables()
    f, step = kinds.copy(), 1
    while step < len(f):
        open_ = np.flatnonzero(~constant[f[step:]]) + step
        if not len(open_):
            break
        f[open_] = compose[f[open_ - step], f[open_]]
        step *= 2
    return made[f, START]


def token_spans(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every pre-token of the chunk, and the number of them in each text."""
    classes = _tables()[0]
    points = np.frombuffer(str(c.raw, "utf-8").encode("utf-32-le"), np.uint32)
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(c.n, np.int64)
    lead = (c.data & 0xC0) != 0x80
    at = np.flatnonzero(lead)  # byte place of each code point
    gap = np.searchsorted(at, c.starts[1:] - 1)  # the joining blanks
    kinds = classes[points]
    kinds[gap] = C_RESET
    q = states(kinds)
    p = np.concatenate([[START], q[:-1]]).astype(np.uint8)
    after = np.concatenate([q[1:], [START]]).astype(np.uint8)
    keep = np.zeros((10, 10), bool)  # by state before and after: the code point stays in the token before it
    keep[[LETTER, BLANK, PEND_E, PEND_L], LETTER] = True
    keep[[NUMBER, BLANK], NUMBER] = True
    keep[[OTHER, BLANK, QUOTE], OTHER] = True
    keep[:, SHORT] = True
    keep[np.ix_([WHITE, BLANK], [WHITE, BLANK])] = True
    first = ~keep[p, q]
    first &= ~(((q == PEND_E) | (q == PEND_L)) & (after == SHORT))
    white, next_white = (q == WHITE) | (q == BLANK), (after == WHITE) | (after == BLANK)
    first |= white & ~next_white & (after != START)
    begin = np.flatnonzero(first)
    start = at[begin]
    end = np.concatenate([start[1:], [len(c.data)]])
    real = q[begin] != START
    start, end = start[real], end[real]
    counts = np.diff(np.concatenate([np.searchsorted(start, c.starts), [len(start)]]))
    return start, end, counts


class Codec:
    """Encoder and decoder for one rank file."""

    def __init__(self, lines: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        vocab = [b""] * self.size
        for token, i in ranks.items():
            vocab[i] = token
        self.vocab_len = np.array([len(x) for x in vocab], np.int64)
        self.vocab_at = np.concatenate([[0], np.cumsum(self.vocab_len)[:-1]])
        self.vocab = np.frombuffer(b"".join(vocab), np.uint8)
        self.text = [str(i) for i in range(self.size)]
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:j]] * self.size + ranks[t[j:]], i) for t, i in ranks.items() for j in range(1, len(t)) if t[:j] in ranks and t[j:] in ranks]
        keys, values = np.array([x for x, _ in pairs], np.int64), np.array([x for _, x in pairs], np.int32)
        self.bits = 20
        self.slot_key = np.full(1 << self.bits, -1, np.int64)
        self.slot_rank = np.full(1 << self.bits, 1 << 30, np.int32)
        self.probes = 0
        left = np.arange(len(keys))
        while len(left):  # place by linear probing, all keys of a round at once
            slot = (self._slot(keys[left]) + self.probes) & ((1 << self.bits) - 1)
            free = self.slot_key[slot] < 0
            _, one = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[one]
            self.slot_key[slot[put]], self.slot_rank[slot[put]] = keys[left[put]], values[left[put]]
            left = np.delete(left, put)
            self.probes += 1
        self.forget()

    def forget(self) -> None:
        self.seen: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 20, np.int32)
        self.first = np.zeros(1 << 18, np.int64)
        self.count = np.zeros(1 << 18, np.int64)
        self.used = 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) * self.size + b
        slot, out = self._slot(keys), np.full(keys.shape, 1 << 30, np.int32)
        for _ in range(self.probes):
            held = self.slot_key[slot]
            np.copyto(out, self.slot_rank[slot], where=held == keys)
            if not ((held >= 0) & (held != keys)).any():
                break
            slot = (slot + 1) & ((1 << self.bits) - 1)
        return out

    def _merge_matrix(self, ids: np.ndarray) -> list[np.ndarray]:
        """Merge all rows (equal length) together; one merge a row and step."""
        out: list = [None] * len(ids)
        rows = np.arange(len(ids))
        while True:
            if ids.shape[1] < 2:
                for r, x in zip(rows, ids, strict=True):
                    out[r] = x
                return out
            ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:])
            best = ranks.argmin(1)
            low = ranks[np.arange(len(ids)), best]
            done = low == 1 << 30
            if done.any():
                for r in np.flatnonzero(done):
                    out[rows[r]] = ids[r]
                going = ~done
                ids, rows, best, low = ids[going], rows[going], best[going], low[going]
                if not len(rows):
                    return out
            ids[np.arange(len(ids)), best] = low
            held = np.ones(ids.shape, bool)
            held[np.arange(len(ids)), best + 1] = False
            ids = ids[held].reshape(len(ids), -1)

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """Lowest rank first, leftmost on ties, over a linked list with a heap."""
        n, ranks = len(piece), self.ranks
        ends, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), [*range(1, n), -1]
        live = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = after[i] if live[i] else -1
            if j < 0 or ends[j] != end:
                continue
            ends[i], after[i], live[j] = end, after[j], False
            if after[i] >= 0:
                before[after[i]] = i
                if (r := ranks.get(piece[i : ends[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, ends[after[i]]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:end])) is not None:
                heapq.heappush(heap, (r, h, end))
        return np.array([ranks[piece[i : ends[i]]] for i in range(n) if live[i]], np.int32)

    def _learn(self, pieces: list[bytes]) -> None:
        by_len: dict[int, list[bytes]] = {}
        for x in pieces:
            by_len.setdefault(len(x), []).append(x)
        for size, own in by_len.items():
            whole = [self.ranks.get(x) for x in own]
            rest = [x for x, r in zip(own, whole, strict=True) if r is None]
            merged = [self._merge_long(x) for x in rest] if size > MATRIX_BYTES else self._merge_matrix(self.byte_id[np.frombuffer(b"".join(rest), np.uint8).reshape(-1, size)]) if rest else []
            got = iter(merged)
            for x, r in zip(own, whole, strict=True):
                self._add(x, next(got) if r is None else np.array([r], np.int32))

    def _add(self, piece: bytes, ids: np.ndarray) -> None:
        i = len(self.seen)
        if i >= len(self.first):
            self.first, self.count = np.resize(self.first, 2 * i), np.resize(self.count, 2 * i)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.seen[piece], self.first[i], self.count[i] = i, self.used, len(ids)
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def encode(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of the chunk one after another, and the number of ids of each text."""
        start, end, counts = token_spans(c)
        raw = bytes(c.raw)
        slices = [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        if len(self.seen) > CACHE_SLICES or self.used > 8 * CACHE_SLICES:
            self.forget()
        if new := [x for x in dict.fromkeys(slices) if x not in self.seen]:
            self._learn(new)
        own = np.fromiter(map(self.seen.__getitem__, slices), np.int64, len(slices))
        n = self.count[own]
        total = np.concatenate([[0], np.cumsum(n)])
        at = np.concatenate([[0], np.cumsum(counts)])
        return self.ids[ranges(self.first[own], n)], total[at[1:]] - total[at[:-1]]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of ids: vocabulary slices gathered by their offsets."""
        return self.vocab[ranges(self.vocab_at[ids], self.vocab_len[ids])].tobytes()


_codecs: dict[str, Codec] = {}


def codec(name: str, content: bytes | None = None) -> Codec:
    if name not in _codecs:
        if content is None:
            with open(name, "rb") as f:
                content = f.read()
        _codecs[name] = Codec(content)
    return _codecs[name]


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _vocabulary(spark: SparkSession, path: str) -> str:
    """Ship the vocabulary file (a fixed size, under 2 MB) to every executor."""
    ship(spark)
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids array<int>, starts array<int>: the token ids of every whole text, and the byte of the text at which each token starts.

    A null or empty text has empty arrays.  starts let a caller decode a byte span of the text
    from its tokens alone: those from the last start at or before the span's.
    """
    name = _vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(SparkFiles.get(name))
        for b in batches:
            keys = column(b, "k")
            for c in chunks_of(column(b, "t")):
                ids, n = own.encode(c)
                off = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                size = own.vocab_len[ids]
                ends = np.cumsum(size)
                starts = ends - size - np.repeat(np.concatenate([[0], ends])[off[:-1]], n)
                yield pa.RecordBatch.from_arrays([keys[c.rows], *(pa.ListArray.from_arrays(pa.array(off), pa.array(x, pa.int32())) for x in (ids, starts))], ["k", "ids", "starts"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).mapInArrow(run, f"k {kind}, ids array<int>, starts array<int>").withColumnRenamed("k", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, text binary: the bytes that each array of ids stands for (null: null)."""
    name = _vocabulary(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(SparkFiles.get(name))
        for b in batches:
            out = [None if x is None else own.decode(np.array(x, np.int64)) for x in column(b, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(b, "k"), pa.array(out, pa.binary())], ["k", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("k"), F.col(ids_col).alias("ids")).mapInArrow(run, f"k {kind}, text binary").withColumnRenamed("k", id_col)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text: encode, decode the ids, hash both."""
    name = _vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(SparkFiles.get(name))
        for b in batches:
            keys = column(b, "doc_id")
            for c in chunks_of(column(b, "text")):
                ids, n = own.encode(c)
                at = np.concatenate([[0], np.cumsum(n)])
                csv, plain = [], []
                for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    part = ids[a:z]
                    csv.append(hashlib.sha256(",".join(map(own.text.__getitem__, part.tolist())).encode()).hexdigest())
                    plain.append(hashlib.sha256(own.decode(part)).hexdigest())
                yield pa.RecordBatch.from_arrays([keys.slice(c.rows.start, c.n), pa.array(n.astype(np.int64)), pa.array(csv), pa.array(plain)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip (the ids decode to the text's bytes) of every row."""
    name = _vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(SparkFiles.get(name))
        for b in batches:
            keys = column(b, "doc_id")
            for c in chunks_of(column(b, "text"), STAGE_BYTES):
                ids, n = own.encode(c)
                at = np.concatenate([[0], np.cumsum(n)])
                same = [own.decode(ids[at[i] : at[i + 1]]) == c.raw[s : s + k].tobytes() for i, (s, k) in enumerate(zip(c.starts.tolist(), c.lens.tolist(), strict=True))]
                yield pa.RecordBatch.from_arrays([keys.slice(c.rows.start, c.n), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids, pa.int32())), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
