"""SentencePiece encoding and decoding for merge models: backtracking over longest matches.

Method.  A sequence of pieces is the model's encoding exactly when every two neighbours, merged
again from their characters, come out as those two pieces.  An Aho-Corasick automaton finds the
pieces that start at each character; the longest is taken first, kept if it is compatible with
the piece before it, and given back when nothing compatible follows.  The pieces up to a place
are the only valid ones up to there, so a place from which nothing followed is marked in a
bitfield and never entered again.

Before that, a text is cut between any two characters that stand side by side in no piece: no
merge crosses such a cut, so the parts are encoded one by one, through a bounded cache.  The cuts
are found for a whole chunk of texts by array lookups.

Cases: null and empty texts have the begin and end ids alone; white space of any kind, very long
texts and repeated rows are ordinary; invalid UTF-8 counts as replacement characters; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Chunk, chunks_of, column, ranges, read, ship

NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # kinds of pieces in a model file
SPACE = "▁"  # stands for a space inside pieces
UNKNOWN_TEXT = " ⁇ "  # what an unknown id decodes to
CACHE_SLICES = 200_000
CACHE_PAIRS = 1_000_000
SPAN = 4096  # characters of a long slice whose matches are held at a time


def _each_byte(e: UnicodeError):
    return "�" * (e.end - e.start), e.end


codecs.register_error("each_byte", _each_byte)


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of every field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + size]
        at += size


class Model:
    """Pieces of a model file, and what is derived from them once a worker."""

    def __init__(self, content: bytes):
        self.pieces: list[str] = []
        scores, kinds = [], []
        trainer = normalizer = b""
        for number, value in fields(content):
            if number == 1:
                own = dict(fields(value))
                self.pieces.append(own.get(1, b"").decode())
                scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                kinds.append(own.get(3, NORMAL))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normalizer = dict(fields(value))
        trainer, normalizer = dict(trainer), dict(normalizer)
        if trainer.get(3, 1) != 2 or not trainer.get(35) or trainer.get(24):
            raise ValueError("only merge models with byte fallback are supported")
        if normalizer.get(2) or not normalizer.get(3, 1) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("only models without normalisation rules, with a dummy prefix and with all white space kept are supported")
        if extra := set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"pieces of kinds {sorted(extra)} are not supported")
        self.kinds = np.array(kinds, np.int8)
        self.id = {p: i for i, p in enumerate(self.pieces) if kinds[i] == NORMAL}
        self.score = {p: scores[i] for p, i in self.id.items()}
        self.byte_id = np.zeros(256, np.int64)
        self.byte_of: dict[int, int] = {}
        for i in np.flatnonzero(self.kinds == BYTE).tolist():
            value = int(self.pieces[i][1:-1], 16)
            self.byte_id[value], self.byte_of[i] = i, value
        control = {self.pieces[i]: i for i in np.flatnonzero(self.kinds == CONTROL).tolist()}
        self.begin, self.end = control["<s>"], control["</s>"]
        self._alphabet()
        self.longest = max(map(len, self.id), default=1)
        self.automaton = ahocorasick.Automaton()
        for p in self.id:
            self.automaton.add_word(p, p)
        for x in self.atoms:
            self.automaton.add_word(x, x)
        if len(self.automaton):
            self.automaton.make_automaton()
        plain = [bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(SPACE, " ").encode() if kinds[i] == NORMAL else b"" for i, p in enumerate(self.pieces)]
        self.vocab = np.frombuffer(b"".join(plain), np.uint8)
        self.vocab_len = np.array([len(x) for x in plain], np.int64)
        self.vocab_at = np.cumsum(self.vocab_len) - self.vocab_len
        self.pairs: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.forget()

    def _alphabet(self) -> None:
        """A class for each character that stands in a piece of two or more, and which classes stand side by side."""
        longer = [p for p in self.id if len(p) > 1]
        letters = sorted({x for p in longer for x in p})
        self.atoms = [x for x in letters if x not in self.id]
        self.kind = np.zeros(0x110000, np.int64)
        self.kind[[ord(x) for x in letters]] = np.arange(1, len(letters) + 1)
        self.kind[0x20] = self.kind[ord(SPACE)]
        self.side = len(letters) + 1
        met = np.zeros(self.side * self.side, bool)
        for p in longer:
            own = self.kind[np.frombuffer(p.encode("utf-32-le"), np.uint32)]
            met[own[:-1] * self.side + own[1:]] = True
        self.met = np.packbits(met, bitorder="little")

    def forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.first = np.zeros(1 << 12, np.int64)
        self.count = np.zeros(1 << 12, np.int64)
        self.ids = np.zeros(1 << 14, np.int32)
        self.used = 0

    # ---- merging

    def merged(self, text: str) -> list[str]:
        """Best score first, leftmost on ties, until no two neighbours make a piece.  For short texts."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        """Whether the two pieces side by side are what their characters merge to."""
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            got = self.pairs[a, b] = self.merged(a + b) == [a, b]
        return got

    def reachable(self, piece: str) -> bool:
        """Whether the piece's own characters merge to it."""
        got = self.whole.get(piece)
        if got is None:
            got = self.whole[piece] = self.merged(piece) == [piece]
        return got

    def parts(self, text: str) -> list[str]:
        """The pieces of a text whose spaces are marks already."""
        n, spans = len(text), {}

        def matches(at: int) -> list[str]:
            """Pieces that start at a place, the longest first."""
            k = at // SPAN
            if k not in spans:
                if len(spans) > 2:
                    spans.clear()
                lo, hi = k * SPAN, min(n, (k + 1) * SPAN)
                own: list[list[str]] = [[] for _ in range(hi - lo)]
                for end, p in self.automaton.iter(text, lo, min(n, hi + self.longest - 1)):
                    start = end + 1 - len(p)
                    if lo <= start < hi:
                        own[start - lo].append(p)
                for found in own:
                    found.reverse()  # they came by end, so by length
                spans[k] = own
            return spans[k][at - k * SPAN]

        out: list[str] = []
        tried: list[int] = []  # for each piece of out, how many matches of its start were looked at
        failed = bytearray((n >> 3) + 1)
        at = choice = 0
        while at < n:
            found, took = matches(at), False
            while choice < len(found):
                p = found[choice]
                choice += 1
                to = at + len(p)
                if not failed[to >> 3] >> (to & 7) & 1 and self.reachable(p) and (not out or self.compatible(out[-1], p)):
                    out.append(p)
                    tried.append(choice)
                    at, choice, took = to, 0, True
                    break
            if not took:
                failed[at >> 3] |= 1 << (at & 7)
                if not out:
                    raise ValueError("the model has no pieces for a text of its own characters")
                at -= len(out.pop())
                choice = tried.pop()
        return out

    # ---- chunks of texts

    def slices(self, c: Chunk) -> tuple[list[str], np.ndarray]:
        """Parts of the chunk's texts between which nothing merges, each text with the space that goes before it, and their number a text."""
        try:
            text = " " + str(c.raw, "utf-8")
            lead = np.concatenate([[0], np.cumsum((c.data & 0xC0) != 0x80)])
            begin = lead[c.starts]
        except UnicodeDecodeError:
            own = [bytes(c.raw[s : s + k]).decode("utf-8", "each_byte") for s, k in zip(c.starts.tolist(), c.lens.tolist(), strict=True)]
            text = " " + " ".join(own)
            begin = np.concatenate([[0], np.cumsum([len(x) + 1 for x in own])[:-1]]).astype(np.int64)
        kind = self.kind[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        pair = kind[:-1] * self.side + kind[1:]
        cut = np.ones(len(text) + 1, bool)
        cut[1:-1] = (self.met[pair >> 3] >> (pair & 7).astype(np.uint8)) & 1 == 0
        cut[begin] = True
        edges = np.flatnonzero(cut)
        own = np.searchsorted(edges, np.append(begin, len(text)))
        counts = np.diff(own)
        parts = [text[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        if (empty := np.flatnonzero(c.lens == 0)).size:
            # The space before an empty text is not part of anything.
            gone = set(own[empty].tolist())
            parts = [x for i, x in enumerate(parts) if i not in gone]
            counts[empty] = 0
        return parts, counts

    def learn(self, text: str) -> None:
        """Encode one slice and keep its ids."""
        ids: list[int] = []
        plain = text.replace(" ", SPACE)
        for p in [plain] if len(plain) == 1 else self.parts(plain):
            if (i := self.id.get(p)) is not None:
                ids.append(i)
            else:
                ids.extend(self.byte_id[list(p.encode())].tolist())
        i = len(self.seen)
        if i >= len(self.first):
            self.first, self.count = np.resize(self.first, 2 * i), np.resize(self.count, 2 * i)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.seen[text], self.first[i], self.count[i] = i, self.used, len(ids)
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def encode(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of the chunk one after another, without begin and end, and the number of ids of each text."""
        parts, counts = self.slices(c)
        if len(self.seen) > CACHE_SLICES or self.used > 8 * CACHE_SLICES:
            self.forget()
        for x in dict.fromkeys(parts):
            if x not in self.seen:
                self.learn(x)
        own = np.fromiter(map(self.seen.__getitem__, parts), np.int64, len(parts))
        n = self.count[own]
        total = np.concatenate([[0], np.cumsum(n)])
        at = np.concatenate([[0], np.cumsum(counts)])
        return self.ids[ranges(self.first[own], n)], total[at[1:]] - total[at[:-1]]

    def bounded(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids and counts with begin and end around each text's."""
        at = np.concatenate([[0], np.cumsum(n + 2)])
        out = np.empty(at[-1], np.int32)
        out[at[:-1]], out[at[1:] - 1] = self.begin, self.end
        out[ranges(at[:-1] + 1, n)] = ids
        return out, n + 2

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of any ids, as UTF-8: marks are spaces, the first one is left out, bytes that make no character are replacement characters."""
        ids = np.asarray(ids, np.int64)
        ids = np.where((ids < 0) | (ids >= len(self.pieces)), np.flatnonzero(self.kinds == UNKNOWN)[0], ids)
        kinds = self.kinds[ids]
        held = np.flatnonzero(kinds != CONTROL)
        inner = ids[held[0] : held[-1] + 1] if len(held) else ids[:0]
        # A text starts with a mark and has begin and end around it; anything else goes piece by piece.
        if len(inner) == len(held) and not (kinds == UNKNOWN).any() and len(held) and self.pieces[inner[0]].startswith(SPACE):
            text = self.vocab[ranges(self.vocab_at[inner], self.vocab_len[inner])].tobytes()[1:]
            try:
                text.decode()
                return text
            except UnicodeDecodeError:
                pass
        return self._decode_each(ids)

    def _decode_each(self, ids: np.ndarray) -> bytes:
        out, pending, first = [], bytearray(), True
        for i in ids.tolist():
            if i in self.byte_of:
                pending.append(self.byte_of[i])
                continue
            if pending:
                out.append(pending.decode("utf-8", "each_byte"))
                pending.clear()
                first = False
            kind = self.kinds[i]
            if kind == NORMAL:
                p = self.pieces[i]
                if first and p.startswith(SPACE):
                    p = p[1:]
                out.append(p.replace(SPACE, " "))
                first = False
            elif kind == UNKNOWN:
                out.append(UNKNOWN_TEXT)
                first = False
        out.append(pending.decode("utf-8", "each_byte"))
        return "".join(out).encode()


_models: dict[str, Model] = {}


def model(name: str) -> Model:
    if name not in _models:
        with open(name, "rb") as f:
            _models[name] = Model(f.read())
    return _models[name]


def _sent(spark: SparkSession, path: str) -> str:
    """Ship the model file (a fixed size, under 1 MB) to every executor."""
    ship(spark)
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids array<int>: begin, the ids of the whole text, end.  A null or empty text has begin and end alone."""
    name = _sent(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(SparkFiles.get(name))
        for b in batches:
            keys = column(b, "k")
            for c in chunks_of(column(b, "t")):
                ids, n = own.bounded(*own.encode(c))
                off = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([keys[c.rows], pa.ListArray.from_arrays(pa.array(off), pa.array(ids, pa.int32()))], ["k", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, text: what each array of ids stands for (null: null); ids outside the vocabulary and null ones count as unknown."""
    name = _sent(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(SparkFiles.get(name))
        for b in batches:
            out = [None if x is None else own.decode(np.array([-1 if i is None else i for i in x], np.int64)).decode() for x in column(b, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(b, "k"), pa.array(out, pa.string())], ["k", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("k"), F.col(ids_col).alias("ids")).mapInArrow(run, f"k {kind}, text string").withColumnRenamed("k", id_col)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text: encode, decode the ids, hash both."""
    name = _sent(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(SparkFiles.get(name))
        for b in batches:
            keys = column(b, "doc_id")
            for c in chunks_of(column(b, "text")):
                ids, n = own.bounded(*own.encode(c))
                at = np.concatenate([[0], np.cumsum(n)]).tolist()
                raw = ids.astype("<u4")
                coded = [hashlib.sha256(raw[a:z]).hexdigest() for a, z in zip(at[:-1], at[1:], strict=True)]
                plain = [hashlib.sha256(own.decode(ids[a:z])).hexdigest() for a, z in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([keys.slice(c.rows.start, c.n), pa.array(n.astype(np.int64)), pa.array(coded), pa.array(plain)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op12_sentence_piece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
