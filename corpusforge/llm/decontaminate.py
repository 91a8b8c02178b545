"""Benchmark decontamination with a stored, distributed positional inverted index.

Method.  The documents are scanned once.  Each segment (a chunk of whole documents, about 1 MB)
becomes one row of a stored index: its terms (hash and spelling), the number of its documents
that hold a term, and every term's sorted word positions.  All searches read the index alone,
segment by segment, so a term that a third of all words are is split over all segments.  The
test items travel to it in blocks of bounded size (BLOCK_BYTES of text).

Exact phrases: a window starts from its rarest term's list; each position there must have a
neighbouring term of the item beside it, and then the lists of the window's other terms, shifted
by their offsets, are intersected with it, rarest first, by binary search.  A query term counts
as an index term only where their spellings agree, not by hash alone.  Proximity: the item's
rarest terms (by documents of the whole table, then by spelling) within some words of each other.

Cases: null and empty texts have no words; items without words are ignored, as are items
without an id; repeated items and rows are answered one by one; very long texts are a segment of
their own; an empty table gives an empty result (empty benchmark: no hits); extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, NOT_ALNUM, STAGE_BYTES, U64, Chunk, chunks_of, column, covered, ranges, read, shared_dir, ship, stored, word_hashes, words_of

BLOCK_BYTES = 4 << 20
WINDOW = 10
RAREST, WITHIN = 3, 10
PAIRS = 1_000_000  # candidates looked at together
ROW_GROUP = 8 << 20  # bytes of the index that a writer or reader holds, about
#: Bytes of text in a segment, about: its arrays stay below half a megabyte each, which a JVM of some gigabytes can move.
SEGMENT_BYTES = 1 << 19


@dataclass
class Segment:
    """Postings of a chunk of whole documents.  Positions are words counted over the chunk."""

    n_words: np.ndarray  # of each document
    terms: np.ndarray  # distinct term hashes, ascending
    size: np.ndarray  # positions of each term
    places: np.ndarray  # positions, term by term, ascending
    df: np.ndarray  # documents that hold each term
    length: np.ndarray  # bytes of each term's spelling
    names: np.ndarray  # spellings, one after another

    @classmethod
    def of(cls, chunk: Chunk) -> Segment:
        start, end, n = words_of(chunk, NOT_ALNUM)
        h = word_hashes(chunk, start, end, LOWER)
        order = np.argsort(h, kind="stable")
        h, doc = h[order], np.repeat(np.arange(chunk.n), n)[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        first = np.flatnonzero(new)
        new[1:] |= doc[1:] != doc[:-1]
        df = np.add.reduceat(new, first, dtype=np.int32) if len(first) else np.zeros(0, np.int32)
        s, e = start[order[first]], end[order[first]]
        return cls(n.astype(np.int64), h[first], np.diff(np.append(first, len(h))).astype(np.int32), order.astype(np.int32), df, (e - s).astype(np.int32), LOWER[chunk.data[ranges(s, e - s)]])

    def stored(self) -> list[bytes]:
        """As bytes, in the order of fields; positions as steps from the one before."""
        steps = np.diff(self.places, prepend=np.int32(0)).astype(np.int32)
        return [x.tobytes() for x in (self.n_words, self.terms, self.size, steps, self.df, self.length, self.names)]

    @classmethod
    def loaded(cls, raw: list[bytes]) -> Segment:
        kinds = (np.int64, U64, np.int32, np.int32, np.int32, np.int32, np.uint8)
        n_words, terms, size, steps, df, length, names = (np.frombuffer(x, k) for x, k in zip(raw, kinds, strict=True))
        return cls(n_words, terms, size, np.cumsum(steps, dtype=np.int32), df, length, names)


class Queries:
    """A block of test items as runs of term numbers; a term number is a place in the block's sorted vocabulary."""

    def __init__(self, ids: list[int], texts: list[str], window: int):
        per_item, hashes, names, sizes = [], [np.zeros(0, U64)], [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)]
        for c in chunks_of(pa.array(texts, pa.string())):
            start, end, n = words_of(c, NOT_ALNUM)
            hashes.append(word_hashes(c, start, end, LOWER))
            names.append(LOWER[c.data[ranges(start, end - start)]])
            sizes.append(end - start)
            per_item += np.split(hashes[-1], np.cumsum(n)[:-1])
        h, size = np.concatenate(hashes), np.concatenate(sizes)
        self.vocabulary, first = np.unique(h, return_index=True)
        self.length = size[first]
        self.names = np.concatenate(names)[ranges((np.cumsum(size) - size)[first], self.length)]
        runs: dict[tuple[int, ...], list[int]] = {}  # distinct word sequences and the items that have them
        for item, own in zip(ids, per_item, strict=True):
            if len(own):
                runs.setdefault(tuple(np.searchsorted(self.vocabulary, own).tolist()), []).append(item)
        self.items = list(runs.values())
        n = np.array([len(x) for x in runs], np.int64)
        self.seq = np.array([t for x in runs for t in x], np.int64)
        self.begin, self.end = np.cumsum(n) - n, np.cumsum(n)
        count = np.maximum(n - window + 1, 1)
        self.start = ranges(self.begin, count).astype(np.int64)  # of each window in seq
        self.run = np.repeat(np.arange(len(n)), count)
        self.size = np.minimum(n, window)[self.run]
        self.offsets = np.arange(window)
        self.picks = np.zeros((0, 0), np.int64)

    def pick(self, df: np.ndarray, rarest: int) -> None:
        """The rarest terms of each run, by documents and then by spelling; terms that no document holds are passed over."""
        ends = np.cumsum(self.length)
        spelled = [self.names[a:b].tobytes() for a, b in zip((ends - self.length).tolist(), ends.tolist(), strict=True)]
        self.picks = np.full((len(self.items), rarest), -1, np.int64)
        for k, (a, b) in enumerate(zip(self.begin.tolist(), self.end.tolist(), strict=True)):
            terms = np.unique(self.seq[a:b])
            held = sorted(terms[df[terms] > 0].tolist(), key=lambda t: (int(df[t]), spelled[t]))[:rarest]
            if len(held) >= min(rarest, len(terms)):
                self.picks[k, : len(held)] = held


class Lists:
    """The position lists of a block's terms in one segment, as one sorted array of (term number, position)."""

    def __init__(self, own: Segment, q: Queries):
        self.own, self.q = own, q
        self.begin = np.concatenate([[0], np.cumsum(own.n_words)])
        at = np.minimum(np.searchsorted(own.terms, q.vocabulary), max(len(own.terms) - 1, 0))
        known = np.flatnonzero(own.terms[at] == q.vocabulary) if len(own.terms) else np.zeros(0, np.int64)
        known = known[own.length[at[known]] == q.length[known]]
        if len(known):  # the spellings, not only the hashes
            size = q.length[known]
            mine = own.names[ranges((np.cumsum(own.length, dtype=np.int64) - own.length)[at[known]], size)]
            known = known[np.logical_and.reduceat(mine == q.names[ranges((np.cumsum(q.length) - q.length)[known], size)], np.cumsum(size) - size)]
        self.count = np.zeros(len(q.vocabulary), np.int64)
        self.count[known] = own.size[at[known]]
        self.first = np.cumsum(self.count) - self.count
        first = np.cumsum(own.size, dtype=np.int64) - own.size
        self.place = own.places[ranges(first[at[known]], self.count[known])].astype(np.int64)
        self.key = np.repeat(known, self.count[known]) << 32 | self.place

    def after(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """The first entry of each term's list at or after a position."""
        return np.minimum(np.searchsorted(self.key, term << 32 | position), max(len(self.key) - 1, 0))

    def hold(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether each term's list holds a position."""
        return (position >= 0) & (self.key[self.after(term, np.maximum(position, 0))] == (term << 32 | np.maximum(position, 0)))

    def doc(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, position, "right") - 1

    def phrases(self) -> tuple[np.ndarray, np.ndarray]:
        """(window, position) of every occurrence of every window of the block."""
        q, out = self.q, []
        if not len(self.key) or not len(q.start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        cells = q.start[:, None] + q.offsets
        counts = np.where(q.offsets < q.size[:, None], self.count[q.seq[np.minimum(cells, len(q.seq) - 1)]], 1 << 60)
        live = np.flatnonzero(counts.min(1) > 0)
        rarest = counts[live].argsort(1, kind="stable")
        anchors, which = np.unique(q.start[live] + rarest[:, 0], return_inverse=True)
        by = np.argsort(which, kind="stable")  # windows of each anchor
        windows, first = np.bincount(which, minlength=len(anchors)), np.searchsorted(which[by], np.arange(len(anchors)))
        owner = np.searchsorted(q.end, anchors, "right")
        left, right = anchors > q.begin[owner], anchors + 1 < q.end[owner]
        n = self.count[q.seq[anchors]]
        done = np.cumsum(n)
        cut = np.searchsorted(done, np.arange(PAIRS, int(done[-1]) if len(done) else 0, PAIRS), "right")
        for part in np.split(np.arange(len(anchors)), np.unique(cut)):
            a = np.repeat(part, n[part])
            x = self.place[ranges(self.first[q.seq[anchors[part]]], n[part])]
            p = anchors[a]
            beside = ~left[a] & ~right[a]
            for side, has in ((1, right), (-1, left)):
                i = np.flatnonzero(has[a] & ~beside)
                beside[i] = self.hold(q.seq[p[i] + side], x[i] + side)
            a, x = a[beside], x[beside]
            w = by[ranges(first[a], windows[a])]
            at = np.repeat(x - anchors[a], windows[a]) + q.start[live[w]]
            size = q.size[live[w]]
            ok = (at >= 0) & (at + size <= self.begin[-1])
            w, at, size = w[ok], at[ok], size[ok]
            ok = self.doc(at) == self.doc(at + size - 1)
            w, at = w[ok], at[ok]
            for k in range(1, len(q.offsets)):
                off = rarest[w, k]
                inside = np.flatnonzero(off < q.size[live[w]])
                ok = np.ones(len(w), bool)
                ok[inside] = self.hold(q.seq[q.start[live[w[inside]]] + off[inside]], at[inside] + off[inside])
                w, at = w[ok], at[ok]
            out.append((live[w], at))
        w, at = zip(*out, strict=True)
        return np.concatenate(w), np.concatenate(at)

    def near(self, within: int) -> tuple[np.ndarray, np.ndarray]:
        """(run of items, position of its rarest term) where all its picks stand at most `within` words away in the same document."""
        picks = self.q.picks
        some = np.flatnonzero((np.where(picks >= 0, self.count[picks], 1) > 0).all(1) & (picks[:, 0] >= 0)) if picks.size and len(self.key) else np.zeros(0, np.int64)
        n = self.count[picks[some, 0]] if len(some) else some
        run, x = np.repeat(some, n), self.place[ranges(self.first[picks[some, 0]], n)] if len(some) else some
        for k in range(1, picks.shape[1]):
            t, d = picks[run, k], self.doc(x)
            lo, hi = np.maximum(x - within, self.begin[d]), np.minimum(x + within, self.begin[d + 1] - 1)
            ok = t < 0
            i = np.flatnonzero(~ok)
            got = self.key[self.after(t[i], lo[i])]
            ok[i] = (got >= (t[i] << 32 | lo[i])) & (got <= (t[i] << 32 | hi[i]))
            run, x = run[ok], x[ok]
        return run, x


PARTS = ["n_words", "terms", "size", "places", "df", "length", "names"]
INDEX = "segment long, doc_id array<long>, " + ", ".join(f"{x} binary" for x in PARTS)


def index(docs: DataFrame, folder: str) -> DataFrame:
    """The stored positional index of docs (doc_id, text): one row a segment.  Later sessions read it again from folder/index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks_of(column(b, "text"), SEGMENT_BYTES):
                keys = column(b, "doc_id").slice(c.rows.start, c.n)
                parts = [pa.array([x], pa.binary()) for x in Segment.of(c).stored()]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, c.n], pa.int32()), pa.concat_arrays([keys])), *parts], ["doc_id", *PARTS])

    ship(docs.sparkSession)
    rows = docs.select("doc_id", "text").mapInArrow(run, INDEX.replace("segment long, ", ""))
    # Small row groups: writers and readers hold one whole, and a row is some megabytes.
    rows.select(F.monotonically_increasing_id().alias("segment"), "*").write.option("parquet.block.size", ROW_GROUP).option("compression", "zstd").parquet(f"{folder}/index")
    return docs.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


def segments(b: pa.RecordBatch) -> Iterator[tuple[int, Segment]]:
    for k in range(b.num_rows):
        yield k, Segment.loaded([column(b, x)[k].as_buffer() for x in PARTS])


def block_count(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """In how many blocks the items travel."""
    return int(items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // block_bytes) + 1


def blocks(items: DataFrame, n: int) -> Iterator[tuple[list[int], list[str]]]:
    """The items (item_id, text) in n blocks of about one size, each taken from the table when it is asked for, so that the driver holds one at a time."""
    items = items.select("item_id", "text").where("item_id is not null and text is not null")
    for k in range(n):
        rows = (items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)).collect()
        yield [r.item_id for r in rows], [r.text for r in rows]


def document_counts(own: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """Documents of the whole index that hold each term of a block.  Reads terms and their counts only."""
    sent = own.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(sent.value), np.int64)
        for b in batches:
            for terms, df in zip(column(b, "terms"), column(b, "df"), strict=True):
                terms, df = np.frombuffer(terms.as_buffer(), U64), np.frombuffer(df.as_buffer(), np.int32)
                at = np.minimum(np.searchsorted(terms, sent.value), max(len(terms) - 1, 0))
                if len(terms):
                    n += np.where(terms[at] == sent.value, df[at], 0)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["term", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    for r in own.select("terms", "df").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r.term] = r.n
    sent.unpersist()
    return out


SPANS = "segment long, nth int, doc_id long, n_words long, spans array<int>, items array<long>, near array<long>, near_places array<int>"


def lists(rows: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    """Values by row (ascending) as n lists."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)), pa.array(np.ascontiguousarray(values)))


def answers(own: Segment, q: Queries, within: int) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """(document, start, end) of the merged hits, (document, item) that hit, (document, item, places) nearby; each by document."""
    lists_ = Lists(own, q)
    w, at = lists_.phrases()
    hit = covered(at, q.size[w], int(lists_.begin[-1]))
    wall = np.zeros(len(hit) + 1, bool)  # spans end with their document
    wall[lists_.begin] = True
    before, after = np.concatenate([[False], hit[:-1]]), np.concatenate([hit[1:], [False]])
    start, end = np.flatnonzero(hit & (~before | wall[:-1])), np.flatnonzero(hit & (~after | wall[1:])) + 1
    d = lists_.doc(start)

    def by_item(doc: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pair, n = np.unique(np.stack([doc, run], 1), axis=0, return_counts=True)
        each = [(d, i, k) for (d, r), k in zip(pair.tolist(), n.tolist(), strict=True) for i in q.items[r]]
        return tuple(np.array([x[j] for x in each], np.int64) for j in range(3))

    run, x = lists_.near(within)
    hit_doc, hit_item, _ = by_item(lists_.doc(at), q.run[w])
    return (d, start - lists_.begin[d], end - lists_.begin[d]), (hit_doc, hit_item), by_item(lists_.doc(x), run)


def search(own: DataFrame, q: Queries, within: int = WITHIN, hits_only: bool = False) -> DataFrame:
    """For every document of an index (hits_only: for those with any): words, merged spans (start, end, start, end, ...) that windows hit, items that hit, items whose rarest terms are near."""
    sent = own.sparkSession.sparkContext.broadcast(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, part in segments(b):
                n = len(part.n_words)
                (d, s, e), (hit_doc, item), (near_doc, near, places) = answers(part, sent.value, within)
                out = pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, column(b, "segment")[k].as_py())), pa.array(np.arange(n, dtype=np.int32)), column(b, "doc_id")[k].values, pa.array(part.n_words),
                        lists(np.repeat(d, 2), np.stack([s, e], 1).reshape(-1).astype(np.int32), n), lists(hit_doc, item, n), lists(near_doc, near, n), lists(near_doc, places.astype(np.int32), n),
                    ],
                    ["segment", "nth", "doc_id", "n_words", "spans", "items", "near", "near_places"],
                )
                if hits_only:
                    some = np.zeros(n, bool)
                    some[d] = some[near_doc] = True
                    out = out.filter(pa.array(some))
                yield out

    return own.mapInArrow(run, SPANS)


def prepared(own: DataFrame, ids: list[int], texts: list[str], window: int, rarest: int) -> Queries:
    q = Queries(ids, texts, window)
    q.pick(document_counts(own, q.vocabulary), rarest)
    return q


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, rarest: int = RAREST, within: int = WITHIN) -> DataFrame:
    """search() of all items over an index of docs: one row for every row of docs.

    With several blocks each is searched and written on its own, hits only, and one block's
    broadcast is given up before the next; the hits then meet their documents by segment and row.
    """
    folder = shared_dir(docs.sparkSession)
    own, n = index(docs, folder), block_count(items, block_bytes)
    if n == 1:
        return search(own, prepared(own, *next(blocks(items, 1)), window, rarest), within)
    found = None
    for k, part in enumerate(blocks(items, n)):
        one = stored(search(own, prepared(own, *part, window, rarest), within, hits_only=True), folder, f"hits-{k}")
        found = one if found is None else found.unionByName(one)
    flat = [F.flatten(F.collect_list(x)).alias(x) for x in ("spans", "items", "near", "near_places")]
    every = search(own, Queries([], [], window), within).select("segment", "nth", "doc_id", "n_words")
    return every.join(found.groupBy("segment", "nth").agg(*flat), ["segment", "nth"], "left").select(*every.columns, *[F.coalesce(x, F.array()).cast(kind).alias(x) for x, kind in (("spans", "array<int>"), ("items", "array<long>"), ("near", "array<long>"), ("near_places", "array<int>"))])


def proximity(docs: DataFrame, items: DataFrame, rarest: int = RAREST, within: int = WITHIN) -> DataFrame:
    """doc_id, item_id, n_near: places where an item's `rarest` least frequent terms stand within `within` words.

    Frequency is the number of documents of the whole table; terms that no document holds are
    passed over.  Places are those of the least frequent term.
    """
    each = F.explode(F.arrays_zip("near", "near_places")).alias("x")
    return matches(docs, items, rarest=rarest, within=within).select("doc_id", each).select("doc_id", F.col("x.near").alias("item_id"), F.col("x.near_places").cast("long").alias("n_near"))


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, that hold no window of any item.

    Items of one block are looked for where the rows are read.  More blocks go one after the other:
    each leaves the ids and text hashes of the rows that it hits in the shared folder, and its
    broadcast is given up; the rows that none hit are returned.
    """
    n, spark = block_count(items, block_bytes), docs.sparkSession

    def hits(b: pa.RecordBatch, q: Queries) -> np.ndarray:
        hit = np.zeros(b.num_rows, bool)
        for c in chunks_of(column(b, "text"), STAGE_BYTES):
            own = Lists(Segment.of(c), q)
            hit[c.rows.start + own.doc(own.phrases()[1])] = True
        return hit

    if n == 1:
        sent = spark.sparkContext.broadcast(Queries(*next(blocks(items, 1)), window))

        def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(~hits(b, sent.value)))

        return docs.mapInArrow(rest, docs.schema)
    ship(spark)
    folder, keyed, found = shared_dir(spark), docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("k"), "text"), None
    for i, part in enumerate(blocks(items, n)):
        sent = spark.sparkContext.broadcast(Queries(*part, window))

        def some(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(hits(b, sent.value))).select(["d", "k"])

        one = stored(keyed.mapInArrow(some, "d long, k long").distinct(), folder, f"hits-{i}")
        sent.destroy()
        found = one if found is None else found.unionByName(one)
    found = found.distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(found["d"]) & (F.xxhash64(docs["text"]) == found["k"])
    return docs.join(found, same, "left_anti")


def report(found: DataFrame) -> DataFrame:
    """Digest of matches(): merges the spans of a document's blocks and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit, n_items, sha, n_near = [], [], [], []
            for spans, items, near in zip(*(column(b, x).to_pylist() for x in ("spans", "items", "near")), strict=True):
                total, upto = 0, 0
                for s, e in sorted(zip(spans[::2], spans[1::2], strict=True)):
                    total, upto = total + max(0, e - max(s, upto)), max(upto, e)
                names = sorted({str(x) for x in items})
                hit.append(total)
                n_items.append(len(names))
                sha.append(hashlib.sha256(",".join(names).encode()).hexdigest())
                n_near.append(len(set(near)))
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), column(b, "n_words"), pa.array(hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(sha, pa.string()), pa.array([x > 0 for x in hit], pa.bool_()), pa.array(n_near, pa.int64())], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near"])

    return found.mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, n_near long")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + 9], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
size AS (SELECT DISTINCT k FROM win),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, size WHERE len(w) >= k)),
m AS (SELECT doc_id, item_id, dw.k, i FROM dw JOIN win ON dw.s = win.s AND dw.k = win.k),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
place AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
df AS (SELECT x, count(DISTINCT doc_id) AS n FROM place GROUP BY x),
term AS (SELECT DISTINCT item_id, unnest(w) AS x FROM b),
rare AS (SELECT item_id, x, row_number() OVER (PARTITION BY item_id ORDER BY n, x) AS r, count(*) OVER (PARTITION BY item_id) AS held FROM term JOIN df USING (x)),
pick AS (SELECT item_id, x, r, least(3, held) AS k FROM rare JOIN (SELECT item_id, least(3, count(*)) AS need FROM term GROUP BY item_id) USING (item_id) WHERE r <= 3 AND held >= need),
centre AS (SELECT item_id, doc_id, p, k FROM pick JOIN place USING (x) WHERE r = 1),
together AS (SELECT c.item_id, c.doc_id, c.p, c.k, count(DISTINCT pick.r) AS n FROM centre c JOIN pick ON pick.item_id = c.item_id JOIN place ON place.x = pick.x AND place.doc_id = c.doc_id AND abs(place.p - c.p) <= 10 GROUP BY ALL),
close AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM together WHERE n = k GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN close USING (doc_id)
"""
