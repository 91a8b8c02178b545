"""Exact substring deduplication over bytes by hash-compared suffix sorting.

Method.  Every 200-byte window holds a chosen gram of GRAM bytes (winnowing: equal windows choose
the same one).  Grams that occur once are set aside (through a bitmap of bounded size); each
other occurrence sends its context, the bytes that any window around the gram can reach, to the
task of its gram.  There the suffixes that start at the grams are merge-sorted.  Two suffixes are
compared by the length of their common extension, found by binary search over prefix polynomial
hashes, so a comparison takes a logarithmic number of steps.  Suffixes that start one byte
further left follow by a stable pass over that byte, and equal windows are always neighbours;
neighbours whose window hashes agree are verified byte by byte.

Contexts that repeat within a chunk of the scan are settled there and sent once.  A gram with
more than HOT contexts goes another exact way: its windows are counted by hash, with partial
sums before the shuffle, first by the core that a quarter of its windows share, so no task holds
such a group.

Spans travel with a key of their row, its doc_id and a hash of its text (without a doc_id: two
hashes of the text), so rows that share a doc_id never get each other's spans.

Cases: null and empty texts have no bytes; texts shorter than a window keep all; very long texts
are cut nowhere; overlapping repeats inside one text count; repeated rows (same doc_id and text)
are copies of each other; rows that share a doc_id but not a text, and rows without a doc_id, are
texts like any other; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .common import BASE, BASE_INV, BYTE_A, BYTE_B, U64, Chunk, chunks_of, column, covered, ints, mix, opened, powers, prefix, ranges, read, shared_dir, ship, signed, stored

WINDOW = 200
GRAM = 96
LEFT = WINDOW - GRAM  # bytes before the gram that a window can reach
WIDE = LEFT + WINDOW  # bytes of a context
CHUNK = 1 << 20
STEP = 1 << 16  # places hashed together
ROWS = 6144  # contexts sorted together, about
HOT = 32768
QUARTERS = 4
NONE = U64(0xFFFFFFFFFFFFFFFF)


def _grams(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The chosen places of a chunk and the hashes of the GRAM bytes there, worked out in blocks that fit a core's cache."""
    n, end = len(c.data) - GRAM + 1, c.starts + c.lens

    def across(size: int) -> np.ndarray:
        """Places from which so many bytes leave their text."""
        first = np.maximum(c.starts, end - size + 1)
        return ranges(first, end + 1 - first)

    cut, out = [across(GRAM), across(WINDOW)], []
    for k in range(0, n, STEP):
        lo, hi = max(0, k - LEFT), min(n, k + STEP + LEFT)
        pre = prefix(BYTE_A[c.data[lo : hi + GRAM - 1]], BASE)
        g = mix((pre[GRAM:] - pre[: hi - lo]) * powers(BASE_INV, hi - lo))
        off, outside = (x[np.searchsorted(x, lo) : np.searchsorted(x, hi)] - lo for x in cut)
        g[off] = NONE
        valid = np.ones(hi - lo, bool)
        valid[outside] = False
        at = opened(g, valid, LEFT + 1)
        at = at[(at >= k - lo) & (at < k + STEP - lo)]
        out.append((at + lo, g[at]))
    at, g = zip(*out, strict=True) if out else ([np.zeros(0, np.int64)], [np.zeros(0, U64)])
    return np.concatenate(at), np.concatenate(g)


def recurring(docs: DataFrame, folder: str) -> DataFrame:
    """h: chosen grams that occur more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks_of(column(b, "text"), CHUNK):
                h, n = np.unique(_grams(c)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(n > 1)], ["h", "twice"])

    seen = docs.select("text").mapInArrow(run, "h long, twice boolean")
    return stored(seen.groupBy("h").agg(F.count("*").alias("n"), F.max("twice").alias("twice")).where("n > 1 or twice").select("h"), folder, "recurring")


KEY = "struct<a:bigint,k:bigint>"
CONTEXT = f"h long, doc_id {KEY}, at int, left int, right int, context binary"


def key() -> Column:
    """What a row's spans are joined by, called doc_id in all tables of contexts and spans."""
    return F.struct(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit(7), "text")).alias("a"), F.xxhash64("text").alias("k"))


def contexts(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """Contexts of the grams in the bitmap.  Rows with a null context are settled windows: bytes at .. at + left of the document."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = column(b, "doc_id")
            for c in chunks_of(column(b, "text"), CHUNK):
                at, g = _grams(c)
                live = bloom.contains(sent.value, g)
                at, g, pre = at[live], g[live], prefix(BYTE_A[c.data], BASE)
                own = np.searchsorted(c.starts, at, "right") - 1
                lo = np.maximum(at - LEFT, c.starts[own])
                hi = np.minimum(at + WINDOW, c.starts[own] + c.lens[own])
                ctx = mix((pre[hi] - pre[lo]) * powers(BASE_INV, len(pre))[lo] + ((at - lo) * 1024 + (hi - at)).astype(U64))
                order = np.lexsort((at, ctx))
                first = np.ones(len(order), bool)
                first[1:] = ctx[order[1:]] != ctx[order[:-1]]
                head = order[np.flatnonzero(first)[np.cumsum(first) - 1]] if len(order) else order
                rest = order[~first]
                if len(rest):  # equal contexts: verified against the first of them
                    mate, size = head[~first], hi[rest] - lo[rest]
                    same = np.ones(len(rest), bool)
                    for k in range(0, len(rest), 4096):
                        part = slice(k, k + 4096)
                        step = np.arange(WIDE)[None, :]
                        inside = step < size[part, None]
                        x = c.data[np.where(inside, lo[rest[part], None] + step, 0)]
                        y = c.data[np.where(inside, lo[mate[part], None] + step, 0)]
                        same[part] = ((x == y) | ~inside).all(1) & (hi[mate[part]] - lo[mate[part]] == size[part])
                    done = np.unique(np.concatenate([rest[same], mate[same]]))
                    send = np.setdiff1d(np.arange(len(at)), rest[same])
                else:
                    done, send = rest, np.arange(len(at))
                done = done[hi[done] - lo[done] >= WINDOW]
                span = covered(lo[done], hi[done] - lo[done], len(c.data)) if len(done) else np.zeros(len(c.data), bool)
                span[(c.starts + c.lens)[:-1]] = False
                edge = np.flatnonzero(np.diff(np.concatenate([[0], span.view(np.int8), [0]])))
                s, e = edge[0::2], edge[1::2]
                keys_here = keys.slice(c.rows.start, c.n)
                for k in range(0, len(send), 4096):
                    i = send[k : k + 4096]
                    size = hi[i] - lo[i]
                    off = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                    flat = c.data[np.repeat(lo[i] - off[:-1], size) + np.arange(off[-1])]
                    text = pa.Array.from_buffers(pa.binary(), len(i), [None, pa.py_buffer(off), pa.py_buffer(flat.tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(signed(g[i])), keys_here.take(pa.array(own[i])), pa.array((at[i] - c.starts[own[i]]).astype(np.int32)), pa.array((at[i] - lo[i]).astype(np.int32)), pa.array((hi[i] - at[i]).astype(np.int32)), text], ["h", "doc_id", "at", "left", "right", "context"])
                if len(s):
                    z = pa.nulls(len(s), pa.binary())
                    t = np.searchsorted(c.starts, s, "right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(s), np.int64)), keys_here.take(pa.array(t)), pa.array((s - c.starts[t]).astype(np.int32)), pa.array((e - s).astype(np.int32)), pa.array(np.zeros(len(s), np.int32)), z], ["h", "doc_id", "at", "left", "right", "context"])

    return docs.select(key().alias("doc_id"), "text").mapInArrow(run, CONTEXT)


def padded(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts as a matrix of WIDE bytes, the gram at column LEFT; left and right lengths."""
    left, right = t.column("left").to_numpy().astype(np.int64), t.column("right").to_numpy().astype(np.int64)
    x = np.zeros((t.num_rows, WIDE), np.uint8)
    if not t.num_rows:
        return x, left, right
    parts = []
    for raw in t.column("context").chunks:
        off = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]
        parts.append(np.frombuffer(raw.buffers()[2] or b"", np.uint8)[off[0] : off[-1]])
    flat = np.concatenate(parts)
    col = np.arange(WIDE)[None, :]
    x[(col >= LEFT - left[:, None]) & (col < LEFT + right[:, None])] = flat
    return x, left, right


def prefix_rows(x: np.ndarray) -> np.ndarray:
    """Prefix hashes of every context: contexts x (WIDE + 1)."""
    pre = np.zeros((len(x), WIDE + 1), U64)
    np.cumsum(BYTE_A[x] * powers(BASE, WIDE)[None, :], axis=1, out=pre[:, 1:])
    return pre


class Suffixes:
    """Suffixes of contexts from the gram on, compared by prefix hashes."""

    def __init__(self, x: np.ndarray, pre: np.ndarray, group: np.ndarray):
        self.x, self.group = x, group
        self.own = pre[:, LEFT:] - pre[:, LEFT : LEFT + 1]  # hash of the first k bytes of the suffix

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes a and b, by binary search."""
        lo, step = np.zeros(len(a), np.int64), 128
        while step:
            to = np.minimum(lo + step, WINDOW)
            lo = np.where(self.own[a, to] == self.own[b, to], to, lo)
            step >>= 1
        return lo

    def less(self, a: np.ndarray, b: np.ndarray, ties: bool) -> np.ndarray:
        """Suffix a sorts before b (ties: or equals it)."""
        ext = self.common(a, b)
        at = np.minimum(ext, WINDOW - 1) + LEFT
        byte = self.x[a, at].astype(np.int16) - self.x[b, at]
        below = np.where(ext >= WINDOW, ties, byte < 0)
        ga, gb = self.group[a], self.group[b]
        return np.where(ga == gb, below, ga < gb)

    def sort(self) -> np.ndarray:
        """Bottom-up merge sort; all merges of a level run together, each element finds its rank in the other half by binary search."""
        n = len(self.x)
        order, width = np.arange(n), 1
        while width < n:
            i = np.arange(n)
            start = i // (2 * width) * (2 * width)
            mid, end = np.minimum(start + width, n), np.minimum(start + 2 * width, n)
            in_left = i < mid
            lo, hi = np.where(in_left, mid, start), np.where(in_left, end, mid)
            base = lo.copy()
            while True:
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                m = (lo[open_] + hi[open_]) >> 1
                mine, other = order[open_], order[m]
                left_side = in_left[open_]
                # left elements go before equal right ones
                go = np.where(left_side, ~self.less(mine, other, True), ~self.less(mine, other, False))
                lo[open_] = np.where(go, m + 1, lo[open_])
                hi[open_] = np.where(go, hi[open_], m)
            to = np.where(in_left, i + (lo - base), start + (i - mid) + (lo - base))
            new = np.empty_like(order)
            new[to] = order
            order, width = new, 2 * width
        return order


def repeated_offsets(x: np.ndarray, pre: np.ndarray, left: np.ndarray, right: np.ndarray, group: np.ndarray) -> np.ndarray:
    """contexts x (LEFT + 1): whether the window that starts d bytes before the gram repeats in the group."""
    order = Suffixes(x, pre, group).sort()
    out = np.zeros((len(x), LEFT + 1), bool)
    for d in range(LEFT + 1):
        if d:
            order = order[np.argsort(group[order] * 256 + x[order, LEFT - d], kind="stable")]
        live = order[(left[order] >= d) & (right[order] >= WINDOW - d)]
        a, b = live[:-1], live[1:]
        lo, hi = LEFT - d, LEFT - d + WINDOW
        same = (group[a] == group[b]) & (pre[a, hi] - pre[a, lo] == pre[b, hi] - pre[b, lo])
        a, b = a[same], b[same]
        ok = (x[a, lo:hi] == x[b, lo:hi]).all(1)
        out[a[ok], d] = True
        out[b[ok], d] = True
    return out


def runs_of(dup: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, farthest, nearest offset) of each run of repeated windows."""
    wall = np.zeros((len(dup), 1), np.int8)
    edge = np.diff(np.concatenate([wall, dup.view(np.int8), wall], axis=1), axis=1)
    row, first = np.nonzero(edge == 1)
    _, last = np.nonzero(edge == -1)
    return row, last - 1, first


SPAN = f"doc_id {KEY}, at int, left int"


def equal_contexts(pre: np.ndarray, x: np.ndarray, left: np.ndarray, right: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First context of each set of equal ones in a group, by context, and whether a context has an equal one (bytes compared)."""
    order = np.lexsort((pre[:, -1], right, left, group))
    same = np.zeros(len(order), bool)
    a, b = order[:-1], order[1:]
    same[1:] = (group[a] == group[b]) & (left[a] == left[b]) & (right[a] == right[b]) & (pre[a, -1] == pre[b, -1])
    head = order[np.flatnonzero(~same)[np.cumsum(~same) - 1]]
    i = np.flatnonzero(same)
    same[i] = (x[order[i]] == x[head[i]]).all(1)
    first, twice = np.arange(len(order)), np.zeros(len(order), bool)
    first[order[same]] = head[same]
    twice[order[same]] = twice[head[same]] = True
    return first, twice


def extension(pre: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, side: int) -> np.ndarray:
    """Bytes, `most` at most, in which contexts a and b agree to the right (side 1) or left (-1) of the gram's start: binary search over prefix hashes."""
    lo, step = np.zeros(len(a), np.int64), 1 << (WINDOW.bit_length() - 1)
    while step:
        to = np.minimum(lo + step, most)
        at = LEFT + side * to
        lo = np.where(pre[a, at] - pre[a, LEFT] == pre[b, at] - pre[b, LEFT], to, lo)
        step >>= 1
    return lo


def pair_windows(pre: np.ndarray, x: np.ndarray, left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For two contexts of one gram: the farthest left and the nearest offset of the windows that they share (nearest > farthest: none)."""
    back = extension(pre, a, b, np.minimum(left[a], left[b]), -1)
    ahead = extension(pre, a, b, np.minimum(right[a], right[b]), 1)
    col = np.arange(WIDE)[None, :]
    wrong = np.flatnonzero(((x[a] != x[b]) & (col >= LEFT - back[:, None]) & (col < LEFT + ahead[:, None])).any(1))
    for k in wrong.tolist():  # equal hashes of unequal bytes: the bytes decide
        differ = np.flatnonzero(x[a[k]] != x[b[k]])
        back[k] = min(back[k], LEFT - 1 - max(differ[differ < LEFT], default=LEFT - 1 - back[k]))
        ahead[k] = min(ahead[k], min(differ[differ >= LEFT], default=LEFT + ahead[k]) - LEFT)
    return np.minimum(back, LEFT), np.maximum(WINDOW - ahead, 0)


def sort_groups(t: pa.Table) -> pa.Table:
    """Spans of the contexts of some grams that repeat among them.

    Equal contexts share all their windows, so one of them stands for all; two different ones of
    a gram are extended to both sides from it; only grams with more are suffix-sorted.
    """
    h = t.column("h").to_numpy()
    _, group, n = np.unique(h, return_inverse=True, return_counts=True)
    t = t.filter(pa.array(n[group] > 1))
    if not t.num_rows:
        return pa.table({"doc_id": t.column("doc_id"), "at": pa.array([], pa.int32()), "left": pa.array([], pa.int32())})
    _, group = np.unique(t.column("h").to_numpy(), return_inverse=True)
    x, left, right = padded(t)
    pre = prefix_rows(x)
    first, twice = equal_contexts(pre, x, left, right, group)
    farthest, nearest = np.full(len(x), -1), np.zeros(len(x), np.int64)
    whole = np.flatnonzero(twice)
    farthest[whole], nearest[whole] = left[whole], np.maximum(WINDOW - right[whole], 0)
    heads = np.flatnonzero(first == np.arange(len(x)))
    heads = heads[np.argsort(group[heads], kind="stable")]
    kinds = np.bincount(group[heads])
    two = heads[kinds[group[heads]] == 2].reshape(-1, 2)
    back, near = pair_windows(pre, x, left, right, two[:, 0], two[:, 1])
    for own in (two[:, 0], two[:, 1]):  # a context that has an equal one is settled
        open_ = ~twice[own]
        farthest[own[open_]], nearest[own[open_]] = back[open_], near[open_]
    out = [(i := np.flatnonzero(farthest >= nearest), farthest[i], nearest[i])]
    many = heads[kinds[group[heads]] > 2]
    if len(many):
        row, far, near = runs_of(repeated_offsets(x[many], pre[many], left[many], right[many], group[many]))
        open_ = ~twice[many[row]]
        out.append((many[row[open_]], far[open_], near[open_]))
    row, far, near = (np.concatenate(z) for z in zip(*out, strict=True))
    at, doc = t.column("at").to_numpy().astype(np.int64), t.column("doc_id").combine_chunks()
    return pa.table({"doc_id": doc.take(pa.array(row)), "at": pa.array((at[row] - far).astype(np.int32)), "left": pa.array((far - near + WINDOW).astype(np.int32))})


def _hot_windows(hot: DataFrame, folder: str) -> DataFrame:
    """Spans of contexts of very common grams, by counting hashes: cores of a quarter of the offsets, then windows."""
    cut = [LEFT * k // QUARTERS for k in range(QUARTERS + 1)]

    def prefixes(x: np.ndarray) -> list[np.ndarray]:
        return [np.concatenate([np.zeros((len(x), 1), U64), np.cumsum(tab[x] * powers(BASE, WIDE)[None, :], axis=1)], axis=1) for tab in (BYTE_A, BYTE_B)]

    def cores(batches):
        for b in batches:
            for k in range(0, b.num_rows, 4096):
                part = pa.Table.from_batches([b.slice(k, 4096)])
                x, left, right = padded(part)
                for q in range(QUARTERS):
                    a, z = cut[q], cut[q + 1]
                    lo, hi = LEFT - a, LEFT - z + WINDOW
                    ok = (left >= a) & (right >= WINDOW - z)
                    core = mix((BYTE_A[x[:, lo:hi]] * powers(BASE, hi - lo)[None, :]).sum(1) + U64(q + 1))[ok]
                    got = part.filter(pa.array(ok))
                    yield from got.append_column("q", pa.array(np.full(got.num_rows, q, np.int32))).append_column("core", pa.array(signed(core))).combine_chunks().to_batches()

    dealt = stored(hot.mapInArrow(cores, CONTEXT + ", q int, core long"), folder, "hot-cores")
    often = dealt.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core")

    def windows(batches):
        for b in batches:
            for k in range(0, b.num_rows, 2048):
                part = pa.Table.from_batches([b.slice(k, 2048)])
                x, left, right = padded(part)
                q = part.column("q").to_numpy()
                pres = prefixes(x)
                at, doc = part.column("at").to_numpy(), part.column("doc_id").combine_chunks()
                for d in range(LEFT + 1):
                    i = np.flatnonzero((np.searchsorted(cut[1:-1], d, "right") == q) & (left >= d) & (right >= WINDOW - d))
                    if len(i):
                        inv = powers(BASE_INV, WIDE)[LEFT - d]
                        f, v = (mix((p[i, LEFT - d + WINDOW] - p[i, LEFT - d]) * inv) for p in pres)
                        yield pa.RecordBatch.from_arrays([pa.array(signed(f)), pa.array(signed(v)), doc.take(pa.array(i)), pa.array((at[i] - d).astype(np.int32))], ["f", "v", "doc_id", "at"])

    each = stored(dealt.join(often, "core", "left_semi").select("h", "doc_id", "at", "left", "right", "context", "q").mapInArrow(windows, f"f long, v long, doc_id {KEY}, at int"), folder, "hot-windows").distinct()
    twice = each.groupBy("f", "v").agg(F.count("*").alias("n")).where("n > 1")
    # Rows that repeat id and text send the same contexts; windows are counted by place, so those rows are told apart here.
    copies = hot.groupBy("doc_id", "at", "left", "right").agg(F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("left") + F.col("right") >= WINDOW))
    copies = copies.select("doc_id", (F.col("at") - F.col("left")).alias("at"), (F.col("left") + F.col("right")).alias("left"))
    return each.join(twice, ["f", "v"], "left_semi").select("doc_id", "at", F.lit(WINDOW).alias("left")).unionByName(copies)


def repeats(docs: DataFrame, folder: str, hot: int = HOT) -> DataFrame:
    """doc_id, at, left: byte spans (start, length) covered by windows that also start elsewhere."""
    bitmap = bloom.build(recurring(docs, folder))
    found = stored(contexts(docs, bitmap), folder, "contexts")
    settled = found.where("context is null").select("doc_id", "at", "left")
    open_ = found.where("context is not null")
    size = open_.select("h").groupBy("h").agg(F.count("*").alias("n"))
    common = stored(size.where(F.col("n") > hot).select("h"), folder, "hot-grams")
    total = open_.count()
    deal = F.pmod(F.xxhash64("h"), F.lit(max(1, -(-total // ROWS)))).cast("int")
    spans = settled
    if not common.isEmpty():
        spans = spans.unionByName(_hot_windows(open_.join(common, "h", "left_semi").select(*open_.columns), folder))
        open_ = open_.join(common, "h", "left_anti")
    sorted_ = open_.withColumn("bucket", deal).groupBy("bucket").applyInArrow(lambda t: sort_groups(t), SPAN)
    return spans.unionByName(sorted_)


def remove(docs: DataFrame, spans: DataFrame, folder: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept of every row.

    Only texts with spans are shuffled to meet them: a bitmap of bounded size of their hashes
    splits the scan, and the others are answered where they are read.
    """
    own = stored(spans.groupBy("doc_id").agg(F.collect_list("at").alias("s"), F.collect_list("left").alias("n")), folder, "spans")
    sent = docs.sparkSession.sparkContext.broadcast(bloom.build(own.select("doc_id.k"), "k", mixed=True))

    def marked(b: pa.RecordBatch) -> np.ndarray:
        return bloom.contains(sent.value, mix(ints(b, "k").view(np.uint64)))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(marked(b)))

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(~marked(b)))
            none = pa.nulls(b.num_rows, pa.list_(pa.int32()))
            yield from run(iter([pa.RecordBatch.from_arrays([column(b, "doc_id"), column(b, "text"), none, none], ["doc_id", "text", "s", "n"])]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, s, n = column(b, "doc_id"), column(b, "s"), column(b, "n")
            for c in chunks_of(column(b, "text")):
                s_part, n_part = s.slice(c.rows.start, c.n), n.slice(c.rows.start, c.n)
                count = pc.fill_null(pc.list_value_length(s_part), 0).to_numpy(zero_copy_only=False)
                at = np.asarray(pc.list_flatten(s_part)).astype(np.int64) + np.repeat(c.starts, count)
                gone = covered(at, np.asarray(pc.list_flatten(n_part)).astype(np.int64), len(c.data)) if len(at) else np.zeros(len(c.data), bool)
                size, runs, removed, sha, kept = c.lens, [], [], [], []
                for i in range(c.n):
                    part = slice(c.starts[i], c.starts[i] + size[i])
                    mark = gone[part]
                    left = c.data[part][~mark].tobytes()
                    kept.append(left)
                    sha.append(hashlib.sha256(left).hexdigest())
                    removed.append(int(mark.sum()))
                    runs.append(int((mark & ~np.concatenate([[False], mark[:-1]])).sum()))
                yield pa.RecordBatch.from_arrays([keys.slice(c.rows.start, c.n), pa.array(size), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out, plain = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary", docs.select("doc_id", "text", key()["a"].alias("a"), key()["k"].alias("k"))
    met = own.select(F.col("doc_id.a").alias("a"), F.col("doc_id.k").alias("k"), "s", "n")
    with_spans = plain.mapInArrow(some, "doc_id long, text string, a long, k long").join(met, ["a", "k"], "left").select("doc_id", "text", "s", "n").mapInArrow(run, out)
    return plain.mapInArrow(rest, out).unionByName(with_spans)


def deduplicate(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """remove() of every window of WINDOW bytes that also starts elsewhere."""
    ship(docs.sparkSession)
    folder = shared_dir(docs.sparkSession)
    return remove(docs, repeats(docs, folder, hot), folder)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(read(spark, sf_dir, "documents")).drop("kept")


ORACLE = r"""
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT doc_id, i, hash(substr(x, 2 * i + 1, 400)) AS s, hash('#' || substr(x, 2 * i + 1, 400)) AS s2 FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 199)) AS i FROM b WHERE length(x) >= 400)),
dup AS (SELECT doc_id, i FROM win JOIN (SELECT s, s2 FROM win GROUP BY s, s2 HAVING count(*) > 1) USING (s, s2)),
flag AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM dup),
run AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS z FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM flag) GROUP BY doc_id, r),
sums AS (SELECT doc_id, count(*) AS n, sum(z - a) AS k FROM run GROUP BY doc_id),
gap AS (SELECT doc_id, z AS a, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a), 1000000000) AS z FROM run UNION ALL SELECT doc_id, 0, min(a) FROM run GROUP BY doc_id),
kept AS (SELECT gap.doc_id, string_agg(substr(x, 2 * a + 1, 2 * (z - a)), '' ORDER BY a) AS y FROM gap JOIN b USING (doc_id) WHERE z > a GROUP BY gap.doc_id)
SELECT b.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(k, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(y, x))) AS kept_sha256 FROM b LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
