"""MinHash near-duplicate detection.

Method.  One-permutation hashing: a document's distinct word shingles are hashed once and dealt
to BINS bins by their high bits; a bin keeps its least hash; empty bins copy from bins chosen
by a second hash until a full one is met (optimal densification).  BANDS bands of ROWS bins are
bucket keys.  Within a bucket candidate edges form a star: its most central document (the one with the
most company over all its buckets) against every other.  Edges are confirmed on the full sets.
Members of a centre's buckets that stay outside its component are then held against the other
members, block by block, so no link is lost to the star.  Documents with equal sets (128-bit digest) are one
representative from the start, so copies never meet in pairs.

Misses: two sets with a Jaccard similarity of 0.85 share no band with probability 2e-8.

Cases: null and empty texts, and texts of white space, have no shingles and link with nothing;
very long texts are hashed whole; rows that share a doc_id count as one document for linking;
rows without a doc_id link with nothing and are kept; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .common import CHUNK_BYTES, LARGE_GROUPS, LOWER, SMALL_BATCH_BYTES, SPACES, STAGE_BYTES, U64, Chunk, chunks_of, column, ints, mix, read, shared_dir, ship, signed, stored, window_hash, with_parts, word_hashes, words_of
from .components import components

ROWS = 5
BANDS = 30
BINS = ROWS * BANDS
BLOCK = 256
BLOCK_SHINGLES = 1 << 20
FAN = 1024  # partners that meet a hub's set in one part
PROBES = np.random.default_rng(23).integers(0, BINS, (4096, BINS))


def shingle_sets(c: Chunk, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and their number by text."""
    start, end, n = words_of(c, SPACES)
    h = word_hashes(c, start, end, LOWER)
    doc = np.repeat(np.arange(c.n), n)
    w = window_hash(h, words)
    inside = doc[: len(w)] == doc[words - 1 : words - 1 + len(w)]
    out, owner = [w[inside]], [doc[: len(w)][inside]]
    at = np.concatenate([[0], np.cumsum(n)])
    for k in range(1, words):  # short texts: the whole sequence is the shingle
        own = np.flatnonzero(n == k)
        if len(own):
            x = np.full(len(own), U64(k * 0x51ED27 + 1))
            for j in range(k):
                x = mix(x * U64(0xD6E8FEB86659FD93) + h[at[own] + j])
            out.append(x)
            owner.append(own)
    x, d = np.concatenate(out), np.concatenate(owner)
    order = np.lexsort((x, d))
    x, d = x[order], d[order]
    first = np.ones(len(x), bool)
    first[1:] = (x[1:] != x[:-1]) | (d[1:] != d[:-1])
    x, d = x[first], d[first]
    return x, np.bincount(d, minlength=c.n)


def one_permutation(sets: np.ndarray, n: np.ndarray) -> np.ndarray:
    """texts x BINS least hashes, densified; rows without shingles are all ones."""
    doc = np.repeat(np.arange(len(n)), n)
    bins = ((sets >> U64(32)) * U64(BINS) >> U64(32)).astype(np.int64)
    first = np.ones(len(sets), bool)
    first[1:] = (bins[1:] != bins[:-1]) | (doc[1:] != doc[:-1])
    empty = U64(0xFFFFFFFFFFFFFFFF)
    sig = np.full((len(n), BINS), empty)
    sig[doc[first], bins[first]] = sets[first]
    full = sig != empty
    single = np.flatnonzero(full.sum(1) == 1)
    if len(single):
        sig[single] = sig[single].min(1, keepdims=True)
        full[single] = True
    r, b = np.nonzero(~full & (n > 0)[:, None])
    for probe in PROBES:
        if not len(r):
            break
        source = probe[b]
        ok = full[r, source]
        sig[r[ok], b[ok]] = sig[r[ok], source[ok]]
        r, b = r[~ok], b[~ok]
    if len(r):
        sig[r, b] = sig[r].min(1)
    return sig


def bands(sig: np.ndarray) -> np.ndarray:
    out = np.empty((len(sig), BANDS), U64)
    for k in range(BANDS):
        x = np.full(len(sig), U64(k + 1))
        for j in range(ROWS):
            x = mix(x * U64(0xD6E8FEB86659FD93) + sig[:, k * ROWS + j])
        out[:, k] = x
    return out


def signatures(docs: DataFrame, words: int, chunk: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n, h1, h2 (digest of the set), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = column(b, "doc_id")
            for c in chunks_of(column(b, "text"), chunk):
                sets, n = shingle_sets(c, words)
                at = np.concatenate([[0], np.cumsum(n)])
                sums = [np.concatenate([np.zeros(1, U64), np.cumsum(mix(sets ^ U64(k)))]) for k in (0x1234567, 0x89ABCDEF)]
                h1, h2 = (x[at[1:]] - x[at[:-1]] for x in sums)
                sig = one_permutation(sets, n)
                keyed = signed(np.ascontiguousarray(bands(sig))).reshape(-1)
                has = n > 0
                off = np.concatenate([[0], np.cumsum(np.where(has, BANDS, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [keys[c.rows], pa.array(n.astype(np.int64)), pa.array(signed(h1)), pa.array(signed(h2)), pa.ListArray.from_arrays(pa.array(off), pa.array(keyed[np.repeat(has, BANDS)]))],
                    ["doc_id", "n", "h1", "h2", "bands"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, h1 long, h2 long, bands array<long>")


def sets_of(docs: DataFrame, ids: DataFrame, words: int, folder: str, chunk: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, set (its sorted shingle hashes as bytes) of the documents in ids, stored.  A bitmap of bounded size keeps most others out of the shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(bloom.build(ids.select("doc_id"), "doc_id", mixed=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(bloom.contains(sent.value, mix(ints(b, "doc_id").astype(np.int64).view(np.uint64)))))
            for c in chunks_of(column(b, "text"), chunk):
                sets, n = shingle_sets(c, words)
                off = np.concatenate([[0], np.cumsum(8 * n)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([column(b, "doc_id").slice(c.rows.start, c.n), pa.Array.from_buffers(pa.binary(), c.n, [None, pa.py_buffer(off), pa.py_buffer(sets)])], ["doc_id", "set"])

    near = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "doc_id long, set binary")
    return stored(near.join(ids, "doc_id", "left_semi"), folder, "sets")


def among(keyed: DataFrame, common: DataFrame) -> DataFrame:
    """The rows of keyed whose key may be one of common's.  Most keys are one document's alone: a bitmap of bounded size keeps them out of the shuffle."""
    sent = keyed.sparkSession.sparkContext.broadcast(bloom.build(common, "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(bloom.contains(sent.value, ints(b, "key").astype(np.int64).view(np.uint64))))

    return keyed.mapInArrow(run, keyed.schema)


def hashes_of(cells: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), U64) for x in cells]


def confirm(pairs: DataFrame, own: DataFrame, percent: int, folder: str) -> DataFrame:
    """The pairs (u, v) whose full shingle sets have 100 * intersection >= percent * union; own: doc_id, set.

    A u with many partners is dealt to parts of FAN of them, and its set goes to each part once.
    """
    large = stored(pairs.groupBy("u").agg(F.ceil(F.count("*") / FAN).alias("parts")).where("parts > 1"), folder, "large-hubs")
    hubs = own.join(large.withColumnRenamed("u", "doc_id"), "doc_id", "left").select(F.col("doc_id").alias("u"), F.col("set").alias("su"), F.explode(F.sequence(F.lit(0), (F.coalesce("parts", F.lit(1)) - 1).cast("int"))).alias("part"))
    rows = with_parts(pairs, "u", "v", large).join(own.select(F.col("doc_id").alias("v"), F.col("set").alias("sv")), "v").join(hubs, ["u", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(hashes_of(column(b, "su")), hashes_of(column(b, "sv")), strict=True):
                at = np.minimum(np.searchsorted(y, x), max(len(y) - 1, 0))
                shared = int((y[at] == x).sum()) if len(y) else 0
                either = len(x) + len(y) - shared
                good.append(either > 0 and 100 * shared >= percent * either)
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([column(b, "u").filter(keep), column(b, "v").filter(keep)], ["u", "v"])

    return rows.select("u", "v", "su", "sv").mapInArrow(run, "u long, v long")


def rest_of(groups: DataFrame, own: DataFrame, percent: int, folder: str) -> DataFrame:
    """Links (u, v) between members of a hub's group in different components, one of them outside the hub's.

    groups: hub, doc_id, n, component, centre (the hub's component).  A group is dealt to blocks
    of about BLOCK members and BLOCK_SHINGLES shingles; a block with outsiders meets every block
    of its group, each meeting a task of bounded size that counts common shingles as a matrix
    product.  Rows meet their block's meetings, so no group is gathered; only links leave.
    """
    sizes = groups.groupBy("hub").agg(F.count("*").alias("size"), F.sum("n").alias("n"), F.max(F.col("component") != F.col("centre")).alias("open")).where("open and size > 1")
    sizes = stored(sizes.select("hub", F.ceil(F.greatest(F.col("size") / BLOCK, F.col("n") / BLOCK_SHINGLES)).alias("parts")), folder, "open-groups")
    dealt = with_parts(groups, "hub", "doc_id", sizes.where("parts > 1"), "block").select("hub", "block", "doc_id", "component", (F.col("component") != F.col("centre")).alias("out"))
    dealt = stored(dealt, folder, "dealt")
    away = dealt.where("out").select("hub", F.col("block").alias("a")).distinct()
    meetings = stored(away.join(sizes, "hub").select("hub", "a", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))).alias("b")), folder, "meetings")
    left = dealt.where("out").join(meetings.withColumn("block", F.col("a")), ["hub", "block"]).select("hub", "a", "b", "doc_id", "component", F.lit(0).alias("side"))
    right = dealt.join(meetings.withColumn("block", F.col("b")), ["hub", "block"]).select("hub", "a", "b", "doc_id", "component", F.lit(1).alias("side"))
    met = left.unionByName(right).join(own, "doc_id")

    def run(t: pa.Table) -> pa.Table:
        side, doc, comp = (t.column(x).to_numpy() for x in ("side", "doc_id", "component"))
        parts = hashes_of(t.column("set"))
        i, j = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        size = np.array([len(x) for x in parts])
        both = np.zeros((len(i), len(j)), np.float32)
        if len(i) and len(j):
            common = np.intersect1d(np.concatenate([parts[k] for k in i]), np.concatenate([parts[k] for k in j]))
            for lo in range(0, len(common), 4096):
                some = common[lo : lo + 4096]
                grid = [np.stack([np.isin(some, parts[k], assume_unique=True) for k in x]).astype(np.float32) for x in (i, j)]
                both += grid[0] @ grid[1].T
        either = size[i][:, None] + size[j][None, :] - both
        good = (100 * both >= percent * either) & (either > 0) & (comp[i][:, None] != comp[j][None, :])
        u, v = np.nonzero(good)
        return pa.table({"u": pa.array(np.minimum(doc[i[u]], doc[j[v]])), "v": pa.array(np.maximum(doc[i[u]], doc[j[v]]))})

    return met.groupBy("hub", "a", "b").applyInArrow(run, "u long, v long").distinct()


def members(sets: DataFrame, folder: str) -> DataFrame:
    """doc_id, rep (the smallest id with an equal set) of every row.  Classes of more than FAN go to all tasks, so that their rows stay where they are."""
    key = ["h1", "h2", "n"]
    classes = stored(sets.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("size")), folder, "classes")
    large = classes.where(F.col("size") > FAN).drop("size")
    if large.limit(LARGE_GROUPS + 1).count() > LARGE_GROUPS:
        return sets.join(classes, key).select("doc_id", "rep")
    rest = sets.join(F.broadcast(large), key, "left_anti").join(classes, key)
    return rest.select("doc_id", "rep").unionByName(sets.join(F.broadcast(large), key).select("doc_id", "rep"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, chunk: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    ship(spark, SMALL_BATCH_BYTES)
    folder = shared_dir(spark)
    all_rows = stored(signatures(docs, words, chunk), folder, "signatures")
    sets = all_rows.where("n > 0 and doc_id is not null")
    member = stored(members(sets.select("doc_id", "h1", "h2", "n"), folder).distinct(), folder, "members")
    reps = member.where("doc_id = rep").select("doc_id")
    keyed = stored(sets.select("doc_id", "n", "bands").join(reps, "doc_id", "left_semi").select("doc_id", "n", F.explode("bands").alias("key")), folder, "keys")
    common = stored(keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), folder, "common-keys", small=True)
    shared = stored(among(keyed, common).join(common, "key"), folder, "shared")
    central = shared.groupBy("doc_id").agg(F.sum("size").alias("degree"))
    hubs = shared.join(central, "doc_id").groupBy("key").agg(F.max(F.struct(F.col("degree"), (-F.col("doc_id")).alias("minus"))).alias("m")).select("key", (-F.col("m.minus")).alias("hub"))
    placed = stored(shared.join(hubs, "key"), folder, "placed")
    size = sets.select("doc_id", "n").groupBy("doc_id").agg(F.min("n").alias("n"))
    star = placed.where("doc_id <> hub").select(F.col("hub").alias("u"), F.col("doc_id").alias("v"), "n").distinct()
    star = star.join(size.select(F.col("doc_id").alias("u"), F.col("n").alias("nu")), "u")
    star = stored(star, folder, "star")
    own = sets_of(docs, stored(star.select(F.col("u").alias("doc_id")).unionByName(star.select(F.col("v").alias("doc_id"))).distinct(), folder, "candidates"), words, folder, chunk)
    links = stored(confirm(star.where(f"100 * least(n, nu) >= {percent} * greatest(n, nu)").select("u", "v"), own, percent, folder), folder, "links", small=True)
    found = components(links, folder, "star-cc")
    # Members of a hub's group outside the hub's component: what the star has not settled.
    of = found.withColumnRenamed("id", "doc_id")
    groups = star.select(F.col("u").alias("hub"), F.col("v").alias("doc_id"), "n").join(of, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    groups = groups.join(of.select(F.col("doc_id").alias("hub"), F.col("component").alias("centre")), "hub", "left").withColumn("centre", F.coalesce("centre", "hub"))
    more = stored(rest_of(stored(groups.select("hub", "doc_id", "n", "component", "centre"), folder, "groups"), own, percent, folder), folder, "more-links")
    if more.isEmpty():
        final = found
    else:
        final = components(found.select(F.col("component").alias("u"), F.col("id").alias("v")).unionByName(more), folder, "all-cc")
    of_rep = member.join(final.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    of_doc = of_rep.groupBy("doc_id").agg(F.min("component").alias("component"))
    out = all_rows.select("doc_id", F.col("n").alias("n_shingles")).join(of_doc, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept"))


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is not in ids.  Only rows that a bitmap of ids lets through are shuffled; the others stay where they are read."""
    ship(docs.sparkSession)
    ids = stored(ids.distinct(), shared_dir(docs.sparkSession), "removed")
    sent = docs.sparkSession.sparkContext.broadcast(bloom.build(ids, "doc_id", mixed=True))

    def part(inside: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                key = pc.fill_null(column(b, "doc_id"), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                yield b.filter(pa.array(bloom.contains(sent.value, mix(key.view(np.uint64))) == inside))

        return run

    return docs.mapInArrow(part(False), docs.schema).unionByName(docs.mapInArrow(part(True), docs.schema).join(ids, "doc_id", "left_anti").select(*docs.columns))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), words=3, percent=85, chunk=STAGE_BYTES)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
few AS (SELECT s FROM sh GROUP BY s HAVING count(*) > 1),
inter AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM (SELECT sh.* FROM sh JOIN few USING (s)) a JOIN (SELECT sh.* FROM sh JOIN few USING (s)) b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT u, v FROM inter JOIN n nu ON nu.doc_id = u JOIN n nv ON nv.doc_id = v WHERE 100 * k >= 85 * (nu.n + nv.n - k)),
both_ways AS (SELECT u, v FROM link UNION ALL SELECT v, u FROM link),
walk AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT walk.a, both_ways.v FROM walk JOIN both_ways ON walk.b = both_ways.u),
comp AS (SELECT a AS doc_id, min(b) AS c FROM walk GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, comp.c AS component_id, comp.c = w.doc_id AS kept FROM w LEFT JOIN n USING (doc_id) JOIN comp USING (doc_id)
"""
