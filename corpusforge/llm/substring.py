"""Substring deduplication by a log-structured index of window fingerprints.

Method.  A fingerprint is the hash of WINDOW consecutive words: 64 bits to find, and 64 more of
an independent hash that verify.  The index is a list of immutable runs, each holding the
earliest document of a fingerprint; a run is a Parquet table bucketed and sorted by fingerprint.
A new batch is shuffled once, to the runs' buckets, and merge-joined with every run where it
lies: history is never shuffled again.  What is new becomes a run; a window whose fingerprint has
an earlier document, or an earlier start in its own, is a repeat.  Runs are compacted into one,
bucket by bucket, when there are more than FANOUT.  A manifest names the runs, so that a later
session opens the index again and adds to it.  Batches are taken in ascending order of doc_id.

Most windows occur once.  Each window is tied to the least GRAM-word hash among its words
(winnowing: equal windows choose the same one); a window whose hash occurs once
cannot recur, so when the whole corpus is at hand, only the others are indexed.  That list of
recurring hashes reaches the scan as a bitmap of bounded size, which may let others through but
loses none.

Spans travel with a row's doc_id and a hash of its text, so rows that share a doc_id never get
each other's spans.

Cases: null and empty texts have no words; texts shorter than a window keep all; very long texts
are one document; rows that share a doc_id and text get one answer each, the same; rows that share
a doc_id but not a text are documents of their own, neither of which is the earlier one; an empty
table gives an empty result; extra columns are ignored; rows without a doc_id are
compared with themselves only.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bloom
from .common import BYTE_B, SPACES, U64, Chunk, chunks_of, column, covered, drop_dir, ints, mix, opened, read, shared_dir, ship, signed, stored, window_hash, word_hashes, words_of

WINDOW = 20
GRAM = 8
BATCHES = 4
FANOUT = 2
NONE = U64(0xFFFFFFFFFFFFFFFF)


def _layout(c: Chunk, window: int):
    start, end, n = words_of(c, SPACES)
    h = word_hashes(c, start, end)
    doc = np.repeat(np.arange(c.n), n)
    ok = doc[: max(0, len(h) - window + 1)] == doc[window - 1 :]
    return start, end, n, h, doc, ok


def _anchors(h: np.ndarray, doc: np.ndarray, ok: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Gram hashes by place (NONE across texts) and the places that some window chooses."""
    g = window_hash(h, GRAM)
    g = np.where(doc[: len(g)] == doc[GRAM - 1 :], g, NONE)
    valid = np.zeros(len(g), bool)
    valid[: len(ok)] = ok
    return g, opened(g, valid, window - GRAM + 1)


def recurring(docs: DataFrame, folder: str, window: int = WINDOW) -> DataFrame:
    """h: chosen gram hashes that stand in two documents, or twice in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks_of(column(b, "text")):
                _, _, _, h, doc, ok = _layout(c, window)
                g, at = _anchors(h, doc, ok, window)
                key, own = g[at], doc[at]
                order = np.lexsort((key, own))
                key, own = key[order], own[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
                i = np.flatnonzero(new)
                twice = np.diff(np.concatenate([i, [len(key)]])) > 1
                yield pa.RecordBatch.from_arrays([pa.array(signed(key[i])), pa.array(twice)], ["h", "twice"])

    seen = docs.select("text").mapInArrow(run, "h long, twice boolean")
    return stored(seen.groupBy("h").agg(F.count("*").alias("n"), F.max("twice").alias("twice")).where("n > 1 or twice").select("h"), folder, "recurring")


FINGERPRINT = "h long, v long, doc_id long, k long, at int, span int"


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, k (a hash of the text), text."""
    return docs.select("doc_id", F.xxhash64("text").alias("k"), "text")


def fingerprints(docs: DataFrame, bitmap: np.ndarray | None, window: int = WINDOW) -> DataFrame:
    """h, v, doc_id, k, at of each fingerprint's earliest document in a chunk of the scan (all texts of that doc_id).

    Only windows tied to hashes of the bitmap count, if there is one.  Later documents of the same
    chunk are repeats already: they come as rows with a span (words from at on), under a
    hash of their own.  So a window that very many documents share is one row a chunk.
    """
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pc.is_valid(column(b, "doc_id")))
            keys, hashes = ints(b, "doc_id"), ints(b, "k")
            for c in chunks_of(column(b, "text")):
                start, end, n, h, doc, ok = _layout(c, window)
                use = ok.copy()
                if sent.value is not None and len(ok):
                    g, at = _anchors(h, doc, ok, window)
                    live = at[bloom.contains(sent.value, g[at])]
                    reach = np.zeros(len(h) + 1, np.int32)
                    np.add.at(reach, np.maximum(live - (window - GRAM), 0), 1)
                    np.add.at(reach, live + 1, -1)
                    use &= np.cumsum(reach)[: len(ok)] > 0
                w = np.flatnonzero(use)
                f = window_hash(h, window)[w]
                v = window_hash(word_hashes(c, start, end, bytes_table=BYTE_B), window)[w]
                own, ids, ks = doc[w], keys[c.rows], hashes[c.rows]
                order = np.lexsort((w, ks[own], ids[own], v, f))
                f, v, own, w = f[order], v[order], own[order], w[order]
                new = np.ones(len(f), bool)
                new[1:] = (f[1:] != f[:-1]) | (v[1:] != v[:-1])
                least = ids[own[np.flatnonzero(new)[np.cumsum(new) - 1]]] if len(f) else ids[:0]
                later = np.flatnonzero(ids[own] > least)
                # Another text of the earliest doc_id is no repeat here, but may be one of an earlier chunk's.
                new[1:] |= (ids[own[1:]] == least[1:]) & (ks[own[1:]] != ks[own[:-1]])
                first = np.concatenate([[0], np.cumsum(n)])
                gone = np.sort(w[later])
                cut = np.ones(len(gone), bool)  # consecutive windows are one span
                cut[1:] = (gone[1:] != gone[:-1] + 1) | (doc[gone[1:]] != doc[gone[:-1]])
                i = np.flatnonzero(cut)
                size = np.diff(np.concatenate([i, [len(gone)]])) - 1 + window
                s, t = gone[i], doc[gone[i]]
                f, v, own, w = f[new], v[new], own[new], w[new]
                yield pa.RecordBatch.from_arrays([pa.array(signed(f)), pa.array(signed(v)), pa.array(ids[own]), pa.array(ks[own]), pa.array((w - first[own]).astype(np.int32)), pa.nulls(len(f), pa.int32())], ["h", "v", "doc_id", "k", "at", "span"])
                yield pa.RecordBatch.from_arrays([pa.array(signed(mix(ids[t].astype(np.int64).view(np.uint64) * U64(2654435761) + s.astype(U64)))), pa.array(np.full(len(s), -1, np.int64)), pa.array(ids[t]), pa.array(ks[t]), pa.array((s - first[t]).astype(np.int32)), pa.array(size.astype(np.int32))], ["h", "v", "doc_id", "k", "at", "span"])

    return keyed(docs).mapInArrow(run, FINGERPRINT)


class FingerprintIndex:
    """Immutable runs (h, v, first) below a folder, bucketed and sorted by fingerprint, and the manifest that names them.

    Cases: an empty batch adds an empty run; a batch given twice finds all of its windows in
    the same documents, so repeats nothing but what it repeated before; fingerprints that are null
    are left out; opening a folder without a manifest starts an empty index.
    """

    def __init__(self, spark: SparkSession, folder: str, window: int = WINDOW):
        self.spark, self.folder, self.window = spark, folder, window
        self.runs: list[str] = []
        self.made, self.buckets = 0, int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = "fingerprints_" + uuid.uuid4().hex

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> FingerprintIndex:
        """The index that an earlier session left in the folder."""
        own = cls(spark, folder)
        try:
            last = spark.read.json(f"{folder}/manifest-*").orderBy(F.desc("version")).first()
        except AnalysisException:  # no manifest yet
            return own
        own.made, own.buckets, own.window, own.runs = last.version, last.buckets, last.window, list(last.runs)
        return own

    def _note(self) -> None:
        self.spark.createDataFrame([(self.made, self.buckets, self.window, self.runs)], "version long, buckets int, window int, runs array<string>").coalesce(1).write.mode("overwrite").json(f"{self.folder}/manifest-{self.made}")

    def _table(self, run: str) -> DataFrame:
        """A run with its bucketing known to the planner."""
        name = f"{self.name}_{run.replace('-', '_')}"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (h BIGINT, v BIGINT, first BIGINT) USING parquet CLUSTERED BY (h, v) SORTED BY (h, v) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{run}'")
        return self.spark.table(name)

    def _write(self, rows: DataFrame) -> None:
        """rows (h, v, first), already dealt by fingerprint, as the next run."""
        self.made += 1
        run = f"run-{self.made}"
        self._table(run)
        rows.select("h", "v", "first").write.mode("append").format("parquet").bucketBy(self.buckets, "h", "v").sortBy("h", "v").saveAsTable(f"{self.name}_{run.replace('-', '_')}")
        self.runs.append(run)

    def append(self, batch: DataFrame) -> DataFrame:
        """Add fingerprints() of a batch; its repeats: doc_id, k, at, span.

        The batch is ranked and compared once and written; what is new goes from there to a run.
        """
        by = Window.partitionBy("h", "v").orderBy("doc_id", "at")
        dealt = batch.where("h is not null").repartition(self.buckets, "h", "v")
        ranked = dealt.withColumn("first", F.first("doc_id").over(by)).withColumn("nth", F.row_number().over(by)).withColumn("before", F.lit(None).cast("long"))
        for run in self.runs:
            past = self._table(run).withColumnRenamed("first", "past")
            ranked = ranked.join(past.hint("merge"), ["h", "v"], "left").withColumn("before", F.least("before", "past")).drop("past")
        repeat = F.col("span").isNotNull() | (F.col("doc_id") > F.least("first", F.coalesce("before", "first")))
        new = F.col("span").isNull() & (F.col("nth") == 1) & (F.col("before").isNull() | (F.col("before") > F.col("first")))
        rows = ranked.where(repeat | new).select(F.when(new, F.col("h")).alias("h"), F.when(new, F.col("v")).alias("v"), "doc_id", "k", F.when(repeat, F.col("at")).alias("at"), F.when(repeat, F.coalesce("span", F.lit(self.window))).alias("span"))
        whole = stored(rows, self.folder, f"batch-{self.made + 1}")
        self._write(whole.where("h is not null").select("h", "v", F.col("doc_id").alias("first")))
        self._note()
        return whole.where("at is not null").select("doc_id", "k", "at", "span")

    def compact(self) -> None:
        """Merge all runs into one, bucket by bucket; the old runs go once the manifest no longer names them."""
        if len(self.runs) < 2:
            return
        old, every = self.runs, None
        for run in old:
            own = self._table(run)
            every = own if every is None else every.unionByName(own)
        self.runs = []
        self._write(every.groupBy("h", "v").agg(F.min("first").alias("first")))
        self._note()
        for run in old:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{run.replace('-', '_')}")
            drop_dir(self.spark, f"{self.folder}/{run}")

    def close(self) -> None:
        """Take the runs' names out of the session's catalog; the files stay."""
        for run in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{run.replace('-', '_')}")


def remove(docs: DataFrame, repeats: DataFrame, folder: str, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the words left, joined by one space).

    Only texts with repeats are shuffled to meet them: a bitmap of bounded size of their hashes
    splits the scan, and the others are answered where they are read.
    """
    spans = stored(repeats.groupBy("doc_id", "k").agg(F.collect_list("at").alias("at"), F.collect_list("span").alias("span")), folder, "spans")
    sent = docs.sparkSession.sparkContext.broadcast(bloom.build(spans.select("k"), "k", mixed=True))

    def marked(b: pa.RecordBatch) -> np.ndarray:
        return bloom.contains(sent.value, mix(ints(b, "k").view(np.uint64)))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(marked(b)))

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(~marked(b)))
            none = pa.nulls(b.num_rows, pa.list_(pa.int32()))
            yield from answer(iter([pa.RecordBatch.from_arrays([column(b, "doc_id"), column(b, "text"), none, none], ["doc_id", "text", "at", "span"])]))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, hits, long = column(b, "doc_id"), column(b, "at"), column(b, "span")
            for c in chunks_of(column(b, "text")):
                start, end, n, h, doc, ok = _layout(c, window)
                first = np.concatenate([[0], np.cumsum(n)])
                part = hits.slice(c.rows.start, c.n)
                size = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)
                far = np.asarray(pc.list_flatten(part)).astype(np.int64) + np.repeat(first[:-1], size)
                f = window_hash(h, window) if len(ok) else np.zeros(0, U64)
                w = np.flatnonzero(ok)
                order = np.lexsort((w, f[w], doc[w]))  # a later start in the same document
                w = w[order]
                again = np.zeros(len(w), bool)
                again[1:] = (f[w[1:]] == f[w[:-1]]) & (doc[w[1:]] == doc[w[:-1]])
                twin = np.flatnonzero(again)
                if len(twin):  # verified by the second hash
                    v = window_hash(word_hashes(c, start, end, bytes_table=BYTE_B), window)
                    again[twin] = v[w[twin]] == v[w[twin - 1]]
                again = w[again]
                gone = covered(np.concatenate([far, again]), np.concatenate([np.asarray(pc.list_flatten(long.slice(c.rows.start, c.n))).astype(np.int64), np.full(len(again), window)]), len(h))
                total = np.concatenate([[0], np.cumsum(gone)])
                raw, left = c.raw, []
                starts, ends = start.tolist(), end.tolist()
                for i in range(c.n):
                    left.append(b" ".join([raw[starts[j] : ends[j]] for j in (np.flatnonzero(~gone[first[i] : first[i + 1]]) + first[i]).tolist()]))
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(c.rows.start, c.n), pa.array(n.astype(np.int64)), pa.array(total[first[1:]] - total[first[:-1]]), pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string()), pa.array(left, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
                )

    out, own = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string", keyed(docs)
    with_spans = own.mapInArrow(some, "doc_id long, k long, text string").join(spans, ["doc_id", "k"], "left").select("doc_id", "text", "at", "span").mapInArrow(answer, out)
    return own.mapInArrow(rest, out).unionByName(with_spans)


def deduplicate(docs: DataFrame, window: int = WINDOW, batches: int = BATCHES) -> DataFrame:
    """remove() after the documents have passed through an index in `batches` ranges of doc_id."""
    spark = docs.sparkSession
    ship(spark)
    folder = shared_dir(spark)
    bitmap = bloom.build(recurring(docs, folder, window))
    found = docs.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()[0] or []
    cuts = sorted(set(found))
    index, repeats = FingerprintIndex(spark, folder, window), None
    for lo, hi in zip([None, *cuts], [*cuts, None], strict=True):
        part = docs
        if lo is not None:
            part = part.where(F.col("doc_id") > lo)
        if hi is not None:
            part = part.where(F.col("doc_id") <= hi)
        again = index.append(fingerprints(part, bitmap, window))
        repeats = again if repeats is None else repeats.unionByName(again)
        if len(index.runs) > FANOUT:
            index.compact()
    index.close()
    return remove(docs, repeats, folder, window)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(read(spark, sf_dir, "documents")).drop("kept")


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM rep)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM w),
kept AS (SELECT word.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY word.p) AS s FROM word ANTI JOIN gone ON gone.doc_id = word.doc_id AND gone.p = word.p GROUP BY word.doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
