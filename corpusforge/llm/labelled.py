"""Labelled rows for the classifiers: the training fold, and a bounded sample of it."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labelled rows a class that a classifier is fitted on at most, and the longest text among them (bytes).
SAMPLE_ROWS = 1500
SAMPLE_BYTES = 1 << 16
#: Rows without a label that the label model of weak supervision sees at most.
UNLABELLED_ROWS = 1500
#: Bytes of text the driver takes for a class at most; rows beyond it (in hash order) are not used for fitting.
SAMPLE_TOTAL = 12 << 20


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no label may be learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def local(spark: SparkSession, **columns: tuple[pa.DataType, list]) -> DataFrame:
    """A small table of the driver's, sent as Arrow: rows of a list would go through Python workers of their own, which stay for a minute."""
    return spark.createDataFrame(pa.table({name: pa.array(x, kind) for name, (kind, x) in columns.items()}))


@dataclass
class Sample:
    texts: list[str]
    labels: list[int]
    share: float  # of label 1 among all rows of the training fold


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS, total_bytes: int = SAMPLE_TOTAL) -> Sample:
    """At most `rows` training rows of each class, chosen by hash of the id, with their whole texts.

    Labels that are null or contradict each other for one id are left out.  The chosen ids are
    at most 2 * rows, so they go to the scan as a broadcast.  Texts over SAMPLE_BYTES are left
    out; null texts count as empty; documents that share a labelled id all count, 4 * rows of both
    classes at most; an empty table gives an empty sample.
    """
    fold = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("most")).where("label = most").select("doc_id", "label")
    counts = {r.label: r["count"] for r in fold.groupBy("label").count().collect()}
    total = sum(counts.values())
    picked = None
    for value in (0, 1):
        one = fold.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        picked = one if picked is None else picked.unionByName(one)
    known = [(r.doc_id, r.label) for r in picked.collect()]
    spark, texts, out = docs.sparkSession, [], []
    if known:
        chosen = local(spark, doc_id=(pa.int64(), [i for i, _ in known]), label=(pa.int32(), [y for _, y in known]))
        found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES).join(F.broadcast(chosen), "doc_id")
        found = found.select("doc_id", "label", "text", F.xxhash64("doc_id").alias("rank"), F.octet_length("text").alias("size"), F.xxhash64("text").alias("h"))
        # Which rows fit is decided on their sizes (a few numbers a row); only those texts travel.
        sizes = found.drop("text").orderBy("rank", "doc_id", "h").limit(4 * rows).collect()
        used, last = {0: 0, 1: 0}, {}
        for r in sizes:
            used[r.label] += r.size
            if used[r.label] <= total_bytes:
                last[r.label] = (r.rank, r.doc_id, r.h)
        for value, (rank, doc, h) in sorted(last.items()):
            upto = (F.col("rank") < rank) | ((F.col("rank") == rank) & ((F.col("doc_id") < doc) | ((F.col("doc_id") == doc) & (F.col("h") <= h))))
            for r in found.where((F.col("label") == value) & upto).orderBy("rank", "doc_id", "h").select("text").toLocalIterator():
                texts.append(r.text)
                out.append(value)
    return Sample(texts, out, counts.get(1, 0) / total if total else 0.0)


def unlabelled(docs: DataFrame, labels: DataFrame, rows: int = UNLABELLED_ROWS, longest: int = SAMPLE_BYTES // 8) -> list[str]:
    """Texts of at most `rows` documents without a label, outside the held-out fold, chosen by hash of the id; texts over `longest` bytes, null and empty ones are left out."""
    some = docs.where(F.col("doc_id").isNotNull() & ~held_out() & F.octet_length("text").between(1, longest)).select("doc_id", F.xxhash64("doc_id").alias("rank"))
    ids = some.join(labels.select("doc_id").distinct(), "doc_id", "left_anti").orderBy("rank", "doc_id").limit(rows).distinct()
    picked = [r.doc_id for r in ids.collect()]
    if not picked:
        return []
    chosen = local(docs.sparkSession, doc_id=(pa.int64(), picked))
    found = docs.where(F.octet_length("text").between(1, longest)).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).orderBy("doc_id")
    return [r.text for r in found.collect()]
