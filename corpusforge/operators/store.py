"""Stored chunks: a Parquet folder partitioned by collection and document bucket, with its mutations.

Collection filters prune partitions, a document's rows lie in one bucket, and within it files are
sorted by document and carry least and greatest values and Bloom filters of the columns that are
looked up, so that row groups are skipped.  Every mutation touches the partitions of its rows
alone.  The number of buckets follows the size that a store is written with, and is read off its
folders after that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import pruning, settled

#: Rows of a bucket, about; and buckets of a store at least and at most.
BUCKET_ROWS, FEWEST, MOST = 1_000_000, 4, 65_536
PARTITIONS = ["kb", "bucket"]
#: Columns with a Bloom filter for each row group, where a store has them.
LOOKED_UP = ("doc_id", "modality", "page", "region_type")
NAME = "_buckets-"


def bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))


def buckets_for(n: int) -> int:
    """A power of two that holds n rows in buckets of about BUCKET_ROWS."""
    wanted = max(FEWEST, min(MOST, -(-n // BUCKET_ROWS)))
    return 1 << (wanted - 1).bit_length()


def _paths(spark: SparkSession, pattern: str) -> list[str]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return [f.getPath().getName() for f in found or []]


def buckets_of(spark: SparkSession, folder: str) -> int:
    """The number of buckets that a store was written with: part of the name of an empty file beside its partitions."""
    names = _paths(spark, f"{folder}/{NAME}*")
    if not names:
        raise ValueError(f"no store in {folder}")
    return int(names[0].removeprefix(NAME))


def _write(rows: DataFrame, folder: str, mode: str) -> None:
    """rows (with bucket) in files sorted by document, with what lets scans skip row groups."""
    known = [c for c in LOOKED_UP if c in rows.columns]
    order = [c for c in ("doc_id", "ordinal") if c in rows.columns]
    rows.sortWithinPartitions(*PARTITIONS, *order).write.mode(mode).option("partitionOverwriteMode", "dynamic").options(**pruning(*known)).partitionBy(*PARTITIONS).parquet(folder)


def create(rows: DataFrame, folder: str, buckets: int | None = None) -> None:
    """Write rows (kb, doc_id, ordinal and others) as a new store; an existing one is an error."""
    spark = rows.sparkSession
    if _paths(spark, f"{folder}/{NAME}*"):
        raise ValueError(f"a store is in {folder} already")
    n = buckets or buckets_for(rows.count())
    _write(bucketed(rows, n), folder, "errorifexists")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{NAME}{n}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path).close()


def read(spark: SparkSession, folder: str, columns: str) -> DataFrame:
    """All stored rows; columns is their schema, without the bucket."""
    return spark.read.schema(f"{columns}, bucket int").parquet(folder)


def insert_absent(spark: SparkSession, folder: str, new: DataFrame, columns: str) -> None:
    """Add the rows whose (kb, doc_id, ordinal) is not stored; of several with one key any one."""
    key = [*PARTITIONS, "doc_id", "ordinal"]
    fresh = bucketed(new, buckets_of(spark, folder)).dropDuplicates(key).join(read(spark, folder, columns).select(key), key, "left_anti")
    _write(settled(fresh), folder, "append")


def replace_documents(spark: SparkSession, folder: str, new: DataFrame, columns: str) -> None:
    """Stored rows of the documents in new give way to new's; other rows of their buckets are written again.

    The outcome is complete in the shared folder before any partition is exchanged.
    """
    new = bucketed(new, buckets_of(spark, folder))
    held = read(spark, folder, columns).join(new.select(PARTITIONS).distinct(), PARTITIONS, "left_semi")
    kept = held.join(new.select(*PARTITIONS, "doc_id").distinct(), [*PARTITIONS, "doc_id"], "left_anti")
    after = settled(kept.unionByName(new.select(held.columns)))
    _write(after, folder, "overwrite")


def delete_kb(spark: SparkSession, folder: str, kb: str) -> bool:
    """Drop a collection's partitions; whether there were any."""
    jvm = spark.sparkContext._jvm
    name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString("kb", kb)
    path = jvm.org.apache.hadoop.fs.Path(folder, name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
