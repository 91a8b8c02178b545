"""Shared vectorised text primitives: Arrow batches to byte buffers, word boundaries, polynomial hashes.

Every operator in this subpackage streams Arrow batches through numpy.  A batch is cut into
chunks of bounded size, a chunk holds whole texts, and the texts are joined by one space, so
no word or window crosses two of them unless the caller asks for it.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def _thrifty() -> None:
    """Give freed memory back to the system: an executor's Python workers live long, and share its memory with a JVM."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD: only larger arrays are mapped and unmapped one by one, which costs a page fault for each 4 KB
        libc.mallopt(-1, 48 << 20)  # M_TRIM_THRESHOLD: freed memory kept at most
    except (OSError, AttributeError):  # another C library
        return
    pa.set_memory_pool(pa.system_memory_pool())


_thrifty()
CHUNK_BYTES = 1 << 20
#: Same for the stages of the pipeline: the same workers run all of them, and hold the largest one's memory.
STAGE_BYTES = 1 << 19
#: Odd multiplier of the byte polynomial and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
#: Same for polynomials over word hashes.
WORD_BASE = 0xD6E8FEB86659FD93
WORD_BASE_INV = pow(WORD_BASE, -1, 1 << 64)

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True  # A-Z count as a-z
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[0x41:0x5B] += 32


def table(seed: int) -> np.ndarray:
    """A random 64-bit value for each byte."""
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)


BYTE_A, BYTE_B = table(11), table(12)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls up to a chunk's length."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n + (n >> 3), 1 << 16), U64(base))
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if len(have) <= 2 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit hash over all bits."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix polynomial hashes: p[i] = sum of values[j] * base**j over j < i."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def spans_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray, inverse: int) -> np.ndarray:
    """Hash of values[start:end] whatever its place: the prefix difference shifted to power 0."""
    inv = powers(inverse, len(pre))
    return (pre[end] - pre[start]) * inv[start]


def window_hash(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive values."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    pre = prefix(values, WORD_BASE)
    return mix((pre[k:] - pre[:n]) * powers(WORD_BASE_INV, n))


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    size, m = 1, a
    while size * 2 <= w:
        m = np.minimum(m[:-size], m[size:]) if len(m) > size else m[:0]
        size *= 2
    if size < w and len(m) > w - size:
        m = np.minimum(m[: -(w - size)], m[w - size :])
    elif size < w:
        m = m[:0]
    return m


def opened(a: np.ndarray, valid: np.ndarray, w: int) -> np.ndarray:
    """Places that hold the minimum of some valid window of w places (all of them on ties).

    a: hash by place; its upper 32 bits decide.  valid: for each window start, whether the window
    counts.  Equal windows choose the same places, so any two of them share one.
    """
    if len(a) < w:
        return np.zeros(0, np.int64)
    own = np.maximum(a >> U64(32), U64(1)).astype(np.uint32)
    none = np.zeros(w - 1, np.uint32)
    least = np.where(valid[: len(a) - w + 1], sliding_min(own, w), np.uint32(0))
    top = ~sliding_min(~np.concatenate([none, least, none]), w)
    return np.flatnonzero(top == own)


@dataclass
class Chunk:
    """Some whole texts joined by one space."""

    rows: slice
    data: np.ndarray  # uint8
    starts: np.ndarray  # of each text in data
    lens: np.ndarray  # bytes of each text
    raw: bytes | memoryview

    @property
    def n(self) -> int:
        return len(self.lens)


def chunks_of(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a string column into chunks of about limit bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lens = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    ends, at = np.cumsum(lens), 0
    while at < len(lens):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
        part = column.slice(at, to - at)
        whole = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part)
        raw = pc.binary_join(whole, " " if pa.types.is_string(part.type) or pa.types.is_large_string(part.type) else b" ")[0].as_buffer()
        size = lens[at:to]
        yield Chunk(slice(at, to), np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum(size + 1)[:-1]]).astype(np.int64), size, memoryview(raw))
        at = to


def words_of(c: Chunk, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word in the chunk, and the number of words of each text."""
    sep = separators[c.data]
    if not len(sep):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(c.n, np.int64)
    edge = np.flatnonzero(sep[1:] != sep[:-1]) + 1
    if not sep[0]:
        edge = np.concatenate([[0], edge])
    if not sep[-1]:
        edge = np.concatenate([edge, [len(sep)]])
    start, end = edge[0::2], edge[1::2]
    if separators[0x20]:
        counts = np.diff(np.concatenate([np.searchsorted(start, c.starts), [len(start)]]))
        return start, end, counts
    raise ValueError("a space must separate words")


def word_hashes(c: Chunk, start: np.ndarray, end: np.ndarray, fold: np.ndarray = SAME, bytes_table: np.ndarray = BYTE_A) -> np.ndarray:
    pre = prefix(bytes_table[fold][c.data], BASE)
    return mix(spans_hash(pre, start, end, BASE_INV) + (end - start).astype(U64) * U64(0x632BE59BD9B4E019))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of arange(s, s + n) for each pair."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(total)


def covered(starts: np.ndarray, length: int | np.ndarray, n: int) -> np.ndarray:
    """Marks each of n places that lies in one of [start, start + length)."""
    diff = np.zeros(n + 1, np.int32)
    np.add.at(diff, starts, 1) if isinstance(length, np.ndarray) else diff.__setitem__(starts, 1)
    if isinstance(length, np.ndarray):
        np.add.at(diff, starts + length, -1)
    else:
        diff -= np.bincount(starts + length, minlength=n + 1).astype(np.int32) if len(starts) else 0
    return np.cumsum(diff[:-1]) > 0


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def ints(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return column(batch, name).to_numpy(zero_copy_only=False)


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under the one that the cluster shares (spark.checkpoint.dir).

    Only where the session names none, as in tests, is a folder of our own set.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not top:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        top = current.get() if current.isDefined() else None
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = "/tmp/checkpoints"
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/corpusforge-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str, name: str, small: bool = False) -> DataFrame:
    """Write df below the shared folder and read it again: cuts lineage, survives lost executors.

    small: many tasks leave few rows each; they go to files by their size, not one a task.
    """
    (df.hint("rebalance") if small else df).write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


#: Groups that are told to all tasks at most; beyond it they are joined by group and salt.
LARGE_GROUPS = 100_000
SALTS = 32


def with_parts(rows: DataFrame, key: str, by: str, large: DataFrame, name: str = "part") -> DataFrame:
    """rows with the part of its group that each is dealt to, by the hash of column `by`.

    large (key, parts) names the groups with several parts; all rows of other groups are part 0.
    No group is gathered for this: large goes to all tasks while it is small, and otherwise
    meets the rows by group and one of SALTS salts.
    """
    if large.limit(LARGE_GROUPS + 1).count() <= LARGE_GROUPS:
        met = rows.join(F.broadcast(large), key, "left")
    else:
        salted = large.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = rows.withColumn("_salt", F.pmod(F.hash(by, F.lit(1)), F.lit(SALTS))).join(salted, [key, "_salt"], "left").drop("_salt")
    return met.withColumn(name, F.pmod(F.xxhash64(by), F.coalesce("parts", F.lit(1)).cast("long")).cast("int")).drop("parts")


def drop_dir(spark: SparkSession, folder: str) -> None:
    """Remove a shared folder that is no longer read."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def utf8(text) -> bytes:
    return (text or "").encode()


#: Bytes of an Arrow batch between the JVM and Python; a batch of whole texts can be large otherwise.  A session can set another bound.
BATCH_BYTES = 8 << 20
#: Same for operators whose JVM holds much besides: a batch takes its size twice there, and once more in the Python worker.
SMALL_BATCH_BYTES = 2 << 20
BATCH_CONF = "corpusforge.batchBytes"


def ship(spark: SparkSession, batch: int = BATCH_BYTES) -> None:
    """Bound the session's Arrow batches, and send this package to the executors unless their Python path has it already."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get(BATCH_CONF, str(batch)))
    root = Path(__file__).resolve().parents[2]
    known = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root in known or getattr(spark.sparkContext, "_corpusforge_sent", False):
        return
    folder = tempfile.mkdtemp(prefix="corpusforge-")
    target = Path(folder) / "corpusforge_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in [*(root / "corpusforge").rglob("*.py"), *root.glob("corpus_pipeline.py")]:
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    spark.sparkContext._corpusforge_sent = True


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
