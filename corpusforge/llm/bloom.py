"""A bitmap of hashes with a fixed greatest size, built on the executors and sent to all.

It only ever lets too much through, so results never depend on it: at 16 bits a hash about 2 %
of the others pass; past MAX_BITS / 16 hashes more and more do, and the exact steps behind it
have more to do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import U64, column, mix

MAX_BITS = 28  # 32 MB
#: From so many bits on, up to TASKS tasks fill bitmaps of their own, which are merged on the executors by PIECES pieces.
WIDE_BITS, TASKS, PIECES = 25, 64, 16


def _bits(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (h >> U64(64 - bits)).astype(np.int64), ((h * U64(0x9E3779B97F4A7C15)) >> U64(64 - bits)).astype(np.int64)


def build(hashes: DataFrame, name: str = "h", mixed: bool = False) -> np.ndarray:
    """The bitmap of a stored table's column of 64-bit hashes (mixed: of ids, which are hashed here)."""
    n = hashes.count()
    bits = int(min(MAX_BITS, max(16, np.ceil(np.log2(16 * max(n, 1))))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, any_ = np.zeros(1 << bits >> 3, np.uint8), False
        for b in batches:
            any_ |= b.num_rows > 0
            h = column(b, name).drop_null().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for at in _bits(mix(h) if mixed else h, bits):
                np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()], pa.binary())], ["bitmap"])

    out = np.zeros(1 << bits >> 3, np.uint8)
    if bits < WIDE_BITS:
        for r in hashes.select(name).coalesce(4).mapInArrow(run, "bitmap binary").toLocalIterator():
            out |= np.frombuffer(r.bitmap, np.uint8)
        return out

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(batches):
            whole = np.frombuffer(b.column(0)[0].as_buffer(), np.uint8).reshape(PIECES, -1)
            for k in range(PIECES):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([whole[k].tobytes()], pa.binary())], ["piece", "bitmap"])

    def merge(t: pa.Table) -> pa.Table:
        own = np.zeros(len(out) // PIECES, np.uint8)
        for x in t.column("bitmap"):
            own |= np.frombuffer(x.as_buffer(), np.uint8)
        return pa.table({"piece": t.column("piece").slice(0, 1), "bitmap": pa.array([own.tobytes()], pa.binary())})

    kinds = "piece int, bitmap binary"
    for r in hashes.select(name).coalesce(TASKS).mapInArrow(cut, kinds).groupBy("piece").applyInArrow(merge, kinds).toLocalIterator():
        out.reshape(PIECES, -1)[r.piece] = np.frombuffer(r.bitmap, np.uint8)
    return out


def contains(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    bits = int(len(bitmap) * 8).bit_length() - 1
    a, b = _bits(h, bits)
    return ((bitmap[a >> 3] >> (a & 7).astype(np.uint8)) & (bitmap[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)
