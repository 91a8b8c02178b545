"""Centroid clustering in exact integers: distances by matrix products, sums by a tree over the executors.

Method.  Components become integers floor(scale * x); vectors are packed once into blocks of at
most BLOCK rows in the shared folder.  A round sends the centroids (a few thousand integers) to
all blocks.  In a block |x|^2 - 2 x.c + |c|^2 is one float64 matrix product; every term and
partial sum is a whole number, so it is exact while 64 (max|x| + max|c|)^2 stays below 2^53.
A block beyond that bound takes int64 differences, and beyond 2^63 Python integers.  Sums and
counts by cluster are united by RDD.treeAggregate, so the driver receives one small array a round.

Cases: vectors of another length, null ones and those with null or non-finite components are left
out; a null vec_id is clustered but starts no centroid; rows that repeat a vec_id count each, and
start centroids in the order of hash and components; with fewer vectors than centroids there are
as many centroids as vectors that can start one, and without any no row; ties go to the smaller
number; a distance or inertia beyond 64 bits is null; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, read, shared_dir, ship, stored

SCALE = 1024
DIM, CLUSTERS, ROUNDS = 64, 8, 10
BLOCK = 4096
EXACT = 1 << 53
LONG = 1 << 63
DEPTH = 2  # of the tree that unites sums


def scaled(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of finite doubles: int64 where all fit, else Python integers."""
    with np.errstate(over="ignore"):
        product = values * float(scale)
    if np.abs(product).max(initial=0) < LONG / 2:
        return np.floor(product).astype(np.int64)
    # A double of 2^53 or more is a whole number, so scaling it by an integer needs no floor.
    whole = [math.floor(x * scale) if abs(x) < EXACT else int(x) * scale for x in values.ravel().tolist()]
    return np.array(whole, object).reshape(values.shape)


def narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int32) if x.dtype == np.int64 and np.abs(x).max(initial=0) < 1 << 31 else x


def largest(x: np.ndarray) -> int:
    return max((abs(int(v)) for v in (x.min(initial=0), x.max(initial=0))), default=0)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest row of c for each row of x, and the squared distance; exact, ties to the smaller number."""
    bound = x.shape[1] * (largest(x) + largest(c)) ** 2
    if bound < EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        far = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
    elif bound < LONG:
        a, b = x.astype(np.int64), c.astype(np.int64)
        far = np.stack([((a - row) ** 2).sum(1) for row in b], 1)
    else:
        a, b = x.astype(object), c.astype(object)
        far = np.stack([((a - row) ** 2).sum(1) for row in b], 1)
    best = far.argmin(1)
    least = far[np.arange(len(x)), best]
    return best, least.astype(np.int64) if bound < EXACT else least


def sums_of(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """One row a centroid: sums of its vectors' components, their number, their distances' sum; Python integers."""
    best, least = nearest(x, c)
    out = np.zeros((len(c), x.shape[1] + 2), object)
    wide = x.astype(np.int64) if x.dtype != object and len(x) * largest(x) < LONG else x.astype(object)
    for k in np.unique(best).tolist():
        own = best == k
        out[k, :-2] = [int(v) for v in wide[own].sum(0)]
        out[k, -2] = int(own.sum())
        out[k, -1] = sum(int(v) for v in least[own].tolist())
    return out


def blocks(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """ids, x: vectors (vec_id, embedding) that are whole, packed in blocks."""
    whole = (F.size("embedding") == dim) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.coalesce(whole, F.lit(False)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                x = np.asarray(column(part, "embedding").flatten().to_numpy(zero_copy_only=False), np.float64).reshape(part.num_rows, dim)
                ids = pa.array([column(part, "vec_id")], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([pickle.dumps(narrow(scaled(x, scale)))], pa.binary())], ["ids", "x"])

    return rows.mapInArrow(pack, "ids array<long>, x binary")


def first_centroids(vectors: DataFrame, dim: int, scale: int, clusters: int, seed: str) -> np.ndarray | None:
    """The vectors whose ids have the smallest hashes, in that order."""
    picked = []
    for r in vectors.collect():
        x = scaled(np.array(r.embedding, np.float64).reshape(1, dim), scale)[0]
        picked.append((hashlib.sha256(f"{seed}{r.vec_id}".encode()).hexdigest(), [int(v) for v in x]))
    picked.sort()
    return as_array([x for _, x in picked[:clusters]]) if picked else None


def as_array(rows: list[list[int]]) -> np.ndarray:
    """int64 where all numbers fit, else Python integers."""
    return np.array(rows, np.int64 if max((abs(v) for row in rows for v in row), default=0) < LONG else object)


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: str = "3:") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every whole vector of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    ship(spark)
    folder = shared_dir(spark)
    packed = stored(blocks(vectors, dim, scale), folder, "blocks")
    whole = (F.size("embedding") == dim) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    able = vectors.where(F.coalesce(whole, F.lit(False)) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    top = able.orderBy(F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256), "embedding").limit(clusters)
    c = first_centroids(top, dim, scale, clusters, seed)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if c is None:
        return spark.createDataFrame([], schema)
    data = packed.select("x").rdd.map(lambda r: pickle.loads(r.x))

    def totals(c: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast(c)
        out = data.treeAggregate(np.zeros((len(c), dim + 2), object), lambda total, x: total + sums_of(x, sent.value), lambda a, b: a + b, DEPTH)
        sent.unpersist()
        return out

    for _ in range(rounds):
        found = totals(c)
        c = as_array([[v // row[-2] for v in row[:-2]] if row[-2] else [int(v) for v in old] for row, old in zip(found.tolist(), c.tolist(), strict=True)])
    inertia = [row[-1] for row in totals(c).tolist()]
    digest = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c.tolist()]
    fits = lambda v: v if v < LONG else None
    own, total = [fits(v) for v in inertia], fits(sum(inertia))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, x in zip(column(b, "ids"), column(b, "x"), strict=True):
                best, least = nearest(pickle.loads(x.as_py()), c)
                k = best.tolist()
                yield pa.RecordBatch.from_arrays(
                    [ids.values, pa.array(best.astype(np.int32)), pa.array([fits(v) for v in least.tolist()], pa.int64()), pa.array([own[i] for i in k], pa.int64()), pa.array([total] * len(k), pa.int64()), pa.array([digest[i] for i in k])],
                    ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    return packed.mapInArrow(assign, schema)


def oracle(clusters: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """The same in DuckDB, one pair of views a round."""
    views = [
        "kept as (select row_number() over () as i, vec_id, list_transform(embedding, lambda v: floor(1024 * v::double)::bigint) as x from embeddings"
        " where len(embedding) = 64 and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0)",
        f"c0 as (select (row_number() over (order by sha256('3:' || vec_id), x) - 1)::int as k, x as c from kept where vec_id is not null order by sha256('3:' || vec_id), x limit {clusters})",
    ]
    for r in range(rounds + 1):
        views.append(
            f"a{r} as materialized (select i, arg_min(k, d * {clusters} + k) as k, min(d) as d from (select i, k, list_sum(list_transform(range(1, 65), lambda j: (x[j] - c[j]) * (x[j] - c[j])))::bigint as d from kept, c{r}) group by i)"
        )
        if r < rounds:
            views.append(
                f"c{r + 1} as materialized (select c.k, coalesce(list_transform(m.s, lambda t: ((t - ((t % m.n) + m.n) % m.n) // m.n)::bigint), c.c) as c from c{r} c left join"
                f" (select k, max(n) as n, list(s order by j) as s from (select k, j, sum(v)::bigint as s, count(*)::bigint as n from (select a.k, unnest(range(1, 65)) as j, unnest(x) as v from kept join a{r} a using (i)) group by k, j) group by k) m using (k))"
            )
    last = f"""
select vec_id, k::int as cluster, d as distance, (sum(d) over (partition by k))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, sha256(array_to_string(c, ',')) as centroid_sha256
from kept join a{rounds} using (i) join c{rounds} using (k)
"""
    return "with " + ",\n".join(views) + last


ORACLE = oracle()


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(read(spark, sf_dir, "embeddings"))
