"""Near-duplicate vectors by hierarchical navigable small-world graphs.

Method.  Equal vectors of one label are one node with a multiplicity.  A label's nodes are dealt
to shards of about SHARD nodes; each shard builds a layered small-world graph.  Every node of
the label queries every shard with a beam search, then follows links above the threshold; of two
shards the nodes of the one with the lower number ask the other, and a link found holds for both ends.
Each task audits queries against brute force until they have SEEN true links (or all queries are
audited), and widens the beam until both the share of links and the share of audited queries with
TARGET of their own links reach TARGET; past WIDEST the beam is the shard, which is brute force.
Hits are verified by cosine in double precision.  A task sends one edge a node (to the root of its own union) and the
node's number of links, never all pairs; components are united over all tasks.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and rows
without a label or vec_id, link with nothing and are kept; vectors of different lengths never link; repeated
rows count as vectors of their own; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, shared_dir, ship, stored
from .components import components

SHARD = 8192
DEGREE = 12
BEAM, WIDEST = 32, 128
AUDIT = 64  # queries audited at first
SEEN = 50  # true links that an audit has to hold
TARGET = 0.99
BLOCK = 256
EXPAND = 4  # candidates of a beam looked at together


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of unit length; their largest component is divided out first, so that no square overflows or vanishes."""
    x = x.astype(np.float64)
    if x.size:
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            x = x * 2.0 ** -np.clip(np.frexp(np.abs(x).max(1, keepdims=True))[1], -1000, 1000).astype(np.float64)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def diverse(sims: np.ndarray, ids: np.ndarray, x: np.ndarray, keep: int) -> np.ndarray:
    """Of each row's candidates (best first, -1 padded) at most `keep`, leaving out those nearer to a kept one than to the row; the best left out fill up."""
    b, c = ids.shape
    v = x[np.maximum(ids, 0)]
    between = np.einsum("bcd,bed->bce", v, v)
    chosen, number = np.zeros((b, c), bool), np.zeros(b, np.int64)
    nearest = np.full((b, c), -2.0, np.float32)  # greatest similarity of each candidate to a kept one
    for j in range(c):
        ok = (ids[:, j] >= 0) & (number < keep) & (nearest[:, j] <= sims[:, j])
        chosen[ok, j] = True
        number += ok
        nearest[ok] = np.maximum(nearest[ok], between[ok, j])
    fill = ~chosen & (ids >= 0)
    rank = np.argsort(np.where(chosen, 0, np.where(fill, 1, 2)), axis=1, kind="stable")[:, :keep]
    out = np.take_along_axis(ids, rank, 1)
    return np.pad(out, ((0, 0), (0, keep - out.shape[1])), constant_values=-1) if out.shape[1] < keep else out


class Layer:
    def __init__(self, n: int, degree: int):
        self.links = np.full((n, degree), -1, np.int32)

    def add(self, x: np.ndarray, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        """Link nodes to their candidates, and back."""
        degree = self.links.shape[1]
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        mine = diverse(sims, ids, x, degree // 2)
        self.links[nodes, : degree // 2] = mine
        src, dst = np.repeat(nodes, mine.shape[1]), mine.reshape(-1)
        ok = dst >= 0
        src, dst = src[ok], dst[ok]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        to, at, n = np.unique(dst, return_index=True, return_counts=True)
        wide = np.full((len(to), degree + min(int(n.max(initial=0)), 2 * degree)), -1, np.int64)
        wide[:, :degree] = self.links[to]
        pos = np.arange(len(dst)) - np.repeat(at, n)
        own = np.repeat(np.arange(len(to)), n)
        fits = pos + degree < wide.shape[1]
        wide[own[fits], pos[fits] + degree] = src[fits]
        for k in range(0, len(to), 512):
            part, t = wide[k : k + 512], to[k : k + 512]
            s = np.einsum("bd,bcd->bc", x[t], x[np.maximum(part, 0)])
            s[part < 0] = -3
            order = np.argsort(-s, axis=1, kind="stable")
            part, s = np.take_along_axis(part, order, 1), np.take_along_axis(s, order, 1)
            part[:, 1:][part[:, 1:] == part[:, :-1]] = -1
            self.links[t] = diverse(s, part, x, degree)


class Hnsw:
    """Layers from the top (few nodes) to the bottom (all nodes)."""

    def __init__(self, x: np.ndarray, seed: int = 3):
        self.x = x.astype(np.float32)
        n = len(x)
        level = np.minimum(np.floor(-np.log(np.random.default_rng(seed).random(n) + 1e-12) / np.log(DEGREE)), 6).astype(int)
        self.order = np.argsort(-level, kind="stable")  # nodes of a layer are a prefix
        self.x = self.x[self.order]
        level = level[self.order]
        self.sizes = [int((level >= k).sum()) for k in range(int(level.max(initial=0)), -1, -1)]
        self.layers: list[Layer] = []
        for i, size in enumerate(self.sizes):
            self.layers.append(Layer(size, 2 * DEGREE))
            if i:
                self.layers[i].links[: self.sizes[i - 1]] = self.layers[i - 1].links
            self._grow(i, self.sizes[i - 1] if i else 0, size)

    def slim(self) -> Hnsw:
        """Without the vectors, to be stored; whole() puts them back."""
        self.x = None
        return self

    def whole(self, x: np.ndarray) -> Hnsw:
        self.x = x.astype(np.float32)[self.order]
        return self

    def _grow(self, i: int, done: int, size: int) -> None:
        layer = self.layers[i]
        while done < size:
            to = min(size, done + max(32, min(done, 1024)))
            new = np.arange(done, to)
            q = self.x[new]
            inside = q @ q.T
            np.fill_diagonal(inside, -3)
            k = min(DEGREE * 2, len(new))
            near = np.argpartition(-inside, k - 1, axis=1)[:, :k] if len(new) > 1 else np.zeros((1, 0), np.int64)
            ids, sims = near + done, np.take_along_axis(inside, near, 1)
            ids = np.where(sims > -2.5, ids, -1)
            if done:
                old_s, old_i = self.search(q, BEAM, layers=i + 1, limit=done)
                ids, sims = np.concatenate([old_i, ids], 1), np.concatenate([old_s, sims], 1)
            layer.add(self.x, new, ids, sims)
            done = to

    def search(self, q: np.ndarray, beam: int, layers: int | None = None, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Similarities and places (in self.order) of each query's beam; -1 where there are fewer."""
        layers = len(self.layers) if layers is None else layers
        sims_all, ids_all = [], []
        for k in range(0, len(q), BLOCK):
            part = q[k : k + BLOCK].astype(np.float32)
            entry = np.zeros((len(part), 1), np.int64)
            for i in range(layers):
                last = i == layers - 1
                s, ids = self._beam(part, entry, self.layers[i].links, beam if last else 4, limit if last and limit else len(self.layers[i].links))
                entry = ids[:, :4]
            sims_all.append(s)
            ids_all.append(ids)
        return np.concatenate(sims_all), np.concatenate(ids_all)

    def _beam(self, q: np.ndarray, entry: np.ndarray, links: np.ndarray, beam: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        b = len(q)
        rows = np.arange(b)[:, None]
        seen = np.zeros((b, limit + 1), bool)
        seen[:, limit] = True
        width = max(beam, entry.shape[1])
        ids, sims = np.full((b, width), -1, np.int64), np.full((b, width), -3, np.float32)
        e = np.where((entry >= 0) & (entry < limit), entry, limit)
        ids[:, : e.shape[1]] = np.where(e < limit, e, -1)
        sims[:, : e.shape[1]] = np.where(e < limit, np.einsum("bd,bcd->bc", q, self.x[np.minimum(e, len(self.x) - 1)]), -3)
        seen[rows, e] = True
        opened = ids < 0
        while True:
            todo = np.where(opened, -4, sims)
            best = np.argpartition(-todo, min(EXPAND, width) - 1, axis=1)[:, :EXPAND]
            live = ~np.take_along_axis(opened, best, 1)
            act = np.flatnonzero(live.any(1))
            if not len(act):
                break
            node = np.where(live[act], np.take_along_axis(ids, best, 1)[act], -1)
            opened[act[:, None], best[act]] = True
            near = np.where(node[:, :, None] >= 0, links[np.maximum(node, 0)], -1).reshape(len(act), -1).astype(np.int64)
            near = np.where((near >= 0) & (near < limit), near, limit)
            fresh = ~seen[act[:, None], near]
            order = np.sort(near, axis=1)  # a node met twice counts once
            near, fresh = order, ~seen[act[:, None], order]
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            seen[act[:, None], near] = True
            s = np.where(fresh, np.einsum("bd,bcd->bc", q[act], self.x[np.minimum(near, len(self.x) - 1)]), -3)
            all_s, all_i = np.concatenate([sims[act], s], 1), np.concatenate([ids[act], np.where(fresh, near, -1)], 1)
            all_o = np.concatenate([opened[act], ~fresh], 1)
            top = np.argpartition(-all_s, width - 1, axis=1)[:, :width]
            sims[act], ids[act], opened[act] = np.take_along_axis(all_s, top, 1), np.take_along_axis(all_i, top, 1), np.take_along_axis(all_o, top, 1)
            opened |= ids < 0
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(sims, order, 1), np.take_along_axis(ids, order, 1)

    def within(self, q: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs with a similarity of about `least` or more; beams full of hits are followed link by link."""
        sims, ids = self.search(q, beam)
        hit = (sims >= least) & (ids >= 0)
        full = np.flatnonzero(hit.all(1))
        hit[full] = False
        row, col = np.nonzero(hit)
        who, what = [row], [ids[row, col]]
        links = self.layers[-1].links
        for r in full:
            got = np.zeros(len(self.x), bool)
            seen = np.zeros(len(self.x), bool)
            front = np.unique(ids[r])
            seen[front] = got[front] = True
            while len(front):
                near = np.unique(links[front])
                near = near[near >= 0]
                near = near[~seen[near]]
                seen[near] = True
                front = near[self.x[near] @ q[r].astype(np.float32) >= least]
                got[front] = True
            what.append(np.flatnonzero(got))
            who.append(np.full(len(what[-1]), r))
        return np.concatenate(who), self.order[np.concatenate(what)]


def _matrix(col: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    """Vectors in the precision that they came in."""
    return np.asarray(pa.chunked_array([col]).combine_chunks().flatten() if isinstance(col, pa.Array) else col.combine_chunks().flatten()).reshape(n, -1)


def build(t: pa.Table) -> pa.Table:
    ids, times = t.column("rep").to_numpy(), t.column("times").to_numpy()
    x = _matrix(t.column("x"), t.num_rows)
    graph = pickle.dumps((ids, times, x, Hnsw(unit(x)).slim()), protocol=5)
    return pa.table({"label": t.column("label").slice(0, 1), "dim": t.column("dim").slice(0, 1), "shard": t.column("shard").slice(0, 1), "graph": pa.array([graph], pa.binary())})


def audited(y: np.ndarray, x: np.ndarray, own: np.ndarray, least: float, seen: int = SEEN) -> tuple[np.ndarray, np.ndarray]:
    """Queries picked at random and their numbers of true links, enlarged until these add up to `seen`.  own: each query's place in x, or -1 (its link to itself does not count)."""
    order, at, pick, true = np.random.default_rng(1).permutation(len(y)), 0, [], []
    while at < len(order) and (not at or sum(t.sum() for t in true) < seen):
        part = order[at : at + max(AUDIT, min(at, 512))]
        hit = y[part] @ x.T >= least
        inside = np.flatnonzero(own[part] >= 0)
        hit[inside, own[part[inside]]] = False
        pick.append(part)
        true.append(hit.sum(1))
        at += len(part)
    return np.concatenate(pick), np.concatenate(true)


def search(least: float, target: float):
    def run(t: pa.Table) -> pa.Table:
        """One shard's graph (the row with a graph) and the nodes of an equal or lower shard: an edge and a number of links for each node met."""
        q = t.filter(t.column("graph").is_null())
        blob = t.filter(t.column("graph").is_valid()).column("graph")
        rep, times = q.column("rep").to_numpy(), q.column("times").to_numpy()
        if not len(rep) or not len(blob):
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
        ids, own_times, x, graph = pickle.loads(blob[0].as_py())
        x, y = unit(x), unit(_matrix(q.column("x"), len(rep)))
        graph = graph.whole(x)
        by_id = np.argsort(ids)
        place = by_id[np.minimum(np.searchsorted(ids, rep, sorter=by_id), len(ids) - 1)]
        place = np.where(ids[place] == rep, place, -1)
        pick, true = audited(y, x, place, least)
        beam = BEAM
        while True:
            if beam >= len(x):
                who, what = (np.concatenate(z) for z in zip(*[(lambda a: (a[0] + k, a[1]))(np.nonzero(y[k : k + 512] @ x.T >= least)) for k in range(0, len(y), 512)], strict=True))
            else:
                who, what = graph.within(y, least - 1e-4, beam)
                exact = np.concatenate([(y[who[k : k + 65536]] * x[what[k : k + 65536]]).sum(1) for k in range(0, len(who), 65536)] or [np.zeros(0)])
                who, what = who[exact >= least], what[exact >= least]
            other = place[who] != what
            who, what = who[other], what[other]
            if beam >= len(x):
                break
            found = np.bincount(who, minlength=len(rep))[pick]
            if found.sum() >= target * true.sum() and (found >= target * true).mean() >= target:
                break
            beam = beam * 4 if beam < WIDEST else len(x)
        if (place >= 0).all():  # a shard's own nodes ask it: a link found from one end holds for both
            turned = np.full(len(ids), -1, np.int64)
            turned[place] = np.arange(len(rep))
            pairs = np.unique(np.concatenate([who * len(ids) + what, turned[what] * len(ids) + place[who]]))
            who, what = pairs // len(ids), pairs % len(ids)
            back = np.zeros(len(ids), np.int64)
        else:
            back = np.bincount(what, times[who], len(ids)).astype(np.int64)
        links = np.bincount(who, own_times[what], len(rep)).astype(np.int64)
        met = np.flatnonzero(back)
        u, v = unite(rep[who], ids[what])
        return pa.table({"u": pa.array(np.concatenate([rep, ids[met], u])), "v": pa.array(np.concatenate([rep, ids[met], v])), "links": pa.array(np.concatenate([links, back[met], np.zeros(len(u), np.int64)]))})

    return run


def unite(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An edge from each id in pairs (a, b) to the smallest id that it reaches through them."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        new = root.copy()
        np.minimum.at(new, x, root[y])
        np.minimum.at(new, y, root[x])
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(ids))
    return ids[moved], ids[root[moved]]


def near_duplicates(vectors: DataFrame, least: float = 0.93, target: float = TARGET, shard: int = SHARD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    ship(spark)
    folder = shared_dir(spark)
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = kind if kind in ("float", "double") else "double"
    rows = vectors.select("vec_id", "label", F.transform("embedding", lambda x: x.cast(kind) + F.lit(0).cast(kind)).alias("x"))
    good = rows.where("vec_id is not null and label is not null and size(x) > 0").where(~F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).where(F.exists("x", lambda x: x != 0))
    keyed = stored(good.select("vec_id", "label", "x", F.xxhash64("x").alias("h1"), F.xxhash64(F.lit(7), "x").alias("h2"), F.size("x").alias("dim")), folder, "vectors")
    key = ["label", "dim", "h1", "h2"]
    classes = stored(keyed.groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("times")), folder, "classes")
    nodes = classes.join(keyed.select(F.col("vec_id").alias("rep"), "x", *key), ["rep", *key]).dropDuplicates(["rep", *key])
    sizes = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / shard).alias("shards"))
    nodes = stored(nodes.join(sizes, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int")).select("label", "dim", "shard", "shards", "rep", "times", "x"), folder, "nodes")
    label = nodes.schema["label"].dataType.simpleString()
    graphs = stored(nodes.groupBy("label", "dim", "shard").applyInArrow(build, f"label {label}, dim int, shard int, graph binary"), folder, "graphs")
    above = F.explode(F.sequence(F.col("shard"), (F.col("shards") - 1).cast("int")))
    upto = F.explode(F.sequence(F.lit(0), F.col("shard")))
    asked = nodes.select("label", "dim", F.col("shard").alias("block"), above.alias("shard"), "rep", "times", "x", F.lit(None).cast("binary").alias("graph"))
    sent = graphs.join(sizes, ["label", "dim"]).select("label", "dim", upto.alias("block"), "shard", F.lit(0).cast("long").alias("rep"), F.lit(0).cast("long").alias("times"), F.lit(None).cast(f"array<{kind}>").alias("x"), "graph")
    found = stored(asked.unionByName(sent).groupBy("label", "dim", "block", "shard").applyInArrow(search(least, target), "u long, v long, links long"), folder, "found")
    comp = components(found.where("u <> v").select("u", "v"), folder)
    links = found.groupBy("u").agg(F.sum("links").alias("links"))
    member = keyed.join(classes, key).select("vec_id", "rep", "times")
    out = member.join(links, member.rep == links.u, "left").join(comp, member.rep == comp.id, "left")
    out = out.select("vec_id", (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    alone = rows.where(F.col("vec_id").isNull() | F.col("label").isNull() | (F.coalesce(F.size("x"), F.lit(0)) <= 0) | F.coalesce(F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True)) | ~F.coalesce(F.exists("x", lambda x: x != 0), F.lit(False)))
    out = out.unionByName(alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))
