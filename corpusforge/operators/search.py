"""Index, sparse and dense search, fusion, reranking, and the evidence gate.

All functions take and return DataFrames; a batch of questions is one DataFrame.  Every ranking
has a total order (score descending, then id).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stem import stems
from ..functions.text import bm25_terms
from ..functions.vectors import clamp01
from ..session import INDEXES, drop, pruning, settled, shared_folder, stored

K1, B, AVERAGE_LENGTH = 1.2, 0.75, 256.0
PREFETCH, RRF_K = 40, 60
TOP_K, RERANK_KEEP, RERANK_FLOOR = 8, 3, 0.01
#: Questions sent to every task of a dense scan at once; more are taken in further blocks.
QUERY_BLOCK, VECTOR_BLOCK = 4096, 512
#: Postings a chunk of documents, chunks and tasks whose lists of one term meet in a task, and texts and lists that are worked on at once.
CHUNK, COMMON, TEXTS, LISTS = 1_000_000, 8, 256, 4096
#: Terms of questions that are sent to every task at most.
SENT_TERMS = 500_000


def ranked(df: DataFrame, by: list[str], order: list[Column], k: int | None = None, name: str = "rank") -> DataFrame:
    """Number rows 1.. within `by`; with k only the first k (a group limit below the shuffle)."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out.where(F.col(name) <= k) if k else out


def numbered(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Number all rows 1.. in a total order without gathering them: sorted ranges, each numbered from the size of those before it."""
    parts = settled(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a partition
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_before")
    return parts.join(F.broadcast(before), "_part").withColumn(name, place.cast("long")).drop("_part", "_before")


def payload(rows: DataFrame, kb: str, modality: Sequence[str] = (), document: Sequence = (), page: int | None = None, region_type: Sequence[str] = ()) -> DataFrame:
    """Rows of one collection that pass every given filter; it stands below the ranking, so top-k is taken among them."""
    out = rows.where(F.col("kb") == kb)
    for column, allowed in (("modality", modality), ("doc_id", document), ("page", () if page is None else (page,)), ("region_type", region_type)):
        out = out.where(F.col(column).isin(*allowed)) if allowed else out
    return out


@dataclass
class Index:
    """Stored postings of a table of documents: posts (doc_id, term, tf, weight), idf (term, df, idf).

    Terms are stems.  Posts are files of term ranges, each sorted by term, so a search for a few terms
    skips the row groups of all others, and a common term may span many files.
    """

    posts: DataFrame
    idf: DataFrame


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, length, term: one row a term occurrence; length counts the kept terms."""
    t = docs.select("doc_id", bm25_terms(F.col("text")).alias("terms"))
    return t.select("doc_id", F.size("terms").alias("length"), F.explode("terms").alias("term"))


def stemmed(rows: DataFrame) -> DataFrame:
    """rows with each term replaced by its stem; the distinct terms are stemmed once, into a stored vocabulary."""
    vocabulary = settled(stems(rows.select("term").distinct()))
    return rows.join(vocabulary, "term").withColumn("term", F.col("stem")).drop("stem")


def term_lists(batches: Iterator[pa.RecordBatch], most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """part, term, docs, lengths, tfs: the postings of each term in a chunk of consecutive documents (doc_id, terms) of a task, some `most` postings; COMMON chunks of COMMON tasks are a part."""
    task, chunk, held, size = TaskContext.get().partitionId(), 0, [], 0

    def lists() -> Iterator[pa.RecordBatch]:
        t = pa.concat_tables(held)
        words = t["term"].combine_chunks().dictionary_encode()
        codes = words.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
        offsets = pa.array(np.append(starts, len(codes)), pa.int32())
        of = lambda c: pa.ListArray.from_arrays(offsets, t[c].combine_chunks().take(pa.array(order)))
        names = words.dictionary.take(pa.array(codes[order][starts]))
        out = pa.RecordBatch.from_arrays([pa.array(np.full(len(names), (task // COMMON << 32) + chunk // COMMON)), names, of("doc_id"), of("length"), of("tf")], ["part", "term", "docs", "lengths", "tfs"])
        yield from (out.slice(at, LISTS) for at in range(0, len(names), LISTS))

    for whole in batches:
        for b in (whole.slice(at, TEXTS) for at in range(0, whole.num_rows, TEXTS)):
            length = pc.list_value_length(b.column(1)).cast(pa.int32())
            found = pa.table({"row": pc.list_parent_indices(b.column(1)), "term": pc.list_flatten(b.column(1))}).group_by(["row", "term"]).aggregate([([], "count_all")])
            held.append(pa.table({"doc_id": b.column(0).take(found["row"].combine_chunks()), "length": length.take(found["row"].combine_chunks()), "term": found["term"], "tf": found["count_all"].cast(pa.int32())}))
            size += found.num_rows
            if size >= most:
                yield from lists()
                chunk, held, size = chunk + 1, [], 0
    if size:
        yield from lists()


def postings(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """doc_id, term (a stem), tf, length of every document, dealt by ranges of terms and sorted by term and document.

    Terms are counted and stemmed by chunks of documents, before the only shuffle, whose rows are a
    term's postings in a chunk; these are stored in the folder, as the ranges are found by a pass
    over them.  The chunks of a part meet in one task, so a common term has several.
    """
    ids = docs.schema["doc_id"].dataType.simpleString()
    lists = docs.select("doc_id", bm25_terms(F.col("text")).alias("terms")).mapInArrow(term_lists, f"part long, term string, docs array<{ids}>, lengths array<int>, tfs array<int>")
    lists = stored(stems(lists).select(F.col("stem").alias("term"), "part", "docs", "lengths", "tfs"), folder or shared_folder(docs.sparkSession))
    entries = F.arrays_zip(F.col("docs").alias("doc_id"), F.col("lengths").alias("length"), F.col("tfs").alias("tf"))
    rows = lists.repartitionByRange("term", "part").select("term", "part", F.inline(entries))
    # Rows that repeat a doc_id may lie in different parts: they are brought together only where there are any.
    repeated = not docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    if repeated:
        rows = rows.repartitionByRange("term", "doc_id").withColumn("part", F.lit(0))
    merged = rows.groupBy("doc_id", "term", "length", "part").agg(F.sum("tf").alias("tf"))
    return merged.select("doc_id", "term", "tf", "length").sortWithinPartitions("term", "doc_id")


def weighted(posts: DataFrame) -> DataFrame:
    """posts (doc_id, term, tf, length) with the weight of a term in its document for the length."""
    return posts.select("doc_id", "term", "tf", (F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / AVERAGE_LENGTH))).alias("weight"))


def inverse_frequency(posts: DataFrame, n: DataFrame) -> DataFrame:
    """term, df, idf = ln(1 + (N - df + 0.5) / (df + 0.5)); n: one row, n_docs."""
    df = posts.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n))
    return df.select("term", "df", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def _state(docs: DataFrame) -> tuple:
    """What a stored index depends on: the plan of docs, and the files it reads with their sizes and times; without files nothing."""
    spark = docs.sparkSession
    hadoop, files = spark.sparkContext._jsc.hadoopConfiguration(), []
    for name in sorted(docs.inputFiles()):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(hadoop).getFileStatus(path)
        files.append((name, status.getLen(), status.getModificationTime()))
    return (docs.semanticHash(), *files) if files else ()


def index(docs: DataFrame) -> Index:
    """The stored index of docs (doc_id, text), built once a session for the same files and plan."""
    docs = docs.select("doc_id", "text")
    context = docs.sparkSession.sparkContext
    known = context.__dict__.setdefault(INDEXES, {})
    key = _state(docs)
    if key and key in known:
        return known[key]
    lists = shared_folder(docs.sparkSession)
    posts = weighted(settled(postings(docs, lists), **pruning("term", "doc_id")))
    drop(docs.sparkSession, lists)
    out = Index(posts, settled(inverse_frequency(posts, docs.agg(F.count("*").alias("n_docs")))))
    if key:
        known[key] = out
    return out


def query_terms(queries: DataFrame) -> DataFrame:
    """item_id, term: the distinct stems of each question."""
    return stemmed(queries.select("item_id", F.explode(F.array_distinct(bm25_terms(F.col("text")))).alias("term"))).distinct()


def scored(posts: DataFrame, terms: DataFrame, by: list[str]) -> DataFrame:
    """by, doc_id, score (6 digits) of terms (by, term, idf) in posts.

    Posts of any of the terms are dealt by document and meet the questions there, so a post is
    shuffled once however many questions ask for it.  More than SENT_TERMS terms are too many to send
    to every task; then questions and posts are dealt by term first.
    """
    own = settled(terms.select(*by, "term", "idf"))
    if own.count() <= SENT_TERMS:
        wanted = posts.join(F.broadcast(own.select("term").distinct()), "term", "left_semi").select("doc_id", "term", "weight")
        met = wanted.repartition("doc_id").join(F.broadcast(own), "term")
    else:
        met = posts.join(own, "term")
    return met.groupBy(*by, "doc_id").agg(F.round(F.sum(F.col("weight") * F.col("idf")), 6).alias("score"))


def sparse_scores(docs: DataFrame | Index, queries: DataFrame) -> DataFrame:
    """item_id, doc_id, score (6 digits): BM25 of every document that shares a term with a question."""
    own = docs if isinstance(docs, Index) else index(docs)
    return scored(own.posts, query_terms(queries).join(own.idf, "term"), ["item_id"])


def sparse_topk(docs: DataFrame | Index, queries: DataFrame, k: int = PREFETCH, without: DataFrame | None = None) -> DataFrame:
    """The k best of each question; without: pairs (item_id, doc_id) that are left out before the ranking."""
    scores = sparse_scores(docs, queries)
    if without is not None:
        scores = scores.join(without.select("item_id", "doc_id"), ["item_id", "doc_id"], "left_anti")
    return ranked(scores, ["item_id"], [F.desc("score"), F.asc("doc_id")], k)


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int = PREFETCH, id_col: str = "vec_id") -> DataFrame:
    """Exact cosine search.  queries: item_id, query (array).

    Questions go to the tasks in blocks of QUERY_BLOCK; a block scans the vectors once, as matrix
    products of VECTOR_BLOCK vectors, and a partition hands on no more than its own k best of a
    question.  A block's result is stored before the next one is sent.
    Vectors that are null, zero, hold nulls or have another length meet no question.
    """
    spark, kinds = vectors.sparkSession, f"item_id {queries.schema['item_id'].dataType.simpleString()}, {id_col} {vectors.schema[id_col].dataType.simpleString()}, score double"
    asked = queries.select("item_id", F.transform("query", lambda x: x.cast("double")).alias("query")).where("size(query) > 0").toLocalIterator()
    out = None
    while block := list(itertools.islice(asked, QUERY_BLOCK)):
        for size in sorted({len(r.query) for r in block}):
            own = [r for r in block if len(r.query) == size]
            sent = spark.sparkContext.broadcast(([r.item_id for r in own], unit_rows(np.array([r.query for r in own], np.float64))))
            near = vectors.where(F.size("embedding") == size).select(id_col, "embedding").mapInArrow(lambda batches, sent=sent: nearest(batches, *sent.value, id_col, k), kinds)
            near = settled(near)
            sent.destroy()
            out = near if out is None else out.unionByName(near)
    return ranked(spark.createDataFrame([], kinds) if out is None else out, ["item_id"], [F.desc("score"), F.asc(id_col)], k)


def unit_rows(x: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.sqrt((x * x).sum(1, keepdims=True))


def nearest(batches: Iterator[pa.RecordBatch], items: list, questions: np.ndarray, id_col: str, k: int) -> Iterator[pa.RecordBatch]:
    """The k best (score of 6 digits, then id) of a partition's vectors for each question."""
    score, ids = np.full((len(items), 0), -np.inf), np.zeros(0, np.int64)
    place = np.zeros((len(items), 0), np.int64)
    for b in (whole.slice(at, VECTOR_BLOCK) for whole in batches for at in range(0, whole.num_rows, VECTOR_BLOCK)):
        x = unit_rows(np.asarray(b.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(b.num_rows, -1))
        own = questions @ x.T
        own = np.round(np.where(np.isfinite(own), own, -np.inf), 6)
        score, place = np.concatenate([score, own], 1), np.concatenate([place, np.broadcast_to(len(ids) + np.arange(b.num_rows), own.shape)], 1)
        ids = np.concatenate([ids, b.column(0).to_numpy(zero_copy_only=False)])
        best = np.lexsort((ids[place], -score), axis=1)[:, :k]
        score, place = np.take_along_axis(score, best, 1), np.take_along_axis(place, best, 1)
        used, place = np.unique(place, return_inverse=True)
        ids, place = ids[used], place.reshape(score.shape)
    which, col = np.nonzero(np.isfinite(score))
    if len(which):
        yield pa.RecordBatch.from_arrays([pa.array([items[i] for i in which.tolist()]), pa.array(ids[place[which, col]]), pa.array(score[which, col])], ["item_id", id_col, "score"])


def rrf(dense: DataFrame, sparse: DataFrame, by: list[str], id_col: str, weights: tuple[float, float] = (1.0, 1.0), k: int = RRF_K) -> DataFrame:
    """Weighted reciprocal-rank fusion of two ranked lists: score, dense_rank, sparse_rank, position."""
    d = dense.select(*by, id_col, F.col("rank").alias("dense_rank"))
    s = sparse.select(*by, id_col, F.col("rank").alias("sparse_rank"))
    both = d.join(s, [*by, id_col], "full_outer")
    part = lambda name, w: F.coalesce(F.lit(w) / (F.lit(k) + F.col(name)), F.lit(0.0))
    fused = both.withColumn("score", F.round(part("dense_rank", weights[0]) + part("sparse_rank", weights[1]), 9))
    return ranked(fused, by, [F.desc("score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"), F.asc(id_col)], name="position")


def best_score(results: DataFrame, by: list[str], id_col: str, seq: str) -> DataFrame:
    """Each id once, at its best score; among equals the first seen."""
    return ranked(results, [*by, id_col], [F.desc("score"), F.asc(seq)], 1, "_n").drop("_n")


def pinned_first(results: DataFrame, by: list[str], id_col: str, width: int) -> DataFrame:
    return ranked(results, by, [F.desc("pinned"), F.desc("score"), F.asc(id_col)], width)


def rerank_prune(scored: DataFrame, by: list[str], id_col: str, top_k: int = TOP_K, floor: float = RERANK_FLOOR, keep: int = RERANK_KEEP) -> DataFrame:
    """The first `keep` by rerank score, then those at or above the floor, at most top_k."""
    order = [F.desc("rerank_score"), F.asc(id_col)]
    r = ranked(scored, by, order, name="_n").where((F.col("_n") <= keep) | (F.col("rerank_score") >= floor)).drop("_n")
    return ranked(r, by, order, top_k)


def token_overlap(query: Column, text: Column) -> Column:
    """Default rerank scorer: share of the question's distinct terms that the passage holds."""
    q = F.array_distinct(bm25_terms(query))
    return F.coalesce(F.size(F.array_intersect(q, bm25_terms(text))) / F.nullif(F.size(q), F.lit(0)), F.lit(0.0))


def graded(scored: DataFrame, llm: str = "llm_score", rerank: str = "rerank_score", floor: float = 0.2) -> DataFrame:
    """Verdict of each candidate: the grader's, else the reranker's (relevant at the floor), else none."""
    return scored.withColumns(
        {
            "graded_by": F.when(F.col(llm).isNotNull(), "llm").when(F.col(rerank).isNotNull(), "rerank"),
            "score": F.coalesce(llm, rerank),
            "relevant": F.when(F.col(llm).isNotNull(), F.col(llm) >= 0.5).otherwise(F.col(rerank) >= floor),
        }
    )


def strong(min_score: float = 0.55, min_rerank: float = 0.2) -> Column:
    return F.when(F.col("graded_by") == "rerank", F.col("score") >= min_rerank).otherwise(F.col("score") >= min_score)


def sufficiency(evidence: DataFrame, by: str = "item_id", iteration: int = 1, web_enabled: bool = True, minimum: int = 2) -> DataFrame:
    """Decision for each question: answer, retry, web or abstain.

    evidence: by, score, rerank_score, graded_by, from_image, external, pinned, scoped.
    """
    decisive = F.when(F.col("graded_by") == "rerank", F.col("score") >= 0.95).otherwise((F.col("score") >= 0.85) & (F.col("rerank_score").isNull() | (F.col("rerank_score") >= 0.5) | F.col("from_image")))
    is_strong = F.coalesce(strong() & ~F.col("external"), F.lit(False))
    flags = evidence.groupBy(by).agg(
        F.count_if(is_strong | F.col("external")).alias("n_evidence"),
        F.max((is_strong & F.col("pinned")).cast("int")).alias("located"),
        F.max(F.coalesce((is_strong & decisive).cast("int"), F.lit(0))).alias("decisive"),
        F.max(F.when(F.col("scoped"), 1).otherwise(minimum)).alias("needed"),
        F.max(F.col("external").cast("int")).alias("web_used"),
    )
    enough = (F.col("n_evidence") >= F.col("needed")) | (F.col("located") == 1) | (F.col("decisive") == 1)
    return flags.withColumn("decision", F.when(enough, "answer").when(F.lit(iteration) < 3, "retry").when(F.lit(web_enabled) & (F.col("web_used") == 0), "web").otherwise("abstain"))


def confidence(evidence: DataFrame, by: str = "item_id") -> DataFrame:
    """Mean of the three best scores (0 to 1), top score, counts and basis of each question."""
    top = ranked(evidence, [by], [F.desc("score"), F.asc("doc_id")])
    return top.groupBy(by).agg(
        F.round(F.avg(F.when(F.col("rank") <= 3, clamp01(F.col("score")))), 6).alias("mean_top3"),
        F.round(F.max(clamp01(F.col("score"))), 6).alias("top_score"),
        F.count("*").alias("n_relevant"),
        F.when(F.count_if(F.coalesce(F.col("graded_by"), F.lit("llm")) == "llm") == F.count("*"), "llm").when(F.count_if(F.col("graded_by") == "rerank") == F.count("*"), "rerank").otherwise("mixed").alias("basis"),
    )
