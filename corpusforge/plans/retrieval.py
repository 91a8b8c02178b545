"""Retrieval queries: benchmark passages against documents and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stem import stems_sql
from ..functions.text import BM25_STOPWORDS
from ..operators import search as S
from ..registry import query
from ..sources.readers import table

STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in BM25_STOPWORDS)


def terms_sql(text: str) -> str:
    return rf"list_filter(list_transform(regexp_extract_all(lower(coalesce({text}, '')), '[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_''-]*'), lambda w: regexp_replace(w, '^[''-]+|[''-]+$', '', 'g')), lambda w: w <> '' AND length(w) < 40 AND NOT list_contains([{STOP}], w))"


POSTINGS = f"""
tok AS (SELECT doc_id, {terms_sql("text")} AS t FROM documents),
qtok AS (SELECT item_id, {terms_sql("text")} AS t FROM benchmark),
voc AS (SELECT DISTINCT unnest(t) AS term FROM (SELECT t FROM tok UNION ALL SELECT t FROM qtok)),
{stems_sql("voc")},
post AS (SELECT doc_id, stem AS term, count(*) AS tf, count(*) * 2.2 / (count(*) + 1.2 * (0.25 + 0.75 * any_value(n) / 256.0)) AS weight FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM tok) JOIN stems USING (term) GROUP BY doc_id, stem),
idf AS (SELECT term, count(*) AS df, ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post GROUP BY term),
q AS (SELECT DISTINCT item_id, stem AS term FROM (SELECT item_id, unnest(t) AS term FROM qtok) JOIN stems USING (term)),
score AS (SELECT item_id, doc_id, round(sum(weight * idf), 6) AS score FROM post JOIN q USING (term) JOIN idf USING (term) GROUP BY item_id, doc_id),
sparse AS (SELECT * FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM score) WHERE rank <= 40)"""
#: Stand-in for an encoder: the vector of a question is the embedding whose id is item_id modulo the number of vectors; document d has the vector with id d modulo it.
DENSE = """
nv AS (SELECT count(*) AS n FROM embeddings),
qv AS (SELECT item_id, embedding AS q FROM benchmark JOIN nv ON true JOIN embeddings ON vec_id = item_id % n),
dsc AS (SELECT item_id, vec_id, round(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) / (sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_inner_product(CAST(q AS DOUBLE[]), CAST(q AS DOUBLE[])))), 6) AS score FROM embeddings, qv),
dense AS (SELECT * FROM (SELECT item_id, vec_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, vec_id) AS rank FROM dsc) WHERE rank <= 40)"""


def _fused(w: str, extra: str = "") -> str:
    return f"""
d2 AS (SELECT item_id, vec_id AS doc_id, rank AS dense_rank FROM dense),
s2 AS (SELECT item_id, doc_id, rank AS sparse_rank FROM sparse),
both_ AS (SELECT coalesce(d2.item_id, s2.item_id) AS item_id, coalesce(d2.doc_id, s2.doc_id) AS doc_id, dense_rank, sparse_rank, round(coalesce(1.0 / (60 + dense_rank), 0) + coalesce({w} / (60 + sparse_rank), 0), 9) AS score FROM d2 FULL JOIN s2 ON d2.item_id = s2.item_id AND d2.doc_id = s2.doc_id),
fused AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, dense_rank ASC NULLS LAST, sparse_rank ASC NULLS LAST, doc_id) AS position FROM both_){extra}"""


def docs(spark, d) -> DataFrame:
    return table(spark, d, "documents")


def bench(spark, d) -> DataFrame:
    return table(spark, d, "benchmark")


def query_vectors(spark, d) -> DataFrame:
    emb = table(spark, d, "embeddings")
    n = emb.agg(F.count("*").alias("n"))
    return bench(spark, d).crossJoin(F.broadcast(n)).withColumn("vec_id", F.col("item_id") % F.col("n")).join(emb, "vec_id").select("item_id", F.col("embedding").alias("query"))


def dense(spark, d) -> DataFrame:
    return S.dense_topk(table(spark, d, "embeddings"), query_vectors(spark, d))


def sparse(spark, d) -> DataFrame:
    return S.sparse_topk(docs(spark, d), bench(spark, d))


def fused(spark, d, weights=(1.0, 1.0)) -> DataFrame:
    return S.rrf(dense(spark, d).withColumnRenamed("vec_id", "doc_id"), sparse(spark, d), ["item_id"], "doc_id", weights)


@query("bm25_postings", f"WITH {POSTINGS} SELECT doc_id, term, CAST(tf AS BIGINT) AS tf, round(weight, 6) AS weight FROM post")
def bm25_postings(spark, d):
    return S.index(docs(spark, d)).posts.select("doc_id", "term", "tf", F.round("weight", 6).alias("weight"))


@query("stemmed_terms", f"WITH {POSTINGS} SELECT term, stem FROM stems WHERE term IN (SELECT unnest(t) FROM tok)")
def stemmed_terms(spark, d):
    """Stem of each distinct term of the documents."""
    from ..functions.stem import stems

    return stems(S.tokens(docs(spark, d)).select("term").distinct()).select("term", "stem")


@query("bm25_idf", f"WITH {POSTINGS} SELECT term, CAST(df AS BIGINT) AS df, round(idf, 6) AS idf FROM idf")
def bm25_idf(spark, d):
    return S.index(docs(spark, d)).idf.select("term", "df", F.round("idf", 6).alias("idf"))


@query("bm25_topk", f"WITH {POSTINGS} SELECT item_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM sparse")
def bm25_topk(spark, d):
    return sparse(spark, d)


@query("dense_topk_cosine", f"WITH {DENSE} SELECT item_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM dense")
def dense_topk_cosine(spark, d):
    return dense(spark, d)


@query("rrf_fusion", f"WITH {POSTINGS}, {DENSE}, {_fused('1.0')} SELECT item_id, doc_id, CAST(dense_rank AS INTEGER) AS dense_rank, CAST(sparse_rank AS INTEGER) AS sparse_rank, score, CAST(position AS INTEGER) AS position FROM fused")
def rrf_fusion(spark, d):
    return fused(spark, d)


@query("rrf_weighted", f"WITH {POSTINGS}, {DENSE}, {_fused('3.0')} SELECT item_id, doc_id, score, CAST(position AS INTEGER) AS position FROM fused WHERE position <= 12")
def rrf_weighted(spark, d):
    return fused(spark, d, (1.0, 3.0)).where("position <= 12").select("item_id", "doc_id", "score", "position")


@query("hybrid_rrf_topk", f"WITH {POSTINGS}, {DENSE}, {_fused('1.0')} SELECT item_id, doc_id, score, CAST(position AS INTEGER) AS position, lang, source, substr(text, 1, 240) AS preview FROM fused JOIN documents USING (doc_id) WHERE position <= 12")
def hybrid_rrf_topk(spark, d):
    """Hybrid search: both branches, fusion, then text for the survivors alone; ids without a document fall away."""
    top = fused(spark, d).where("position <= 12").select("item_id", "doc_id", "score", "position")
    return docs(spark, d).select("doc_id", "lang", "source", F.substring("text", 1, 240).alias("preview")).join(top, "doc_id").select("item_id", "doc_id", "score", "position", "lang", "source", "preview")


@query("candidate_count", f"WITH {POSTINGS}, {DENSE}, {_fused('1.0')} SELECT item_id, count(*) AS n_candidates FROM fused GROUP BY item_id")
def candidate_count(spark, d):
    return fused(spark, d).groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_candidates"))


@query("filtered_search", f"WITH documents AS (SELECT * FROM main.documents WHERE source IN ('src1', 'src2', 'src3') AND lang IN ('en', 'fr')), {POSTINGS} SELECT item_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM sparse WHERE rank <= 12")
def filtered_search(spark, d):
    """Payload filters stand below the ranking, so top-k is taken among what passes."""
    own = docs(spark, d).where(F.col("source").isin("src1", "src2", "src3") & F.col("lang").isin("en", "fr"))
    return S.sparse_topk(own, bench(spark, d), 12)


_REWRITES = "rew AS (SELECT item_id, doc_id, score, 1 AS seq FROM sparse UNION ALL SELECT item_id, doc_id, round(score * (CASE WHEN doc_id % 3 = 0 THEN 2.0 ELSE 0.5 END), 6), 2 FROM sparse), best AS (SELECT item_id, doc_id, score, seq FROM (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY score DESC, seq) AS n FROM rew) WHERE n = 1)"


def rewritten(spark, d) -> DataFrame:
    first = sparse(spark, d).select("item_id", "doc_id", "score", F.lit(1).alias("seq"))
    second = first.select("item_id", "doc_id", F.round(F.col("score") * F.when(F.col("doc_id") % 3 == 0, 2.0).otherwise(0.5), 6).alias("score"), F.lit(2).alias("seq"))
    return S.best_score(first.unionByName(second), ["item_id"], "doc_id", "seq")


@query("dedupe_best_score", f"WITH {POSTINGS}, {_REWRITES} SELECT * FROM best")
def dedupe_best_score(spark, d):
    return rewritten(spark, d)


@query("pinned_first", f"WITH {POSTINGS}, {_REWRITES} SELECT item_id, doc_id, score, doc_id % 7 = 0 AS pinned, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY (doc_id % 7 = 0) DESC, score DESC, doc_id) AS rank FROM best WHERE doc_id % 11 <> 0) WHERE rank <= 20")
def pinned_first(spark, d):
    """Pinned rows lead; documents kept from an earlier round (here: id divisible by 11) are excluded first."""
    kept = docs(spark, d).where("doc_id % 11 = 0").select("doc_id")
    fresh = rewritten(spark, d).join(kept, "doc_id", "left_anti").withColumn("pinned", F.col("doc_id") % 7 == 0)
    return S.pinned_first(fresh, ["item_id"], "doc_id", 20).select("item_id", "doc_id", "score", "pinned", "rank")


_OVERLAP = f"""
qt AS (SELECT item_id, list_distinct({terms_sql("text")}) AS t FROM benchmark),
rr AS (SELECT s.item_id, s.doc_id, s.score, CASE WHEN len(qt.t) = 0 THEN 0.0 ELSE round(len(list_intersect(qt.t, tok.t)) / len(qt.t), 6) END AS rerank_score FROM sparse s JOIN qt USING (item_id) JOIN tok USING (doc_id)),
pr1 AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rerank_score DESC, doc_id) AS n FROM rr),
pruned AS (SELECT * FROM (SELECT item_id, doc_id, score AS retrieval_score, rerank_score, row_number() OVER (PARTITION BY item_id ORDER BY rerank_score DESC, doc_id) AS rank FROM pr1 WHERE n <= 3 OR rerank_score >= 0.01) WHERE rank <= 8)"""


def reranked(spark, d) -> DataFrame:
    top = sparse(spark, d).select("item_id", "doc_id", F.col("score").alias("retrieval_score"))
    text = docs(spark, d).select("doc_id", "text")
    q = bench(spark, d).select("item_id", F.col("text").alias("question"))
    return top.join(text, "doc_id").join(q, "item_id").select("item_id", "doc_id", "retrieval_score", F.round(S.token_overlap(F.col("question"), F.col("text")), 6).alias("rerank_score"))


def pruned(spark, d) -> DataFrame:
    return S.rerank_prune(reranked(spark, d), ["item_id"], "doc_id")


@query("rerank_prune", f"WITH {POSTINGS}, {_OVERLAP} SELECT item_id, doc_id, retrieval_score, rerank_score, CAST(rank AS INTEGER) AS rank FROM pruned")
def rerank_prune(spark, d):
    return pruned(spark, d)


@query("rerank_pinned", f"WITH {POSTINGS}, {_OVERLAP} SELECT item_id, doc_id, rerank_score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY (doc_id % 7 = 0) DESC, rerank_score DESC, doc_id) AS rank, count(*) FILTER (doc_id % 7 = 0) OVER (PARTITION BY item_id) AS pins FROM pr1 WHERE n <= 3 OR rerank_score >= 0.01 OR doc_id % 7 = 0) WHERE rank <= greatest(8, pins)")
def rerank_pinned(spark, d):
    """Pinned rows survive reranking; the cap widens to hold all of them."""
    from pyspark.sql import Window

    w = Window.partitionBy("item_id")
    r = S.ranked(reranked(spark, d), ["item_id"], [F.desc("rerank_score"), F.asc("doc_id")], name="n").withColumn("pinned", F.col("doc_id") % 7 == 0)
    r = r.where((F.col("n") <= 3) | (F.col("rerank_score") >= 0.01) | F.col("pinned")).withColumn("pins", F.count_if(F.col("pinned")).over(w))
    r = S.ranked(r, ["item_id"], [F.desc("pinned"), F.desc("rerank_score"), F.asc("doc_id")])
    return r.where("rank <= greatest(8, pins)").select("item_id", "doc_id", "rerank_score", "rank")


@query("rerank_fallback", f"WITH {POSTINGS} SELECT item_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM sparse WHERE rank <= 8")
def rerank_fallback(spark, d):
    """A reranker that is out of service scores null: the fused order stands, cut to eight."""
    r = sparse(spark, d).drop("rank").withColumn("rerank_score", F.lit(None).cast("double"))
    return S.ranked(r, ["item_id"], [F.desc_nulls_last("rerank_score"), F.desc("score"), F.asc("doc_id")], 8).select("item_id", "doc_id", "score", "rank")


_GRADED = f"""
lab AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
gr AS (SELECT item_id, doc_id, rerank_score, CASE WHEN quality = 1 THEN 0.9 WHEN quality = 0 THEN 0.3 END AS llm_score FROM pruned LEFT JOIN lab USING (doc_id)),
graded AS (SELECT item_id, doc_id, rerank_score, CASE WHEN llm_score IS NOT NULL THEN 'llm' ELSE 'rerank' END AS graded_by, coalesce(llm_score, rerank_score) AS score, CASE WHEN llm_score IS NOT NULL THEN llm_score >= 0.5 ELSE rerank_score >= 0.2 END AS relevant FROM gr)"""


def graded(spark, d) -> DataFrame:
    """Quality labels stand in for the grader; unlabelled documents fall back to the reranker."""
    lab = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    g = pruned(spark, d).join(lab, "doc_id", "left").withColumn("llm_score", F.when(F.col("quality") == 1, 0.9).when(F.col("quality") == 0, 0.3))
    return S.graded(g).select("item_id", "doc_id", "rerank_score", "graded_by", "score", "relevant")


@query("grade_fallback", f"WITH {POSTINGS}, {_OVERLAP}, {_GRADED} SELECT * FROM graded")
def grade_fallback(spark, d):
    return graded(spark, d)


@query(
    "sufficiency_decision",
    f"""WITH {POSTINGS}, {_OVERLAP}, {_GRADED},
ev AS (SELECT *, CASE WHEN graded_by = 'rerank' THEN score >= 0.2 ELSE score >= 0.55 END AS strong, CASE WHEN graded_by = 'rerank' THEN score >= 0.95 ELSE score >= 0.85 AND (rerank_score IS NULL OR rerank_score >= 0.5) END AS decisive FROM graded),
fl AS (SELECT item_id, count(*) FILTER (strong) AS n_evidence, max(CAST(strong AND doc_id % 7 = 0 AS INTEGER)) AS located, max(CAST(strong AND decisive AS INTEGER)) AS decisive, CASE WHEN item_id % 5 = 0 THEN 1 ELSE 2 END AS needed FROM ev GROUP BY item_id)
SELECT item_id, n_evidence, CASE WHEN n_evidence >= needed OR located = 1 OR decisive = 1 THEN 'answer' ELSE 'retry' END AS decision FROM fl""",
)
def sufficiency_decision(spark, d):
    ev = graded(spark, d).withColumns({"from_image": F.lit(False), "external": F.lit(False), "pinned": F.col("doc_id") % 7 == 0, "scoped": F.col("item_id") % 5 == 0})
    return S.sufficiency(ev).select("item_id", "n_evidence", "decision")


@query("sufficiency_last_round", f"""WITH {POSTINGS}, {_OVERLAP}, {_GRADED},
fl AS (SELECT item_id, count(*) FILTER (CASE WHEN graded_by = 'rerank' THEN score >= 0.9 ELSE false END) AS n FROM graded GROUP BY item_id)
SELECT item_id, CASE WHEN n >= 2 THEN 'answer' WHEN n >= 1 THEN 'answer' ELSE 'web' END AS decision FROM fl""")
def sufficiency_last_round(spark, d):
    """Third round with a strict reranker alone: what stays open goes to the web."""
    ev = graded(spark, d).withColumns({"score": F.when((F.col("graded_by") == "rerank") & (F.col("score") >= 0.9), 0.96).otherwise(0.0), "graded_by": F.lit("rerank"), "from_image": F.lit(False), "external": F.lit(False), "pinned": F.lit(False), "scoped": F.lit(False)})
    return S.sufficiency(ev, iteration=3).select("item_id", "decision")


@query(
    "retrieval_confidence",
    f"""WITH {POSTINGS}, {_OVERLAP}, {_GRADED}, r AS (SELECT *, greatest(0, least(1, score)) AS s, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS n FROM graded WHERE relevant)
SELECT item_id, round(avg(s) FILTER (n <= 3), 6) AS mean_top3, round(max(s), 6) AS top_score, count(*) AS n_relevant, CASE WHEN count(*) FILTER (graded_by = 'llm') = count(*) THEN 'llm' WHEN count(*) FILTER (graded_by = 'rerank') = count(*) THEN 'rerank' ELSE 'mixed' END AS basis FROM r GROUP BY item_id""",
)
def retrieval_confidence(spark, d):
    return S.confidence(graded(spark, d).where("relevant"))


@query("cap_evidence", f"WITH {POSTINGS}, {_OVERLAP}, {_GRADED} SELECT item_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM graded WHERE relevant) WHERE rank <= 4")
def cap_evidence(spark, d):
    return S.ranked(graded(spark, d).where("relevant"), ["item_id"], [F.desc("score"), F.asc("doc_id")], 4).select("item_id", "doc_id", "score", "rank")


@query("next_queries", "SELECT item_id, list_filter(['alpha beta', 'gamma', lower(substr(text, 1, 20))], lambda x: x <> 'alpha beta') AS queries FROM benchmark")
def next_queries(spark, d):
    """Rewrites that have not been tried, whatever their case."""
    b = bench(spark, d).withColumn("rewrites", F.array(F.lit("alpha beta"), F.lit("gamma"), F.lower(F.substring("text", 1, 20))))
    tried = F.array(F.lower(F.lit("Alpha BETA")))
    return b.select("item_id", F.filter("rewrites", lambda x: ~F.array_contains(tried, F.lower(x))).alias("queries"))


@query("kb_scroll", "SELECT vec_id, label FROM embeddings WHERE label = 3 ORDER BY vec_id LIMIT 100")
def kb_scroll(spark, d):
    return table(spark, d, "embeddings").where("label = 3").orderBy("vec_id").limit(100).select("vec_id", "label")
