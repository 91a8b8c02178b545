"""Queries of the question loop's stages over whole tables: many searches at once, grading in batches, answers, streamed frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answer as A
from ..operators import documents as D
from ..operators import frames as E
from ..operators import grading as G
from ..operators import multi as M
from ..operators import search as S
from ..registry import query
from ..session import settled
from ..sources.readers import table
from .retrieval import POSTINGS, bench, docs, sparse, terms_sql
from .texts import SENTENCES

#: The first eight words.
_OPENING = r"^(\S+\s+){0,7}\S+"
_PAYLOAD = "pay AS (SELECT doc_id, ['text', 'image', 'audio'][doc_id % 3 + 1] AS modality, CASE doc_id % 4 WHEN 0 THEN 'chart' WHEN 1 THEN 'table' END AS region_type, CAST(doc_id % 50 + 1 AS INTEGER) AS page FROM documents)"
_PLANS = """plans AS (SELECT item_id, 0 AS w, 0 AS seq, 'rewrite' AS kind, 20 AS width FROM benchmark UNION ALL SELECT item_id, 1, 1, 'rewrite', 20 FROM benchmark
UNION ALL SELECT item_id, 0, 2, 'hint', 20 FROM benchmark WHERE item_id % 2 = 0
UNION ALL SELECT item_id, 0, 2 + CASE WHEN item_id % 2 = 0 THEN 1 ELSE 0 END, 'region', 8 FROM benchmark WHERE item_id % 3 = 0
UNION ALL SELECT item_id, 0, 3 + CASE WHEN item_id % 2 = 0 THEN 1 ELSE 0 END, 'image', 6 FROM benchmark WHERE item_id % 3 = 0
UNION ALL SELECT item_id, 0, 2 + CASE WHEN item_id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN item_id % 3 = 0 THEN 2 ELSE 0 END, 'page', 6 FROM benchmark WHERE item_id % 5 = 0)"""
_MULTI = f"""{POSTINGS}, {_PAYLOAD}, {_PLANS},
words AS (SELECT item_id, 0 AS w, term FROM q UNION ALL SELECT DISTINCT item_id, 1, stem FROM (SELECT item_id, unnest({terms_sql(f"regexp_extract(text, '{_OPENING}')")}) AS term FROM benchmark) JOIN stems USING (term)),
scored AS (SELECT item_id, w, doc_id, round(sum(weight * idf), 6) AS score FROM post JOIN words USING (term) JOIN idf USING (term) GROUP BY ALL),
fit AS (SELECT p.item_id, p.seq, p.kind, p.width, doc_id, score FROM plans p JOIN scored s ON s.item_id = p.item_id AND s.w = p.w JOIN pay USING (doc_id)
WHERE p.kind = 'rewrite' OR p.kind = 'hint' AND modality = 'audio' OR p.kind = 'region' AND region_type IN ('chart', 'table') OR p.kind = 'image' AND modality = 'image' OR p.kind = 'page' AND page = p.item_id % 50 + 1),
found AS (SELECT item_id, seq, kind, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id, seq ORDER BY score DESC, doc_id) AS rank FROM fit) WHERE rank <= width)"""


def _found(spark, d):
    i = F.col("item_id")
    q = bench(spark, d).select(
        "item_id", F.array(F.col("text"), F.regexp_extract("text", _OPENING, 0)).alias("rewrites"), F.when(i % 2 == 0, "audio").alias("hint"),
        F.when(i % 5 == 0, F.array((i % 50 + 1).cast("int"))).otherwise(F.array().cast("array<int>")).alias("pages"), F.when(i % 3 == 0, F.array(F.lit("chart"), F.lit("table"))).otherwise(F.array().cast("array<string>")).alias("types"),
    )
    m = F.col("doc_id")
    payload = docs(spark, d).select("doc_id", F.element_at(F.array(F.lit("text"), F.lit("image"), F.lit("audio")), (m % 3 + 1).cast("int")).alias("modality"), F.when(m % 4 == 0, "chart").when(m % 4 == 1, "table").alias("region_type"), (m % 50 + 1).cast("int").alias("page"))
    return M.multi_search(S.index(docs(spark, d)), payload, D.plan_searches(q))


@query("multi_search", f"WITH {_MULTI} SELECT item_id, CAST(seq AS INTEGER) AS seq, kind, doc_id, score, CAST(rank AS INTEGER) AS rank FROM found")
def multi_search(spark, d):
    """Rewrites, hinted modality, regions, images and named pages of every question, each ranked among what passes its filters."""
    return _found(spark, d)


@query("multi_search_merged", f"WITH {_MULTI} SELECT item_id, doc_id, score, pinned, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY pinned DESC, score DESC, doc_id) AS rank FROM (SELECT item_id, doc_id, max(score) AS score, bool_or(kind = 'page') AS pinned FROM found WHERE doc_id % 11 <> 0 GROUP BY item_id, doc_id)) WHERE rank <= 20")
def multi_search_merged(spark, d):
    """One list a question: rows of named pages first, without what an earlier round kept."""
    found = settled(_found(spark, d))
    return M.merged(found, 20, found.where("doc_id % 11 = 0").select("item_id", "doc_id").distinct())


class _Lengths:
    """A grader that goes by a passage's length; it invents an index, passes over some passages, and fails by the question's length."""

    def __init__(self, limited: int, broken: int | None = None):
        self.limited, self.broken = limited, broken

    def grade(self, question: str, passages: list[str]) -> list[tuple[int, bool, float]]:
        if len(question) % self.limited == 1:
            raise G.RateLimited("quota")
        if self.broken and len(question) % self.broken == 2:
            raise ValueError("malformed reply")
        return [(99, True, 1.0), *((i, len(p) % 10 >= 5, len(p) % 10 / 10) for i, p in enumerate(passages) if len(p) % 7)]


def _graded(spark, d):
    top = sparse(spark, d).where("rank <= 30").select("item_id", "doc_id", F.col("rank").alias("place"))
    c = top.join(docs(spark, d).select("doc_id", F.substring("text", 1, 2000).alias("passage")), "doc_id").join(bench(spark, d).select("item_id", F.col("text").alias("question")), "item_id")
    c = c.withColumn("rerank_score", F.when(F.col("item_id") % 7 != 0, (F.col("doc_id") % 10) / 10))
    return G.grade_chain(c, [("fast", lambda: _Lengths(3, 5)), ("second", lambda: _Lengths(4))])


_CHAIN = f"""{POSTINGS},
cand AS (SELECT s.item_id, s.doc_id, CAST((s.rank - 1) // 12 AS INTEGER) AS batch, length(b.text) AS nq, length(substr(d.text, 1, 2000)) AS n, CASE WHEN s.item_id % 7 <> 0 THEN s.doc_id % 10 / 10 END AS rr FROM sparse s JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id) WHERE s.rank <= 30),
chain AS (SELECT *, CASE WHEN nq % 3 <> 1 AND nq % 5 = 2 THEN 'failed' WHEN nq % 3 <> 1 THEN 'fast' WHEN nq % 4 = 1 THEN 'failed' ELSE 'second' END AS grader FROM cand),
verdict AS (SELECT item_id, batch, doc_id, CASE WHEN grader <> 'failed' THEN n % 7 > 0 AND n % 10 >= 5 ELSE coalesce(rr >= 0.2, false) END AS relevant, CASE WHEN grader <> 'failed' THEN CASE WHEN n % 7 > 0 THEN n % 10 / 10 END ELSE rr END AS score,
CASE WHEN grader <> 'failed' THEN CASE WHEN n % 7 > 0 THEN grader END WHEN rr IS NOT NULL THEN 'rerank' END AS graded_by, grader = 'failed' AS llm_failed FROM chain),
state AS (SELECT item_id, count(*) FILTER (relevant) AS n_kept, coalesce(bool_or(graded_by IN ('fast', 'second')), false) AS llm_graded, bool_or(llm_failed) AS llm_failed, bool_or(llm_failed) AND NOT bool_or(graded_by IS NOT NULL) AS grade_failed FROM verdict GROUP BY item_id)"""


@query("grade_chain", f"WITH {_CHAIN} SELECT item_id, batch, doc_id, relevant, score, graded_by, llm_failed FROM verdict")
def grade_chain(spark, d):
    """Thirty candidates a question in batches of twelve; batches fail, run out of quota, and fall to the second grader or the reranker."""
    return _graded(spark, d)


@query("grading_state", f"WITH {_CHAIN} SELECT * FROM state")
def grading_state(spark, d):
    return G.grading_state(_graded(spark, d))


@query("abstention_text", f"WITH {_CHAIN} SELECT item_id, CASE WHEN grade_failed THEN 'The passages could not be judged, so no answer is given.' WHEN llm_failed AND NOT llm_graded THEN 'Only part of the library could be checked, and it holds no answer.' ELSE 'The library does not hold enough evidence for an answer.' END AS answer FROM state")
def abstention_text(spark, d):
    """What every question would say if nothing could be quoted, by how its grading went."""
    state = G.grading_state(_graded(spark, d))
    none = docs(spark, d).where("text is null and text is not null").select(F.col("doc_id").alias("item_id"), F.lit(1).alias("n"), "text")
    asked = bench(spark, d).join(state.select("item_id"), "item_id", "left_semi")
    return A.answers(asked, none, state).select("item_id", "answer")


def _answer_sql(most: int = A.SENTENCES, chars: int = A.CHARS) -> str:
    worth = f"{A.NEW} * len(list_filter(terms, lambda t: NOT list_contains(said, t))) - len(list_filter(terms, lambda t: list_contains(said, t)))"
    return f"""{POSTINGS}, {SENTENCES},
ev AS (SELECT item_id, doc_id, CAST(rank AS INTEGER) AS n FROM sparse WHERE rank <= 4),
sen AS (SELECT item_id, n, pos, trim(replace(x, chr(2), '.')) AS sentence, asked FROM (SELECT item_id, n, unnest(s) AS x, CAST(generate_subscripts(s, 1) AS INTEGER) - 1 AS pos FROM ev JOIN sp USING (doc_id)) JOIN (SELECT item_id, t AS asked FROM qtok) USING (item_id)),
cand AS (SELECT item_id, n, pos, sentence, list_sort(list_distinct(list_intersect({terms_sql("sentence")}, asked))) AS terms FROM sen WHERE length(sentence) <= {chars}),
pick AS (SELECT item_id, 0 AS k, 0 AS n, 0 AS pos, '' AS sentence, CAST([] AS VARCHAR[]) AS said, 0 AS used FROM benchmark
UNION ALL SELECT item_id, k, n, pos, sentence, said, used FROM (SELECT c.item_id, p.k + 1 AS k, c.n, c.pos, c.sentence, list_distinct(list_concat(p.said, c.terms)) AS said, p.used + length(c.sentence) AS used,
row_number() OVER (PARTITION BY c.item_id ORDER BY {worth} DESC, c.n, c.pos) AS r FROM pick p JOIN cand c USING (item_id) WHERE p.k < {most} AND len(list_filter(c.terms, lambda t: NOT list_contains(p.said, t))) > 0 AND p.used + length(c.sentence) <= {chars}) WHERE r = 1)"""


@query(
    "answers",
    f"""WITH RECURSIVE {_answer_sql()} SELECT b.item_id, coalesce(string_agg(sentence || ' [^' || n || ']', ' ' ORDER BY n, pos), 'The library does not hold enough evidence for an answer.') AS answer, CAST(count(p.item_id) AS INTEGER) AS n_sentences, count(p.item_id) = 0 AS abstained
FROM benchmark b LEFT JOIN (SELECT * FROM pick WHERE k > 0) p USING (item_id) GROUP BY b.item_id""",
)
def answers(spark, d):
    """Quoted answers from the four best documents of every question: coverage of its terms, less what is said already, in 600 characters."""
    ev = sparse(spark, d).where("rank <= 4").join(docs(spark, d).select("doc_id", "text"), "doc_id").select("item_id", F.col("rank").alias("n"), "text")
    return A.answers(bench(spark, d), ev)


def _fragments(spark, d):
    """Turns as data frames of a stream, cut every seven characters; every fifth is malformed, some are comments, and turn 9 ends the stream."""
    c, t = table(spark, d, "conversations"), F.col("turn")
    body = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices")))
    frame = F.when(t == 9, "data: [DONE]").when(t % 5 == 4, "data: {broken").when(t % 5 == 3, F.concat(F.lit("event: delta\ndata:"), body)).otherwise(F.concat(F.lit("data: "), body))
    whole = F.concat(F.when(t % 4 == 1, ": keep-alive\n\n").otherwise(""), frame, F.lit("\n\n"))
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length(whole) - 1) / 7).cast("int")), lambda i: F.substring(whole, i * 7 + 1, F.lit(7)))
    return c.select("conv_id", "turn", F.posexplode(pieces).alias("piece", "text"))


@query("sse_frames", "WITH c AS (SELECT *, min(CASE WHEN turn = 9 THEN turn END) OVER (PARTITION BY conv_id) AS stop FROM conversations) SELECT conv_id, count(*) AS n, string_agg(text, '' ORDER BY turn) AS said FROM c WHERE turn % 5 <> 4 AND coalesce(text, '') <> '' AND (stop IS NULL OR turn < stop) GROUP BY conv_id")
def sse_frames(spark, d):
    """Streams put together from fragments that are cut anywhere, also between the two line ends that part frames."""
    found = E.deltas(E.frames(_fragments(spark, d), ["conv_id"], ["turn", "piece"]), ["conv_id"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("frame", "delta"))), lambda x: x["delta"]), "")
    return found.groupBy("conv_id").agg(F.count("*").alias("n"), text.alias("said"))
