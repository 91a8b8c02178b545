"""The question loop over a batch: retrieve, rerank, grade, decide; undecided questions go on, three rounds at most.

What a round keeps is evidence in all later ones and is not searched for again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import keyword_query
from ..session import settled
from . import search as S

ROUNDS, WIDTH = 3, 20


def evidence(asked: DataFrame, docs: DataFrame, width: int = WIDTH, known: DataFrame | None = None) -> DataFrame:
    """Relevant passages of each question, by the default scorers.

    asked: item_id, text (the question, which passages are reranked against) and wording (what is
    searched).  known: pairs (item_id, doc_id) that earlier rounds kept; they make room for others.
    """
    top = S.sparse_topk(docs, asked.select("item_id", F.col("wording").alias("text")), width, known).select("item_id", "doc_id")
    passages = top.join(docs.select("doc_id", F.col("text").alias("passage")), "doc_id").join(asked, "item_id")
    scored = passages.select("item_id", "doc_id", F.round(S.token_overlap(F.col("text"), F.col("passage")), 6).alias("rerank_score"))
    kept = S.rerank_prune(scored, ["item_id"], "doc_id").withColumn("llm_score", F.lit(None).cast("double"))
    return S.graded(kept).where("relevant").select("item_id", "doc_id", "score", "rerank_score", "graded_by", F.lit(False).alias("from_image"), F.lit(False).alias("external"), F.lit(False).alias("pinned"), F.lit(False).alias("scoped"))


def outside(found: DataFrame, image: bool) -> DataFrame:
    """Rows (item_id, doc_id, score) of a reading of images or of a web search, as evidence."""
    return found.select("item_id", "doc_id", "score", F.lit(None).cast("double").alias("rerank_score"), F.lit("llm").alias("graded_by"), F.lit(image).alias("from_image"), F.lit(not image).alias("external"), F.lit(False).alias("pinned"), F.lit(False).alias("scoped"))


def agentic(questions: DataFrame, docs: DataFrame, rounds: int = ROUNDS, images: DataFrame | None = None, web: DataFrame | None = None) -> DataFrame:
    """item_id, decision (answer or abstain), iteration, n_evidence.

    A round is one set of jobs for all open questions; the second asks their keyword forms, the
    third the questions again, past what is known.  Rounds are a constant, so the plan is too.
    Questions still open then meet what was read in `images` and after that what `web` returned
    (both item_id, doc_id, score; without the table the step is left out).
    """
    text, words = F.col("text"), keyword_query(F.col("text"))
    asked = questions.select("item_id", "text", text.alias("wording"))
    kept, out = None, None

    def judged(evidence: DataFrame, iteration: int) -> DataFrame:
        """The open questions with their decision and evidence count; those without any evidence are undecided."""
        found = S.sufficiency(evidence, iteration=iteration, web_enabled=False).select("item_id", "decision", "n_evidence")
        return settled(asked.join(found, "item_id", "left").withColumns({"decision": F.coalesce("decision", F.lit("abstain")), "n_evidence": F.coalesce("n_evidence", F.lit(0))}))

    def close(state: DataFrame, which: Column, k: int) -> DataFrame:
        done = state.where(which).select("item_id", "decision", F.lit(k).alias("iteration"), "n_evidence")
        return done if out is None else out.unionByName(done)

    for k in range(1, rounds + 1):
        new = evidence(asked, docs, known=kept)
        kept = settled(new if kept is None else kept.join(asked.select("item_id"), "item_id", "left_semi").unionByName(new))
        state = judged(kept, ROUNDS)
        out = close(state, F.col("decision") == "answer", k)
        state = state.where("decision <> 'answer'")
        wording = F.when((words != "") & (F.lower(words) != F.lower(text)), words).otherwise(text) if k == 1 else text
        asked = state.select("item_id", "text", wording.alias("wording"))
    for found, image in ((images, True), (web, False)):
        if found is not None:
            kept = kept.unionByName(outside(found, image))
            state = judged(kept, ROUNDS)
            out = close(state, F.col("decision") == "answer", rounds)
            state = state.where("decision <> 'answer'")
            asked = state.select("item_id", "text", text.alias("wording"))
    return close(state, F.lit(True), rounds)


def naive(questions: DataFrame, docs: DataFrame) -> DataFrame:
    """item_id, decision, iteration: one search of twelve, answered if there is anything at all."""
    n = S.sparse_topk(docs, questions, 12).groupBy("item_id").agg(F.count("*").alias("n"))
    return questions.join(n, "item_id", "left").select("item_id", F.when(F.coalesce("n", F.lit(0)) > 0, "answer").otherwise("abstain").alias("decision"), F.lit(1).alias("iteration"))


def compare(questions: DataFrame, docs: DataFrame) -> DataFrame:
    """item_id, agentic, naive: both modes' decisions side by side."""
    both = agentic(questions, docs).drop("n_evidence").withColumn("mode", F.lit("agentic")).unionByName(naive(questions, docs).withColumn("mode", F.lit("naive")))
    return both.groupBy("item_id").pivot("mode", ["agentic", "naive"]).agg(F.first("decision"))


def abstention_text(grading_failed: Column, limited: Column) -> Column:
    """What an abstaining answer says."""
    return F.when(grading_failed, "The passages could not be judged, so no answer is given.").when(limited, "Only part of the library could be checked, and it holds no answer.").otherwise("The library does not hold enough evidence for an answer.")
