"""Default answers without a model: sentences of the evidence, chosen for what they add, with citation markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bm25_terms, split_sentences
from .loop import abstention_text

SENTENCES, CHARS = 4, 600
#: A question's term that is new weighs as much as this many that are repeated.
NEW = 4


def candidate_sentences(evidence: DataFrame, questions: DataFrame, chars: int = CHARS) -> DataFrame:
    """item_id, n, pos, sentence, terms (of the question, sorted): sentences that hold a term of the question and fit the budget.

    evidence: item_id, n (the source's number, from 1), text.  questions: item_id, text.
    """
    asked = questions.select("item_id", F.array_distinct(bm25_terms(F.col("text"))).alias("asked"))
    s = evidence.select("item_id", "n", F.posexplode(split_sentences(F.col("text"))).alias("pos", "sentence")).withColumn("sentence", F.trim("sentence"))
    s = s.where(F.length("sentence") <= chars).join(asked, "item_id").withColumn("terms", F.array_sort(F.array_intersect(bm25_terms(F.col("sentence")), F.col("asked"))))
    return s.where(F.size("terms") > 0).select("item_id", "n", "pos", "sentence", "terms")


def chosen_sentences(candidates: DataFrame, most: int = SENTENCES, chars: int = CHARS) -> DataFrame:
    """item_id, picks: array of (n, pos, sentence) in the order of choice.

    Each round takes the sentence that fits what is left of the budget and has the greatest worth,
    NEW for a term not said yet less one for a term said already; it must say something new.
    Among equals the earlier source and sentence win.  A question's candidates are those of its
    few sources, so a round is a pass over one array.
    """
    item = F.struct("n", "pos", "sentence", "terms")
    c = candidates.groupBy("item_id").agg(F.array_sort(F.collect_list(item)).alias("c"))
    kind = "array<struct<n:int,pos:int,sentence:string,terms:array<string>>>"
    start = F.struct(F.array().cast(kind).alias("picks"), F.array().cast("array<string>").alias("said"), F.lit(0).alias("chars"))

    def worth(x: Column, said: Column) -> Column:
        old = F.size(F.array_intersect(x["terms"], said))
        return (F.size(x["terms"]) - old) * NEW - old

    def step(s: Column, _: Column) -> Column:
        fits = F.filter(F.col("c"), lambda x: (F.size(F.array_except(x["terms"], s["said"])) > 0) & (F.length(x["sentence"]) + s["chars"] <= chars))
        # The struct's order puts the greatest worth first, then the earlier sentence.
        best = F.array_min(F.transform(fits, lambda x: F.struct((-worth(x, s["said"])).alias("w"), x["n"].alias("n"), x["pos"].alias("pos"), x["sentence"].alias("sentence"), x["terms"].alias("terms"))))
        pick = F.struct(best["n"].alias("n"), best["pos"].alias("pos"), best["sentence"].alias("sentence"), best["terms"].alias("terms"))
        return F.when(F.size(fits) == 0, s).otherwise(F.struct(F.concat(s["picks"], F.array(pick)).alias("picks"), F.array_union(s["said"], best["terms"]).alias("said"), (s["chars"] + F.length(best["sentence"])).alias("chars")))

    cast = c.withColumn("c", F.col("c").cast(kind))
    return cast.select("item_id", F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step, lambda s: s["picks"]).alias("picks"))


def answers(questions: DataFrame, evidence: DataFrame, state: DataFrame | None = None, most: int = SENTENCES, chars: int = CHARS) -> DataFrame:
    """item_id, answer, n_sentences, abstained: the chosen sentences in the order of their sources, each with its marker [^n].

    A question without a sentence to quote abstains, with the reason that its grading state
    (grading_state) gives; without a state the library holds too little.
    """
    picks = chosen_sentences(candidate_sentences(evidence, questions, chars), most, chars)
    out = questions.select("item_id").join(picks, "item_id", "left")
    failed, limited = F.lit(False), F.lit(False)
    if state is not None:
        out = out.join(state.select("item_id", "grade_failed", (F.col("llm_failed") & ~F.col("llm_graded")).alias("limited")), "item_id", "left")
        failed, limited = F.coalesce("grade_failed", F.lit(False)), F.coalesce("limited", F.lit(False))
    n = F.coalesce(F.size("picks"), F.lit(0))
    n = F.when(n > 0, n).otherwise(0)
    said = F.array_join(F.transform(F.array_sort("picks"), lambda x: F.concat(x["sentence"], F.lit(" [^"), x["n"].cast("string"), F.lit("]"))), " ")
    return out.select("item_id", F.when(n > 0, said).otherwise(abstention_text(failed, limited)).alias("answer"), n.alias("n_sentences"), (n == 0).alias("abstained"))
