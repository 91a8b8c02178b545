"""Grading of candidates in batches, by a chain of graders and at last the reranker's score."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settled
from .scorers import BATCH, loaded

FLOOR = 0.2  # a reranker's score that stands for relevance
OUTCOME = "relevant boolean, score double, outcome string"


class RateLimited(RuntimeError):
    """A grader's quota is spent: the next grader is asked."""


class Grader(Protocol):
    def grade(self, question: str, passages: list[str]) -> list[tuple[int, bool, float]]:
        """(index of the passage, relevant, score from 0 to 1); indexes that no passage has are ignored."""
        ...


def graded_by(batches: DataFrame, make: Callable[[], Grader], name: str) -> DataFrame:
    """batches (item_id, batch, doc_id, place, question, passage, rerank_score) with relevant, score and outcome: graded, silent, limited or failed.

    One batch is one call.  A call that fails takes down no other batch; a passage of which the
    grader says nothing is silent.
    """
    columns = [f.name for f in batches.schema.fields]

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("place", kind="stable").reset_index(drop=True)
        relevant, score, outcome = [None] * len(p), [None] * len(p), ["silent"] * len(p)
        try:
            for i, good, value in loaded(name, make).grade(p["question"].iloc[0], p["passage"].tolist()):
                if 0 <= i < len(p):
                    relevant[i], score[i], outcome[i] = bool(good), min(1.0, max(0.0, float(value))), "graded"
        except RateLimited:
            outcome = ["limited"] * len(p)
        except Exception as e:  # noqa: BLE001 - a model's failure is a row's outcome, whatever its kind
            outcome = [f"failed: {type(e).__name__}"] * len(p)
        return p.assign(relevant=pd.array(relevant, "boolean"), score=pd.array(score, "Float64"), outcome=outcome)[[*columns, "relevant", "score", "outcome"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batches.schema.fields)
    return batches.groupBy("item_id", "batch").applyInPandas(run, f"{schema}, {OUTCOME}")


def grade_chain(candidates: DataFrame, graders: list[tuple[str, Callable[[], Grader]]], size: int = BATCH["grade"], floor: float = FLOOR) -> DataFrame:
    """item_id, batch, doc_id, relevant, score, graded_by (a grader's name, rerank or null), llm_failed.

    candidates: item_id, doc_id, place (from 1), question, passage, rerank_score.  Batches that the
    first grader's quota does not reach go to the next one, and only those.  What no grader judged
    is judged by the reranker's score where there is one.  A grader's verdict is never overruled:
    rows that it passed over in silence are not evidence.
    """
    columns = ["item_id", "batch", "doc_id", "place", "question", "passage", "rerank_score"]
    left = candidates.withColumn("batch", F.floor((F.col("place") - 1) / size).cast("int")).select(*columns)
    done = None
    for k, (name, make) in enumerate(graders):
        # A model is asked once: its answers are stored before anything reads them.
        seen = settled(graded_by(left, make, name)).withColumn("grader", F.lit(name))
        more = k + 1 < len(graders)
        over = seen.where("outcome <> 'limited'") if more else seen
        done = over if done is None else done.unionByName(over)
        left = seen.where("outcome = 'limited'").select(*columns)
    if done is None:
        done = left.withColumns({"relevant": F.lit(None).cast("boolean"), "score": F.lit(None).cast("double"), "outcome": F.lit("none"), "grader": F.lit(None).cast("string")})
    judged, silent = F.col("outcome") == "graded", F.col("outcome") == "silent"
    by_rank = ~judged & ~silent & F.col("rerank_score").isNotNull()
    return done.select(
        "item_id", "batch", "doc_id", F.when(judged, F.col("relevant")).when(by_rank, F.col("rerank_score") >= floor).otherwise(False).alias("relevant"),
        F.when(judged, F.col("score")).when(by_rank, F.col("rerank_score")).alias("score"), F.when(judged, F.col("grader")).when(by_rank, "rerank").alias("graded_by"), (F.col("outcome").startswith("failed") | (F.col("outcome") == "limited")).alias("llm_failed"),
    )


def grading_state(graded: DataFrame) -> DataFrame:
    """item_id, n_kept, llm_graded, llm_failed, grade_failed: what an answer has to say about its grading."""
    by_model = F.col("graded_by").isNotNull() & (F.col("graded_by") != "rerank")
    g = graded.groupBy("item_id").agg(F.count_if("relevant").alias("n_kept"), F.max(by_model).alias("llm_graded"), F.max("llm_failed").alias("llm_failed"), F.max(F.col("graded_by").isNotNull()).alias("judged"))
    return g.select("item_id", "n_kept", "llm_graded", "llm_failed", (F.col("llm_failed") & ~F.col("judged")).alias("grade_failed"))
