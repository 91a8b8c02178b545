"""Ranking and answer metrics, and their roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def relevant(doc: Column, page: Column, labels: Column, pages: Column) -> Column:
    """A result counts if its document is labelled and, where pages are labelled, its page is among them (no page: it is not)."""
    return F.array_contains(labels, doc) & ((F.size(pages) == 0) | F.coalesce(F.array_contains(pages, page), F.lit(False)))


def ranking_metrics(results: DataFrame, n_labels: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """Per question and k: precision (over what was returned), recall over distinct labels, hit; and the reciprocal rank of the whole list.

    results: item_id, doc_id, rank, relevant.  n_labels: item_id, n_labels (answerable questions).
    """
    cols = [F.coalesce(1 / F.min(F.when(F.col("relevant"), F.col("rank"))), F.lit(0.0)).alias("rr")]
    for k in ks:
        inside = F.col("rank") <= k
        hits = F.count_if(inside & F.col("relevant"))
        cols += [
            F.coalesce(hits / F.nullif(F.count_if(inside), F.lit(0)), F.lit(0.0)).alias(f"p{k}"),
            F.count_distinct(F.when(inside & F.col("relevant"), F.col("doc_id"))).alias(f"found{k}"),
            F.max(F.when(inside & F.col("relevant"), 1).otherwise(0)).alias(f"hit{k}"),
        ]
    out = n_labels.join(results.groupBy("item_id").agg(*cols), "item_id", "left")
    keep = ["item_id", F.coalesce("rr", F.lit(0.0)).alias("rr")]
    for k in ks:
        keep += [F.coalesce(f"p{k}", F.lit(0.0)).alias(f"precision_{k}"), F.coalesce(F.col(f"found{k}") / F.col("n_labels"), F.lit(0.0)).alias(f"recall_{k}"), F.coalesce(f"hit{k}", F.lit(0)).alias(f"hit_{k}")]
    return out.select(*keep)


def answer_scores(answers: DataFrame) -> DataFrame:
    """abstention_correct, citation_precision, citations_resolve, answer_contains of each answer.

    answers: unanswerable, abstained, cited array, labels array, unresolved, total, expected array, answer.
    """
    hits = F.size(F.filter("cited", lambda x: F.array_contains(F.col("labels"), x)))
    found = F.size(F.filter("expected", lambda e: F.contains(F.lower("answer"), F.lower(e))))
    un, ab = F.col("unanswerable"), F.col("abstained")
    return answers.withColumns(
        {
            "abstention_correct": (un == ab).cast("double"),
            "citation_precision": F.when(un, ab.cast("double")).when(ab, 0.0).when(F.size("cited") == 0, 0.0).otherwise(hits / F.size("cited")),
            "citations_resolve": F.when(ab | (F.col("total") == 0), 1.0).otherwise((F.col("total") - F.col("unresolved")) / F.col("total")),
            "answer_contains": F.when(un, 1.0).when(ab, 0.0).when(F.size("expected") == 0, 1.0).otherwise(found / F.size("expected")),
        }
    )


def share(hit: Column, of: Column) -> Column:
    """Share of rows in `of` that are also `hit`; 0 where there are none."""
    return F.coalesce(F.count_if(hit & of) / F.nullif(F.count_if(of), F.lit(0)), F.lit(0.0))


def run_rollup(scores: DataFrame, by: list[str]) -> DataFrame:
    """Means of a run's scores, and the two abstention rates with their own denominators."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c)
    return scores.groupBy(*by).agg(
        F.count("*").alias("n"), mean("abstention_correct"), mean("citation_precision"), mean("citations_resolve"), mean("answer_contains"),
        F.round(share(~F.col("abstained"), F.col("unanswerable")), 6).alias("false_answer_rate"), F.round(share(F.col("abstained"), ~F.col("unanswerable")), 6).alias("over_abstention_rate"),
        F.round(F.median("latency_ms"), 6).alias("median_latency_ms"),
    )


def report(rollup: DataFrame, metrics: list[str]) -> DataFrame:
    """One markdown table of a roll-up: a line a metric, a column a mode."""
    lines = rollup.select("mode", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("x")).select("mode", "x.*")
    wide = lines.groupBy("metric").pivot("mode", ["agentic", "naive"]).agg(F.first("v"))
    row = F.format_string("| %s | %.1f%% | %.1f%% |", "metric", F.col("agentic") * 100, F.col("naive") * 100)
    return wide.agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("body")).select(F.concat(F.lit("| metric | agentic | naive |\n|---|---|---|\n"), "body").alias("markdown"))
