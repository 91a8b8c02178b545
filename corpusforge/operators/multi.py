"""Many searches of many questions in one pass over the stored postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import search as S

#: Results of one search at most, whatever its own width.
WIDEST = 100


def passes(p: Column, modality: Column, region_type: Column, page: Column) -> Column:
    """Whether a row may answer a search: one of its types (a modality or a kind of region) and one of its pages, where it names some."""
    typed = (F.size(p["types"]) == 0) | F.coalesce(F.array_contains(p["types"], modality), F.lit(False)) | F.coalesce(F.array_contains(p["types"], region_type), F.lit(False))
    paged = (F.size(p["pages"]) == 0) | F.coalesce(F.array_contains(p["pages"], page), F.lit(False))
    return typed & paged


def multi_search(index: S.Index, payload: DataFrame, plans: DataFrame) -> DataFrame:
    """item_id, seq, kind, doc_id, score, rank: the best rows of every search.

    payload: doc_id, modality, region_type, page.  plans: item_id, seq, kind, query, pages, types, width
    (plan_searches).  Searches of a question with one wording share its scores; a scored row meets
    the searches of its wording with its own payload, so each ranking is taken among what passes.
    """
    plan = F.struct("seq", "kind", "pages", "types", "width")
    asked = plans.groupBy("item_id", "query").agg(F.min("seq").alias("wording"), F.collect_list(plan).alias("plans"))
    terms = asked.select("item_id", "wording", F.explode(F.array_distinct(S.bm25_terms(F.col("query")))).alias("term"))
    terms = S.stemmed(terms).distinct().join(index.idf, "term")
    scores = S.scored(index.posts, terms, ["item_id", "wording"])
    met = scores.join(payload.select("doc_id", "modality", "region_type", "page"), "doc_id").join(asked.drop("query"), ["item_id", "wording"])
    fit = met.select("item_id", "doc_id", "score", F.explode(F.filter("plans", lambda p: passes(p, F.col("modality"), F.col("region_type"), F.col("page")))).alias("p"))
    fit = fit.select("item_id", "p.seq", "p.kind", "p.width", "doc_id", "score")
    return S.ranked(fit, ["item_id", "seq"], [F.desc("score"), F.asc("doc_id")], WIDEST).where("rank <= width").drop("width")


def merged(found: DataFrame, width: int, kept: DataFrame | None = None) -> DataFrame:
    """item_id, doc_id, score, pinned, rank: each row once at its best score, those of named pages first, without what is kept already (item_id, doc_id)."""
    best = found.groupBy("item_id", "doc_id").agg(F.max("score").alias("score"), F.max(F.col("kind") == "page").alias("pinned"))
    if kept is not None:
        best = best.join(kept.select("item_id", "doc_id"), ["item_id", "doc_id"], "left_anti")
    return S.pinned_first(best, ["item_id"], "doc_id", width)
