"""Citation algebra: resolving markers, support checks, stripping, renumbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import answer_sentences, bm25_terms, claim_of, markers

CLAIM_MIN, SUPPORT_MIN = 20, 0.02


def sentences(answers: DataFrame, by: list[str]) -> DataFrame:
    """by, pos, sentence of each answer (column text)."""
    return answers.select(*by, F.posexplode(answer_sentences(F.col("text"))).alias("pos", "sentence"))


def claims(answers: DataFrame, by: list[str]) -> DataFrame:
    """by, pos, claim, marker: a row for each marker of each sentence."""
    s = sentences(answers, by)
    return s.select(*by, "pos", claim_of(F.col("sentence")).alias("claim"), F.explode(F.array_distinct(markers(F.col("sentence")))).alias("marker"))


def resolve(marked: DataFrame, evidence: DataFrame, by: list[str]) -> DataFrame:
    """Markers with the n-th piece of evidence (1-based); unresolved ones keep nulls.  evidence: by, place, ..."""
    return marked.join(evidence.withColumnRenamed("place", "marker"), [*by, "marker"], "left")


def support(claim: Column, passage: Column) -> Column:
    """Share of a claim's terms that the passage holds: the default support scorer."""
    c = F.array_distinct(bm25_terms(claim))
    return F.coalesce(F.size(F.array_intersect(c, bm25_terms(passage))) / F.nullif(F.size(c), F.lit(0)), F.lit(0.0))


def supported(score: Column, claim: Column) -> Column:
    """Short claims and unknown scores count as supported."""
    return (F.length(claim) < CLAIM_MIN) | F.coalesce(score >= SUPPORT_MIN, F.lit(True))


def strip_unsupported(answers: DataFrame, bad: DataFrame, by: list[str]) -> DataFrame:
    """by, text, dropped: markers in `bad` (by, marker) go; a sentence whose markers all go is dropped."""
    lost = bad.groupBy(*by).agg(F.collect_set("marker").alias("bad"))
    s = sentences(answers, by).join(lost, by, "left").withColumn("bad", F.coalesce("bad", F.array().cast("array<int>")))
    own = markers(F.col("sentence"))
    left = F.filter(own, lambda m: ~F.array_contains(F.col("bad"), m))
    stripped = F.aggregate("bad", F.col("sentence"), lambda t, m: F.regexp_replace(t, F.concat(F.lit(r"\s*\[\^?"), m.cast("string"), F.lit(r"\]")), F.lit("")))
    s = s.select(*by, "pos", stripped.alias("t"), ((F.size(own) > 0) & (F.size(left) == 0)).alias("gone"))
    kept = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("gone"), F.struct("pos", "t")))), lambda x: F.trim(x["t"])), " ")
    return s.groupBy(*by).agg(kept.alias("text"), F.count_if("gone").alias("dropped"))


def renumber(marked: DataFrame, by: list[str]) -> DataFrame:
    """Surviving markers as 1..n, in the order of their old numbers."""
    return marked.select(*by, "marker").distinct().withColumn("number", F.row_number().over(Window.partitionBy(*by).orderBy("marker")))


def neighbours(chunks: DataFrame, by: str, order: str, text: str, reach: int = 1) -> DataFrame:
    """Adds context: the texts of the rows within `reach` of each row's ordinal, by blank lines (a band self join as a range window)."""
    w = Window.partitionBy(by).orderBy(order).rangeBetween(-reach, reach)
    return chunks.withColumn("context", F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text)).over(w)), lambda x: x[text]), "\n\n"))


def contexts(chunks: DataFrame, by: str, order: str, text: str, region: str = "region_type", reach: int = 1) -> DataFrame:
    """Adds context: a chart, table or picture (a region that is not text) is its own; any other row has its neighbours'."""
    own = F.col(region).isNotNull() & (F.col(region) != "text")
    return neighbours(chunks, by, order, text, reach).withColumn("context", F.when(own, F.col(text)).otherwise(F.col("context")))
