"""Evaluation queries: benchmark passages as questions, documents that hold them as labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..registry import query
from ..sources.readers import table
from .retrieval import POSTINGS, bench, docs, sparse

KS = (1, 3, 5, 12)
_LABELS = "lab AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), nl AS (SELECT item_id, count(DISTINCT doc_id) AS n_labels FROM lab GROUP BY item_id)"


#: Short passages that meet all texts at once at most.
SHORT_BLOCK = 1000


def labels(spark, d) -> DataFrame:
    """item_id, doc_id: documents that hold a passage word for word.

    A document that holds a passage has its inner words (all but the first and last) as words of
    its own, so the one that stands in the fewest documents finds the candidates by an equi-join, and
    only those are read for the passage.  Passages of one or two words, if there are any, are looked
    for in all texts, SHORT_BLOCK at a time.
    """
    words = F.split(F.col("text"), r"\s+")
    q = bench(spark, d).select("item_id", F.col("text").alias("passage"), words.alias("words"))
    inner = q.where("size(words) > 2").select("item_id", F.explode(F.array_distinct(F.slice("words", 2, F.size("words") - 2))).alias("w"))
    held = docs(spark, d).select("doc_id", F.explode(F.array_distinct(words)).alias("w"))
    common = held.join(inner.select("w").distinct(), "w", "left_semi").groupBy("w").agg(F.count("*").alias("n"))
    # A passage with an inner word that no document has is in none.
    rarest = inner.join(common, "w", "left").groupBy("item_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "w"))["w"].alias("w")).join(q.select("item_id", "passage"), "item_id")
    found = held.join(rarest, "w").select("doc_id", "item_id", "passage").join(docs(spark, d), "doc_id").where(F.contains("text", "passage")).select("item_id", "doc_id")
    few = q.where("size(words) <= 2").select("item_id", "passage")
    n = few.count()
    for k in range(0, n, SHORT_BLOCK):
        block = few.where(F.pmod(F.xxhash64("item_id", "passage"), F.lit(-(-n // SHORT_BLOCK))) == k // SHORT_BLOCK)
        found = found.unionByName(docs(spark, d).join(F.broadcast(block), F.contains("text", "passage")).select("item_id", "doc_id"))
    return found.distinct()


def results(spark, d) -> DataFrame:
    lab = labels(spark, d).withColumn("relevant", F.lit(True))
    return sparse(spark, d).join(lab, ["item_id", "doc_id"], "left").withColumn("relevant", F.coalesce("relevant", F.lit(False)))


def n_labels(spark, d) -> DataFrame:
    return labels(spark, d).groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_labels"))


def _metric_sql() -> str:
    parts = ", ".join(f"round(coalesce(count(*) FILTER (rank <= {k} AND rel) / nullif(count(*) FILTER (rank <= {k}), 0), 0), 6) AS precision_{k}, round(coalesce(count(DISTINCT doc_id) FILTER (rank <= {k} AND rel) / any_value(n_labels), 0), 6) AS recall_{k}, CAST(max(CASE WHEN rank <= {k} AND rel THEN 1 ELSE 0 END) AS INTEGER) AS hit_{k}" for k in KS)
    return f"res AS (SELECT s.item_id, s.doc_id, rank, lab.doc_id IS NOT NULL AS rel FROM sparse s LEFT JOIN lab ON lab.item_id = s.item_id AND lab.doc_id = s.doc_id), met AS (SELECT nl.item_id, round(coalesce(1.0 / min(rank) FILTER (rel), 0), 6) AS rr, {parts} FROM nl LEFT JOIN res USING (item_id) GROUP BY nl.item_id)"


def metrics(spark, d) -> DataFrame:
    m = E.ranking_metrics(results(spark, d), n_labels(spark, d), KS)
    return m.select("item_id", *[F.round(c, 6).alias(c) if not c.startswith("hit") else F.col(c) for c in m.columns if c != "item_id"])


@query("ranking_metrics", f"WITH {POSTINGS}, {_LABELS}, {_metric_sql()} SELECT * FROM met")
def ranking_metrics(spark, d):
    return metrics(spark, d)


@query("retrieval_rollup", f"WITH {POSTINGS}, {_LABELS}, {_metric_sql()} SELECT count(*) AS n, round(avg(rr), 6) AS mrr, " + ", ".join(f"round(avg(precision_{k}), 6) AS precision_{k}, round(avg(recall_{k}), 6) AS recall_{k}, round(avg(hit_{k}), 6) AS hit_{k}" for k in KS) + " FROM met")
def retrieval_rollup(spark, d):
    cols = [F.round(F.avg(f"{m}_{k}"), 6).alias(f"{m}_{k}") for k in KS for m in ("precision", "recall", "hit")]
    return metrics(spark, d).agg(F.count("*").alias("n"), F.round(F.avg("rr"), 6).alias("mrr"), *cols)


_RUN = """ans AS (SELECT l.doc_id, m.mode, l.quality = 0 AS unanswerable, (l.doc_id + m.k) % 4 = 0 AS abstained, [l.doc_id % 10, l.doc_id % 7] AS cited, [l.doc_id % 10] AS labels, l.doc_id % 3 AS unresolved, l.doc_id % 5 AS total, [substr(d.text, 1, 5), 'zzz'] AS expected, substr(d.text, 1, 50) AS answer, CAST((l.doc_id * 37 + m.k) % 1000 AS DOUBLE) AS latency_ms
FROM labels l JOIN documents d USING (doc_id), (VALUES ('agentic', 0), ('naive', 1)) m(mode, k)),
sc AS (SELECT *, CAST(unanswerable = abstained AS DOUBLE) AS abstention_correct, CASE WHEN unanswerable THEN CAST(abstained AS DOUBLE) WHEN abstained THEN 0 ELSE len(list_filter(cited, lambda x: list_contains(labels, x))) / len(cited) END AS citation_precision, CASE WHEN abstained OR total = 0 THEN 1 ELSE (total - unresolved) / total END AS citations_resolve, CASE WHEN unanswerable THEN 1 WHEN abstained THEN 0 ELSE len(list_filter(expected, lambda e: contains(lower(answer), lower(e)))) / 2 END AS answer_contains FROM ans)"""


def answers(spark, d) -> DataFrame:
    """Answers made of the labelled documents, in two modes."""
    m = spark.createDataFrame([("agentic", 0), ("naive", 1)], "mode string, k int")
    a = table(spark, d, "labels").join(docs(spark, d).select("doc_id", "text"), "doc_id").crossJoin(F.broadcast(m))
    doc = F.col("doc_id")
    return E.answer_scores(
        a.select(
            "doc_id", "mode", (F.col("quality") == 0).alias("unanswerable"), ((doc + F.col("k")) % 4 == 0).alias("abstained"), F.array(doc % 10, doc % 7).alias("cited"), F.array(doc % 10).alias("labels"),
            (doc % 3).alias("unresolved"), (doc % 5).alias("total"), F.array(F.substring("text", 1, 5), F.lit("zzz")).alias("expected"), F.substring("text", 1, 50).alias("answer"), ((doc * 37 + F.col("k")) % 1000).cast("double").alias("latency_ms"),
        )
    )


@query("answer_scores", f"WITH {_RUN} SELECT doc_id, mode, abstention_correct, CAST(round(citation_precision, 6) AS DOUBLE) AS citation_precision, CAST(round(citations_resolve, 6) AS DOUBLE) AS citations_resolve, CAST(round(answer_contains, 6) AS DOUBLE) AS answer_contains FROM sc")
def answer_scores(spark, d):
    r = lambda c: F.round(c, 6).alias(c)
    return answers(spark, d).select("doc_id", "mode", "abstention_correct", r("citation_precision"), r("citations_resolve"), r("answer_contains"))


@query("abstention_rates", f"WITH {_RUN} SELECT mode, round(coalesce(count(*) FILTER (NOT abstained AND unanswerable) / nullif(count(*) FILTER (unanswerable), 0), 0), 6) AS false_answer_rate, round(coalesce(count(*) FILTER (abstained AND NOT unanswerable) / nullif(count(*) FILTER (NOT unanswerable), 0), 0), 6) AS over_abstention_rate FROM sc GROUP BY mode")
def abstention_rates(spark, d):
    return E.run_rollup(answers(spark, d), ["mode"]).select("mode", "false_answer_rate", "over_abstention_rate")


_ROLL = "roll AS (SELECT mode, count(*) AS n, round(avg(abstention_correct), 6) AS abstention_correct, round(avg(citation_precision), 6) AS citation_precision, round(avg(citations_resolve), 6) AS citations_resolve, round(avg(answer_contains), 6) AS answer_contains, round(coalesce(count(*) FILTER (NOT abstained AND unanswerable) / nullif(count(*) FILTER (unanswerable), 0), 0), 6) AS false_answer_rate, round(coalesce(count(*) FILTER (abstained AND NOT unanswerable) / nullif(count(*) FILTER (NOT unanswerable), 0), 0), 6) AS over_abstention_rate, round(median(latency_ms), 6) AS median_latency_ms FROM sc GROUP BY mode)"


@query("run_rollup", f"WITH {_RUN}, {_ROLL} SELECT * FROM roll")
def run_rollup(spark, d):
    return E.run_rollup(answers(spark, d), ["mode"])


@query("run_compare", f"WITH {_RUN}, {_ROLL} SELECT metric, max(v) FILTER (mode = 'agentic') AS agentic, max(v) FILTER (mode = 'naive') AS naive FROM (SELECT mode, 'citation_precision' AS metric, citation_precision AS v FROM roll UNION ALL SELECT mode, 'answer_contains', answer_contains FROM roll) GROUP BY metric")
def run_compare(spark, d):
    r = E.run_rollup(answers(spark, d), ["mode"])
    long = r.unpivot("mode", ["citation_precision", "answer_contains"], "metric", "v")
    return long.groupBy("metric").pivot("mode", ["agentic", "naive"]).agg(F.first("v"))


@query("run_counterpart", "WITH l AS (SELECT user_id, event_type, arg_max(event_id, (ts, -event_id)) AS other, max(ts) AS ts FROM events GROUP BY user_id, event_type) SELECT e.event_id, arg_max(l.other, (l.ts, -l.other)) AS other FROM events e JOIN l ON l.user_id = e.user_id AND l.event_type <> e.event_type GROUP BY e.event_id")
def run_counterpart(spark, d):
    """Each run's latest counterpart: same data set, another mode (user and event type stand in)."""
    e = table(spark, d, "events")
    w = Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), "event_id")
    latest = e.withColumn("n", F.row_number().over(w)).where("n = 1").select("user_id", F.col("event_type").alias("other_type"), F.col("event_id").alias("other"), F.col("ts").alias("other_ts"))
    pairs = e.join(latest, (e.user_id == latest.user_id) & (e.event_type != latest.other_type)).drop(latest.user_id)
    pick = Window.partitionBy("event_id").orderBy(F.desc("other_ts"), "other")
    return pairs.withColumn("n", F.row_number().over(pick)).where("n = 1").select("event_id", "other")


@query("missing_labels", "SELECT DISTINCT doc_id FROM (SELECT unnest([doc_id, doc_id + 100000]) AS doc_id FROM labels) WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def missing_labels(spark, d):
    want = table(spark, d, "labels").select(F.explode(F.array("doc_id", F.col("doc_id") + 100000)).alias("doc_id"))
    return want.join(docs(spark, d).select("doc_id"), "doc_id", "left_anti").distinct()


@query("resume_pending", "SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def resume_pending(spark, d):
    """Questions that a broken-off evaluation has still to score."""
    lab = table(spark, d, "labels")
    return lab.join(lab.where("toxic = 1").select("doc_id"), "doc_id", "left_anti").select("doc_id")


@query("eval_filters", f"WITH {_RUN} SELECT mode, count(*) AS all_, count(*) FILTER (NOT abstained) AS cited, count(*) FILTER (abstained) AS abstained, count(*) FILTER (citation_precision < 1) AS imperfect FROM sc GROUP BY mode")
def eval_filters(spark, d):
    return answers(spark, d).groupBy("mode").agg(F.count("*").alias("all_"), F.count_if(~F.col("abstained")).alias("cited"), F.count_if("abstained").alias("abstained"), F.count_if(F.col("citation_precision") < 1).alias("imperfect"))


@query("eval_report", f"WITH {_RUN}, {_ROLL}, l AS (SELECT metric, printf('| %s | %.1f%% | %.1f%% |', metric, 100 * max(v) FILTER (mode = 'agentic'), 100 * max(v) FILTER (mode = 'naive')) AS line FROM (SELECT mode, 'answer_contains' AS metric, answer_contains AS v FROM roll UNION ALL SELECT mode, 'citation_precision', citation_precision FROM roll) GROUP BY metric) SELECT '| metric | agentic | naive |' || chr(10) || '|---|---|---|' || chr(10) || string_agg(line, chr(10) ORDER BY line) AS markdown FROM l")
def eval_report(spark, d):
    return E.report(E.run_rollup(answers(spark, d), ["mode"]), ["answer_contains", "citation_precision"])
