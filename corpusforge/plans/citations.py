"""Citation queries: conversation turns with markers as answers, documents as evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cite as C
from ..registry import query
from ..sources.readers import table
from .retrieval import terms_sql

BY = ["conv_id", "turn"]
_ANS = "ans AS (SELECT conv_id, turn, 'Alpha beta gamma delta epsilon [^1]. ' || 'Second claim of the answer here [^' || (turn % 5 + 1) || '][^9]. Third one stands alone. Last [^2].' AS text FROM conversations WHERE role = 'assistant')"


def answers(spark, d) -> DataFrame:
    c = table(spark, d, "conversations").where("role = 'assistant'")
    t = F.concat(F.lit("Alpha beta gamma delta epsilon [^1]. Second claim of the answer here [^"), (F.col("turn") % 5 + 1).cast("string"), F.lit("][^9]. Third one stands alone. Last [^2]."))
    return c.select(*BY, t.alias("text"))


def evidence(spark, d) -> DataFrame:
    """Four pieces of evidence an answer: documents numbered from its conversation on."""
    return answers(spark, d).select(*BY, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.col("conv_id") + i)).alias("p", "doc_id")).select(*BY, (F.col("p") + 1).alias("place"), "doc_id")


@query("normalise_markers", "SELECT conv_id, turn, 'See [^' || turn || '] and [^' || conv_id % 1000 || '], x² and [note] in [^' || conv_id % 7 || '].' AS t FROM conversations")
def normalise_markers(spark, d):
    """Markers in superscript, plain and mixed form; other superscripts and brackets stay."""
    up = lambda c: F.translate(c.cast("string"), "0123456789", "⁰¹²³⁴⁵⁶⁷⁸⁹")
    said = F.concat(F.lit("See ["), up(F.col("turn")), F.lit("] and [^"), up(F.col("conv_id") % 1000), F.lit("], x² and [note] in ["), (F.col("conv_id") % 7).cast("string"), F.lit("]."))
    return table(spark, d, "conversations").select("conv_id", "turn", T.normalise_markers(said).alias("t"))


_MARK = f"{_ANS}, mk AS (SELECT conv_id, turn, unnest(list_distinct([1, turn % 5 + 1, 9, 2])) AS marker FROM ans)"


@query("citation_resolve", f"WITH {_MARK} SELECT conv_id, turn, CAST(marker AS INTEGER) AS marker, CASE WHEN marker <= 4 THEN conv_id + marker - 1 END AS doc_id, marker > 4 AS rejected FROM mk")
def citation_resolve(spark, d):
    m = C.claims(answers(spark, d), BY).select(*BY, "marker").distinct()
    return C.resolve(m, evidence(spark, d), BY).select(*BY, "marker", "doc_id", F.col("doc_id").isNull().alias("rejected"))


@query("citation_renumber", f"WITH {_MARK} SELECT conv_id, turn, CAST(marker AS INTEGER) AS marker, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY marker) AS INTEGER) AS number FROM mk WHERE marker <= 4")
def citation_renumber(spark, d):
    m = C.resolve(C.claims(answers(spark, d), BY).select(*BY, "marker").distinct(), evidence(spark, d), BY)
    return C.renumber(m.where("doc_id is not null"), BY)


@query("strip_unsupported", f"WITH {_ANS} SELECT conv_id, turn, CASE WHEN turn % 5 + 1 IN (2, 5) THEN 'Alpha beta gamma delta epsilon [^1]. Third one stands alone.' ELSE 'Alpha beta gamma delta epsilon [^1]. Second claim of the answer here [^' || (turn % 5 + 1) || ']. Third one stands alone.' END AS text, CASE WHEN turn % 5 + 1 IN (2, 5) THEN 2 ELSE 1 END AS dropped FROM ans")
def strip_unsupported(spark, d):
    """Markers 2, 5 and 9 fail; sentences that lose all their markers go."""
    bad = answers(spark, d).select(*BY, F.explode(F.array(F.lit(2), F.lit(5), F.lit(9))).alias("marker"))
    return C.strip_unsupported(answers(spark, d), bad, BY).select(*BY, "text", F.col("dropped").cast("int").alias("dropped"))


@query("answer_sentences", f"WITH {_ANS} SELECT conv_id, turn, 4 AS n FROM ans")
def answer_sentences(spark, d):
    return C.sentences(answers(spark, d), BY).groupBy(*BY).agg(F.count("*").cast("int").alias("n"))


_CLAIMS = "cl AS (SELECT conv_id, turn, unnest([{'pos': 0, 'marker': 1, 'claim': 'Alpha beta gamma delta epsilon .'}, {'pos': 1, 'marker': turn % 5 + 1, 'claim': 'Second claim of the answer here .'}, {'pos': 1, 'marker': 9, 'claim': 'Second claim of the answer here .'}, {'pos': 3, 'marker': 2, 'claim': 'Last .'}], recursive := true) FROM ans)"


@query(
    "citation_support",
    f"""WITH {_ANS}, {_CLAIMS}, tok AS (SELECT doc_id, {terms_sql("text")} AS t FROM documents WHERE text IS NOT NULL), ct AS (SELECT *, list_distinct({terms_sql("claim")}) AS c FROM cl),
sc AS (SELECT conv_id, turn, pos, marker, claim, CASE WHEN doc_id IS NOT NULL THEN round(len(list_intersect(c, t)) / len(c), 6) END AS score FROM ct LEFT JOIN tok ON marker <= 4 AND doc_id = conv_id + marker - 1)
SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, CAST(marker AS INTEGER) AS marker, score, length(claim) < 20 OR coalesce(score >= 0.02, true) AS supported FROM sc""",
)
def citation_support(spark, d):
    """Each marked claim against its evidence; unresolved and short claims count as supported."""
    c = C.resolve(C.claims(answers(spark, d), BY), evidence(spark, d), BY)
    docs = table(spark, d, "documents").select("doc_id", "text")
    s = c.join(docs, "doc_id", "left").withColumn("score", F.when(F.col("text").isNotNull(), F.round(C.support(F.col("claim"), F.col("text")), 6)))
    return s.select(*BY, "pos", "marker", "score", C.supported(F.col("score"), F.col("claim")).alias("supported"))


@query("groundless_abstain", f"WITH {_MARK} SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN 'abstain' ELSE 'answer' END AS decision FROM mk GROUP BY conv_id, turn")
def groundless_abstain(spark, d):
    """An answer whose citations all fall away abstains (every third conversation has no evidence here)."""
    m = C.resolve(C.claims(answers(spark, d), BY).select(*BY, "marker").distinct(), evidence(spark, d).where("conv_id % 3 <> 0"), BY)
    return m.groupBy(*BY).agg(F.when(F.count("doc_id") == 0, "abstain").otherwise("answer").alias("decision"))


@query("citation_context", "SELECT a.conv_id, a.turn, string_agg(b.text, chr(10) || chr(10) ORDER BY b.turn) AS context FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 1 AND a.turn + 1 GROUP BY a.conv_id, a.turn")
def citation_context(spark, d):
    return C.neighbours(table(spark, d, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "context")


@query("region_context", "WITH c AS (SELECT *, CASE turn % 4 WHEN 1 THEN 'chart' WHEN 2 THEN 'text' END AS region FROM conversations) SELECT a.conv_id, a.turn, CASE WHEN a.region = 'chart' THEN any_value(a.text) ELSE string_agg(b.text, chr(10) || chr(10) ORDER BY b.turn) END AS context FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 1 AND a.turn + 1 GROUP BY a.conv_id, a.turn, a.region")
def region_context(spark, d):
    """A cited chart is its own context; texts, also those of regions, have their neighbours'."""
    c = table(spark, d, "conversations").withColumn("region_type", F.when(F.col("turn") % 4 == 1, "chart").when(F.col("turn") % 4 == 2, "text"))
    return C.contexts(c, "conv_id", "turn", "text").select("conv_id", "turn", "context")


@query("citation_lookup", "SELECT l.l_orderkey, l.l_linenumber, o.o_custkey, c.c_nationkey FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey")
def citation_lookup(spark, d):
    """Chunk, its document and its collection (line, order and customer stand in)."""
    line = table(spark, d, "lineitem")
    return line.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("l_orderkey", "l_linenumber", "o_custkey", "c_nationkey")


@query("citations_by_document", "SELECT user_id, min(event_id) AS first_seen, count(*) AS n, list(event_id ORDER BY event_id) AS events FROM events WHERE event_type = 'click' GROUP BY user_id")
def citations_by_document(spark, d):
    """Citations grouped by document in the order first seen (users and clicks stand in)."""
    e = table(spark, d, "events").where("event_type = 'click'")
    return e.groupBy("user_id").agg(F.min("event_id").alias("first_seen"), F.count("*").alias("n"), F.array_sort(F.collect_list("event_id")).alias("events"))


@query("groundedness", "SELECT user_id, k AS claims, k // 2 AS grounded, k - k // 2 AS discarded FROM (SELECT user_id, arg_max(CAST(json_extract(props, '$.k') AS BIGINT), event_id) AS k FROM events GROUP BY user_id)")
def groundedness(spark, d):
    """Claims, grounded and discarded ones, of the last citations event."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.max_by(F.get_json_object("props", "$.k").cast("long"), "event_id").alias("k"))
    return e.select("user_id", F.col("k").alias("claims"), F.floor(F.col("k") / 2).alias("grounded"), (F.col("k") - F.floor(F.col("k") / 2)).alias("discarded"))


@query("source_context", "SELECT conv_id, string_agg('[' || turn || '] ' || role || ': ' || substr(text, 1, 40), chr(10) ORDER BY turn) AS context FROM conversations WHERE role <> 'system' GROUP BY conv_id")
def source_context(spark, d):
    """Numbered evidence lines as one prompt block."""
    line = F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("] "), F.col("role"), F.lit(": "), F.substring("text", 1, 40))
    c = table(spark, d, "conversations").where("role <> 'system'").select("conv_id", F.struct("turn", line.alias("line")).alias("x"))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("context"))
