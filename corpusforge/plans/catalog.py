"""Library, threads and mutation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import truncated
from ..operators import search as S
from ..registry import query
from ..sources.readers import table


def docs(spark, d):
    return table(spark, d, "documents")


def talk(spark, d):
    return table(spark, d, "conversations")


@query("library_counts", "SELECT doc_id, count(b.item_id) AS n_chunks, count(DISTINCT b.item_id % 7) AS n_images FROM documents LEFT JOIN benchmark b ON doc_id % 40 = b.item_id GROUP BY doc_id")
def library_counts(spark, d):
    """Documents with their chunk and distinct image counts; chunks are summed before they meet the documents."""
    b = table(spark, d, "benchmark").groupBy("item_id").agg(F.count("*").alias("n"), F.count_distinct(F.col("item_id") % 7).alias("i"))
    out = docs(spark, d).select("doc_id", (F.col("doc_id") % 40).alias("item_id")).join(b, "item_id", "left")
    return out.select("doc_id", F.coalesce("n", F.lit(0)).alias("n_chunks"), F.coalesce("i", F.lit(0)).alias("n_images"))


@query("kb_counts", "SELECT n_name AS kb, count(o_orderkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_name")
def kb_counts(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey").agg(F.sum("n").alias("n"))
    return table(spark, d, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(F.col("n_name").alias("kb"), F.coalesce("n", F.lit(0)).alias("n"))


@query("kb_default", "SELECT source AS kb, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, max(doc_id) DESC LIMIT 1")
def kb_default(spark, d):
    """The collection with most documents; among equals the newest."""
    return docs(spark, d).groupBy(F.col("source").alias("kb")).agg(F.count("*").alias("n"), F.max("doc_id").alias("newest")).orderBy(F.desc("n"), F.desc("newest")).limit(1).select("kb", "n")


@query("kb_ranking", "SELECT source AS kb, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, source) AS INTEGER) AS place FROM documents GROUP BY source")
def kb_ranking(spark, d):
    n = docs(spark, d).groupBy(F.col("source").alias("kb")).agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy().orderBy(F.desc("n"), "kb")))


@query("composition", "SELECT lang AS modality, count(*) AS n, round(count(*) / greatest(sum(count(*)) OVER (), 1), 6) AS share FROM documents GROUP BY lang")
def composition(spark, d):
    n = docs(spark, d).groupBy(F.col("lang").alias("modality")).agg(F.count("*").alias("n"))
    return n.select("modality", "n", F.round(F.col("n") / F.greatest(F.sum("n").over(Window.partitionBy()), F.lit(1)), 6).alias("share"))


@query("overview_totals", "SELECT count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars, count(DISTINCT lang) AS modalities, count(*) FILTER (n_chars < 100) AS working, count(*) FILTER (n_chars > 10000) AS failed FROM documents")
def overview_totals(spark, d):
    return docs(spark, d).agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"), F.count_distinct("lang").alias("modalities"), F.count_if(F.col("n_chars") < 100).alias("working"), F.count_if(F.col("n_chars") > 10000).alias("failed"))


@query("last_touched", "SELECT greatest((SELECT max(doc_id) FROM documents), (SELECT max(conv_id) FROM conversations)) AS last")
def last_touched(spark, d):
    return docs(spark, d).select(F.col("doc_id").alias("t")).unionByName(talk(spark, d).select(F.col("conv_id").alias("t"))).agg(F.max("t").alias("last"))


@query("source_classify", "SELECT doc_id, CASE WHEN n_name IS NOT NULL AND doc_id % 3 = 0 THEN 'mailbox' WHEN doc_id % 3 = 0 THEN 'orphaned mailbox' WHEN doc_id % 3 = 1 THEN 'web' ELSE 'uploaded' END AS kind FROM documents LEFT JOIN nation ON doc_id % 50 = n_nationkey")
def source_classify(spark, d):
    """Where a document came from: a known mailbox, one that is gone, the web, or an upload."""
    k = F.col("doc_id") % 3
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("c"), "n_name")
    out = docs(spark, d).withColumn("c", F.col("doc_id") % 50).join(n, "c", "left")
    return out.select("doc_id", F.when((k == 0) & F.col("n_name").isNotNull(), "mailbox").when(k == 0, "orphaned mailbox").when(k == 1, "web").otherwise("uploaded").alias("kind"))


@query("library_filter", "SELECT doc_id FROM documents WHERE source = 'src3' AND lang IN ('en', 'de') AND contains(lower(text), 'the')")
def library_filter(spark, d):
    return docs(spark, d).where((F.col("source") == "src3") & F.col("lang").isin("en", "de") & F.lower("text").contains("the")).select("doc_id")


@query("library_page", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25 OFFSET 50")
def library_page(spark, d):
    return docs(spark, d).select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").offset(50).limit(25)


@query("thread_summary", "SELECT conv_id, count(*) AS n, max(turn) AS last, arg_min(text, turn) FILTER (role = 'user') AS first_question FROM conversations WHERE role <> 'system' GROUP BY conv_id")
def thread_summary(spark, d):
    return talk(spark, d).where("role <> 'system'").groupBy("conv_id").agg(F.count("*").alias("n"), F.max("turn").alias("last"), F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("first_question"))


@query("thread_titles", "SELECT conv_id, coalesce(CASE WHEN length(q) > 60 THEN rtrim(substr(q, 1, 60)) || '…' ELSE q END, 'New conversation') AS title FROM (SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS q FROM conversations GROUP BY conv_id)")
def thread_titles(spark, d):
    q = talk(spark, d).groupBy("conv_id").agg(F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("q"))
    return q.select("conv_id", F.coalesce(truncated(F.col("q"), 60), F.lit("New conversation")).alias("title"))


@query("thread_order", "SELECT conv_id, CAST(row_number() OVER (ORDER BY max(turn) DESC, conv_id) AS INTEGER) AS place FROM conversations GROUP BY conv_id")
def thread_order(spark, d):
    t = talk(spark, d).groupBy("conv_id").agg(F.max("turn").alias("last"))
    return S.numbered(t, [F.desc("last"), F.asc("conv_id")]).select("conv_id", F.col("place").cast("int").alias("place"))


@query("thread_search", "SELECT DISTINCT conv_id FROM conversations WHERE role <> 'system' AND contains(lower(text), 'with')")
def thread_search(spark, d):
    return talk(spark, d).where("role <> 'system'").where(F.lower("text").contains("with")).select("conv_id").distinct()


@query("history_window", "SELECT conv_id, turn, role, substr(text, 1, 600) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role <> 'system' AND text <> '') WHERE n <= 8")
def history_window(spark, d):
    """The last eight messages of each thread, 600 characters each."""
    c = talk(spark, d).where("role <> 'system' and text <> ''")
    return S.ranked(c, ["conv_id"], [F.desc("turn")], 8).select("conv_id", "turn", "role", F.substring("text", 1, 600).alias("text"))


@query("message_order", "SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn // 2, CASE WHEN role = 'user' THEN 0 ELSE 1 END, turn) AS INTEGER) AS place FROM conversations")
def message_order(spark, d):
    """Messages by time, the user's first among equals (pairs of turns share a time here)."""
    w = Window.partitionBy("conv_id").orderBy(F.floor(F.col("turn") / 2), F.when(F.col("role") == "user", 0).otherwise(1), "turn")
    return talk(spark, d).select("conv_id", "turn", F.row_number().over(w).alias("place"))


@query("question_of_answer", "SELECT a.conv_id, a.turn, (SELECT max(b.turn) FROM conversations b WHERE b.conv_id = a.conv_id AND b.role = 'user' AND b.turn < a.turn) AS asked FROM conversations a WHERE a.role = 'assistant'")
def question_of_answer(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return talk(spark, d).withColumn("asked", F.max(F.when(F.col("role") == "user", F.col("turn"))).over(w)).where("role = 'assistant'").select("conv_id", "turn", "asked")


@query("interrupted_answers", "SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN 'aborted' WHEN turn % 5 = 1 THEN 'failed' ELSE 'complete' END AS status, turn % 5 < 2 AS abstained FROM conversations WHERE role = 'assistant'")
def interrupted_answers(spark, d):
    k = F.col("turn") % 5
    return talk(spark, d).where("role = 'assistant'").select("conv_id", "turn", F.when(k == 0, "aborted").when(k == 1, "failed").otherwise("complete").alias("status"), (k < 2).alias("abstained"))


@query("title_update", "SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN substr(min(text), 1, 60) ELSE 'Own title' END AS title FROM conversations GROUP BY conv_id")
def title_update(spark, d):
    """A title changes only while it is the default."""
    t = talk(spark, d).groupBy("conv_id").agg(F.min("text").alias("q")).withColumn("title", F.when(F.col("conv_id") % 2 == 0, "New conversation").otherwise("Own title"))
    return t.select("conv_id", F.when(F.col("title") == "New conversation", F.substring("q", 1, 60)).otherwise(F.col("title")).alias("title"))


@query("insert_if_absent", "SELECT doc_id FROM documents WHERE doc_id % 10 = 0 UNION ALL SELECT doc_id FROM documents WHERE doc_id % 4 = 0 AND doc_id % 10 <> 0")
def insert_if_absent(spark, d):
    """Existing rows, and the new ones whose key they do not hold."""
    old, new = docs(spark, d).where("doc_id % 10 = 0").select("doc_id"), docs(spark, d).where("doc_id % 4 = 0").select("doc_id")
    return old.unionByName(new.dropDuplicates(["doc_id"]).join(old, "doc_id", "left_anti"))


@query("replace_by_document", "SELECT doc_id, lang, CASE WHEN doc_id % 5 = 0 THEN 'new' ELSE source END AS source FROM documents")
def replace_by_document(spark, d):
    """A document's rows give way to its new version's."""
    new = docs(spark, d).where("doc_id % 5 = 0").select("doc_id", "lang", F.lit("new").alias("source"))
    return docs(spark, d).select("doc_id", "lang", "source").join(new.select("doc_id"), "doc_id", "left_anti").unionByName(new)


@query("cascade_delete", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def cascade_delete(spark, d):
    gone = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").join(gone, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber")


@query("attachment_parent_link", "SELECT l_orderkey || '#' || l_linenumber AS external_id, o_orderkey AS parent FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderkey % 2 = 0")
def attachment_parent_link(spark, d):
    """Attachments meet their mail by the identity in front of #n."""
    a = table(spark, d, "lineitem").select(F.concat(F.col("l_orderkey").cast("string"), F.lit("#"), F.col("l_linenumber").cast("string")).alias("external_id"))
    mail = table(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("parent"), F.col("o_orderkey").cast("string").alias("own"))
    return a.withColumn("own", F.regexp_replace("external_id", "#[0-9]+$", "")).join(mail, "own", "left").select("external_id", "parent")


@query("top_level_docs", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_orderkey FROM orders)")
def top_level_docs(spark, d):
    """Rows whose parent is not in the list."""
    o = table(spark, d, "orders")
    return o.join(o.select(F.col("o_orderkey").alias("p")), F.col("o_custkey") == F.col("p"), "left_anti").select("o_orderkey")


@query("document_scope", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey < 50)")
def document_scope(spark, d):
    """A document's scope takes its attachments in."""
    scope = table(spark, d, "orders").where("o_custkey < 50").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").join(scope, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("preview_source", "SELECT d.doc_id, coalesce(i.url, d.source) AS preview FROM documents d LEFT JOIN (SELECT page_id, any_value(url) AS url FROM pages GROUP BY page_id) i ON i.page_id = d.doc_id")
def preview_source(spark, d):
    i = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "url").dropDuplicates(["doc_id"])
    return docs(spark, d).join(i, "doc_id", "left").select("doc_id", F.coalesce("url", "source").alias("preview"))


@query("stranded_docs", "SELECT doc_id FROM documents WHERE doc_id % 6 < 2 AND doc_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def stranded_docs(spark, d):
    """Queued or processing documents without a pending job."""
    jobs = table(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("doc_id")).distinct()
    return docs(spark, d).where("doc_id % 6 < 2").join(jobs, "doc_id", "left_anti").select("doc_id")


@query("latest_status", "SELECT user_id, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id")
def latest_status(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("status"))


@query("stage_durations", "SELECT event_id, epoch_us(nxt) // 1000 - epoch_us(ts) // 1000 AS ms FROM (SELECT event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events)")
def stage_durations(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", (F.unix_millis(F.lead(F.col("ts").cast("timestamp")).over(w)) - F.unix_millis(F.col("ts").cast("timestamp"))).alias("ms"))


@query("ingest_progress", "SELECT count(*) AS total, count(*) FILTER (s IN ('view', 'click')) AS settled, count(*) FILTER (s = 'error') AS failed FROM (SELECT arg_max(event_type, event_id) AS s FROM events GROUP BY user_id)")
def ingest_progress(spark, d):
    s = table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("s"))
    return s.agg(F.count("*").alias("total"), F.count_if(F.col("s").isin("view", "click")).alias("settled"), F.count_if(F.col("s") == "error").alias("failed"))


@query("sync_counters", "SELECT o_orderstatus AS box, count(*) AS messages, CAST(sum(n) AS BIGINT) AS attachments, count(*) FILTER (n > 5) AS skipped FROM (SELECT o_orderkey, o_orderstatus, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) GROUP BY o_orderstatus")
def sync_counters(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "orders").join(n, "o_orderkey").groupBy(F.col("o_orderstatus").alias("box")).agg(F.count("*").alias("messages"), F.sum("n").alias("attachments"), F.count_if(F.col("n") > 5).alias("skipped"))


@query("signup_allowlist", "SELECT c_custkey FROM customer WHERE c_custkey % 10 IN (1, 7)")
def signup_allowlist(spark, d):
    """Exact addresses and whole domains."""
    mail = F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 10 == 1, "@ok.org").when(F.col("c_custkey") % 10 == 7, "@Also.net").otherwise("@no.com"))
    allow = F.array(F.lit("@ok.org"), F.lit("@also.net"), F.lit("someone@else.org"))
    return table(spark, d, "customer").where(F.exists(allow, lambda a: (F.lower(mail) == a) | (a.startswith("@") & F.endswith(F.lower(mail), a)))).select("c_custkey")
