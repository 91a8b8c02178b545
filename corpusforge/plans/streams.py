"""Streaming queries: each runs over the files that there are and returns its end state."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from ..registry import query
from ..session import shared_folder, ship
from ..sources.readers import table
from ..streaming import cursor as C
from ..streaming import jobs as J
from ..streaming import queue as Q


def events(spark, d):
    """The events table as a stream of files."""
    ship(spark)
    path = f"{d}/events.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{d}/events.parquet*")


@query("stream_latest_status", "SELECT user_id, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id")
def stream_latest_status(spark, d):
    return J.run_once(spark, J.latest_status(events(spark, d)), "complete")


@query("stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark, d):
    return J.run_once(spark, J.once(events(spark, d), ["user_id", "event_type"]).select("user_id", "event_type"))


@query("stream_mailbox", "SELECT min(event_id) AS uid, identity FROM (SELECT event_id, user_id || ':' || event_type AS identity FROM events WHERE ts >= TIMESTAMP '2024-01-11') GROUP BY identity")
def stream_mailbox(spark, d):
    """Events as a mailbox: two batches above the cursor, then the mailbox is numbered anew, and the import starts over without taking a message twice."""
    e = table(spark, d, "events")
    box = e.select(F.col("event_id").alias("uid"), F.col("ts").alias("at"), F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("identity"))
    folder, since, batch = shared_folder(spark), datetime(2024, 1, 11, tzinfo=timezone.utc), max(1, e.count() // 5)
    C.sync(box, folder, 1, since, batch, steps=2)
    return C.sync(box, folder, 2, since, batch).select("uid", "identity")


_QUEUE = """WITH RECURSIVE c AS (SELECT user_id AS job, event_id AS id, epoch_us(ts) // 1000 AS t, event_type IN ('error', 'click') AS failed, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
w AS (SELECT job, id, t, n, 1 AS attempt, CASE WHEN failed THEN 'retry' ELSE 'done' END AS outcome, CASE WHEN failed THEN 'waiting' ELSE 'finished' END AS status, CASE WHEN failed THEN t + 21600000 ELSE t + 172800000 END AS until FROM c WHERE n = 1
UNION ALL SELECT job, id, t, n, CASE WHEN dup THEN attempt ELSE k END, CASE WHEN dup THEN 'duplicate' WHEN failed AND k < 3 THEN 'retry' WHEN failed THEN 'failed' ELSE 'done' END,
CASE WHEN dup THEN status WHEN failed AND k < 3 THEN 'waiting' ELSE 'finished' END, CASE WHEN dup THEN until WHEN failed AND k < 3 THEN t + 21600000 * CASE k WHEN 1 THEN 1 ELSE 2 END ELSE t + 172800000 END
FROM (SELECT c.job, c.id, c.t, c.n, c.failed, w.attempt, w.status, w.until, c.t < w.until AS dup, CASE WHEN w.status = 'finished' THEN 1 ELSE w.attempt + 1 END AS k FROM w JOIN c ON c.job = w.job AND c.n = w.n + 1))"""


def _queue(spark, d):
    """Events as attempts of a job a user: errors and clicks fail; six hours before the second attempt, two days of memory."""
    attempts = events(spark, d).select(F.col("user_id").alias("job"), F.col("event_id").alias("id"), "ts", F.col("event_type").isin("error", "click").alias("failed"))
    return J.run_once(spark, Q.run_jobs(attempts, Q.Policy(3, 21_600_000, 172_800_000)), settings=Q.STATE)


@query("stream_queue", f"{_QUEUE} SELECT job, id, t AS \"at\", attempt, outcome FROM w")
def stream_queue(spark, d):
    """Every attempt with its number and outcome: retries after growing delays, duplicates while a job waits or is remembered."""
    return _queue(spark, d)


@query("queue_state", f"{_QUEUE} SELECT job, arg_max(attempt, n) AS attempts, arg_max(outcome, n) AS outcome FROM w WHERE outcome <> 'duplicate' GROUP BY job")
def queue_state(spark, d):
    """The last outcome of every job."""
    return Q.plain_jobs(_queue(spark, d))


@query(
    "stream_breaker",
    """WITH RECURSIVE c AS (SELECT user_id AS key, CAST(event_id AS DOUBLE) AS t, event_id % 7 = 0 AS failed, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
w AS (SELECT key, t, failed, n, true AS allowed, CASE WHEN failed THEN t + 500 ELSE -1e18 END AS until FROM c WHERE n = 1
UNION ALL SELECT c.key, c.t, c.failed, c.n, c.t >= w.until, CASE WHEN c.t >= w.until AND c.failed THEN c.t + 500 ELSE w.until END FROM w JOIN c ON c.key = w.key AND c.n = w.n + 1)
SELECT key, t AS "at", failed, allowed FROM w""",
)
def stream_breaker(spark, d):
    calls = events(spark, d).select(F.col("user_id").alias("key"), F.col("event_id").cast("double").alias("at"), (F.col("event_id") % 7 == 0).alias("failed"))
    return J.run_once(spark, J.breaker(calls, 500.0))


@query(
    "stream_token_bucket",
    """WITH RECURSIVE c AS (SELECT user_id AS key, CAST(event_id AS DOUBLE) AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
w AS (SELECT key, t, n, true AS granted, CAST(1 AS DOUBLE) AS level FROM c WHERE n = 1
UNION ALL SELECT key, t, n, full_ >= 1, CASE WHEN full_ >= 1 THEN full_ - 1 ELSE full_ END FROM (SELECT c.key, c.t, c.n, least(CAST(2 AS DOUBLE), w.level + (c.t - w.t) * CAST(0.01 AS DOUBLE)) AS full_ FROM w JOIN c ON c.key = w.key AND c.n = w.n + 1))
SELECT key, t AS "at", granted FROM w""",
)
def stream_token_bucket(spark, d):
    calls = events(spark, d).select(F.col("user_id").alias("key"), F.col("event_id").cast("double").alias("at"))
    return J.run_once(spark, J.token_bucket(calls, 0.01))


@query("mail_attachments", "SELECT 'm' || o_orderkey || '#1' AS external_id, 'a' AS name FROM orders UNION ALL SELECT 'm' || o_orderkey || '#3', 'attachment-3' FROM orders")
def mail_attachments(spark, d):
    """Attachments of mails; the second is too large, the third has no name."""
    o = table(spark, d, "orders")
    a = F.array(*[F.struct(F.lit(n).cast("string").alias("name"), F.lit(s).alias("size")) for n, s in (("a", 10), ("b", 10_000), (None, 20))])
    return J.attachments(o.select(F.concat(F.lit("m"), F.col("o_orderkey").cast("string")).alias("identity"), a.alias("attachments")), 1000)
