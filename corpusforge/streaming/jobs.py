"""Streaming jobs: idempotent replay, latest status, circuit breaker, token bucket."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder


def latest_status(events: DataFrame) -> DataFrame:
    """Last event type of each user, for update or complete mode."""
    return events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("status"))


def once(events: DataFrame, keys: list[str]) -> DataFrame:
    """First arrival of each key.  The state grows with the keys, as the unique index that it stands for does."""
    return events.dropDuplicates(keys)


def attachments(mails: DataFrame, limit: int) -> DataFrame:
    """identity#n of each attachment (array of struct name, size) that is small enough."""
    return mails.select("identity", F.posexplode("attachments").alias("n", "a")).where(F.col("a.size") <= limit).select(F.concat("identity", F.lit("#"), (F.col("n") + 1).cast("string")).alias("external_id"), F.coalesce("a.name", F.concat(F.lit("attachment-"), (F.col("n") + 1).cast("string"))).alias("name"))


def run_once(spark: SparkSession, df: DataFrame, mode: str = "append", folder: str | None = None, settings: dict[str, str] | None = None) -> DataFrame:
    """Run a streaming DataFrame over what there is, into a Parquet table of the shared folder, and read that.

    The checkpoint lies beside the table: with the same folder a later run goes on where this one
    ended.  A batch that is run again overwrites its own part; in complete mode each batch
    replaces the one before.  settings hold while the query runs.
    """
    folder = folder or shared_folder(spark)
    if not _exists(spark, f"{folder}/rows"):
        spark.createDataFrame([], df.schema).write.parquet(f"{folder}/rows/part=none")

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/part={0 if mode == 'complete' else n}")

    before = {k: spark.conf.get(k, None) for k in settings or {}}
    try:
        for k, v in (settings or {}).items():
            spark.conf.set(k, v)
        df.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/rows")


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def breaker(calls: DataFrame, cooldown: float) -> DataFrame:
    """Circuit breaker over calls (key, at seconds, failed): a failure opens it for `cooldown`; adds allowed.  State is one row a key."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        until = state.get[0] if state.exists else float("-inf")
        rows = pd.concat(list(batches)).sort_values(["at"], kind="stable")
        allowed = []
        for at, failed in zip(rows["at"], rows["failed"], strict=True):
            ok = at >= until
            allowed.append(ok)
            if ok and failed:
                until = at + cooldown
        state.update((until,))
        yield rows.assign(allowed=allowed)[["key", "at", "failed", "allowed"]]

    return calls.groupBy("key").applyInPandasWithState(run, "key long, at double, failed boolean, allowed boolean", "until double", "append", GroupStateTimeout.NoTimeout)


def token_bucket(calls: DataFrame, rate: float, capacity: float = 2.0) -> DataFrame:
    """Token bucket over calls (key, at): adds granted; refills continuously, holds `capacity` at most.  State is one row a key."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        level, last = state.get if state.exists else (capacity, None)
        rows = pd.concat(list(batches)).sort_values(["at"], kind="stable")
        granted = []
        for at in rows["at"]:
            level = capacity if last is None else min(capacity, level + (at - last) * rate)
            last = at
            granted.append(level >= 1)
            level -= level >= 1
        state.update((float(level), float(last)))
        yield rows.assign(granted=granted)[["key", "at", "granted"]]

    return calls.groupBy("key").applyInPandasWithState(run, "key long, at double, granted boolean", "level double, last double", "append", GroupStateTimeout.NoTimeout)
