"""A job queue over a stream of attempts: one job a key, retries after growing delays, and forgetting."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "job long, id long, at long, attempt int, outcome string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Settings that queries with timers need while they run.
STATE = {"spark.sql.streaming.stateStore.providerClass": ROCKS}
WAITING, FINISHED = "waiting", "finished"


@dataclass(frozen=True)
class Policy:
    """Attempts of a job at most, the delay before the second (it doubles with each further one), and how long a finished job is remembered; milliseconds."""

    attempts: int = 3
    delay: int = 30_000
    keep: int = 3_600_000


class Jobs(StatefulProcessor):
    """State of a job: status, attempts so far, and until when it stands (waiting: when the next attempt is due; finished: when it is forgotten).

    What is past its time counts as gone whether its timer has fired or not, so results do not
    depend on where the stream was cut into batches; the timers only keep the state small.
    """

    def __init__(self, policy: Policy):
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, attempts int, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        p, out = self.policy, []
        state = self.job.get() if self.job.exists() else None
        for r in pd.concat(list(rows)).sort_values(["at", "id"], kind="stable").itertuples():
            if state is not None and state[0] == FINISHED and r.at >= state[2]:
                state = None
            if state is not None and r.at < state[2]:
                out.append((r.job, r.id, r.at, state[1], "duplicate"))
                continue
            n = 1 if state is None else state[1] + 1
            again = bool(r.failed) and n < p.attempts
            outcome = "retry" if again else "failed" if r.failed else "done"
            state = (WAITING, n, r.at + p.delay * 2 ** (n - 1)) if again else (FINISHED, n, r.at + p.keep)
            out.append((r.job, r.id, r.at, n, outcome))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.job.update(state)
        if state[0] == FINISHED:
            self.handle.registerTimer(state[2])
        yield pd.DataFrame(out, columns=["job", "id", "at", "attempt", "outcome"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.job.exists() and self.job.get()[0] == FINISHED and self.job.get()[2] <= expiredTimerInfo.getExpiryTimeInMs():
            self.job.clear()
        return iter(())

    def close(self) -> None:
        pass


def run_jobs(attempts: DataFrame, policy: Policy, late: str = "1 hour") -> DataFrame:
    """job, id, at, attempt, outcome of every row of attempts (job, id, ts, failed).

    The first row of a job is its submission and first attempt.  After a failed attempt the next
    counts from the end of its delay on; rows before that, and rows of a job that is finished and
    still remembered, are duplicates.  outcome: done, retry, failed or duplicate.  Rows later than
    `late` behind the newest are dropped by the watermark.
    """
    rows = attempts.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).select(F.col("job").cast("long").alias("job"), F.col("id").cast("long").alias("id"), F.unix_millis("ts").alias("at"), "failed", "ts")
    return rows.groupBy("job").transformWithStateInPandas(Jobs(policy), OUT, "append", "eventTime")


def plain_jobs(rows: DataFrame) -> DataFrame:
    """The latest outcome of each job that is no duplicate: job, attempts, outcome."""
    real = rows.where("outcome <> 'duplicate'")
    return real.groupBy("job").agg(F.max_by(F.struct("attempt", "outcome"), F.struct("at", "id")).alias("m")).select("job", F.col("m.attempt").alias("attempts"), F.col("m.outcome").alias("outcome"))
