"""Incremental import above a cursor: batches by number, a log that a crash cannot tear, and no message twice."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH = 200
PLAN = "n long, validity long, above long, upto long, since timestamp"


def _log(df: DataFrame, folder: str, kind: str) -> list:
    """Entries of the log, a few numbers a batch, oldest first."""
    try:
        return df.sparkSession.read.schema(PLAN).json(f"{folder}/{kind}-*").orderBy("n").collect()
    except AnalysisException:  # none yet
        return []


def _note(df: DataFrame, folder: str, kind: str, entry: tuple) -> None:
    df.sparkSession.createDataFrame([entry], PLAN).coalesce(1).write.mode("overwrite").json(f"{folder}/{kind}-{entry[0]}")


def _chosen(box: DataFrame, above: int | None, since) -> DataFrame:
    """Rows above a number, or, where numbers mean nothing yet, those since a time."""
    return box.where(F.col("uid") > above) if above is not None else box.where(F.col("at") >= F.lit(since))


def next_plan(box: DataFrame, folder: str, validity: int, since, batch: int = BATCH) -> tuple | None:
    """The next batch: the one that was planned and not finished, as it was planned; else the next `batch` numbers.

    Numbers hold as long as the mailbox keeps its validity.  When it changes, the import starts over from
    the date window, and only identities keep messages from coming twice.
    """
    plans, done = _log(box, folder, "plan"), _log(box, folder, "done")
    if len(plans) > len(done):
        return tuple(plans[-1])
    last = done[-1] if done else None
    above = last.upto if last and last.validity == validity else None
    top = _chosen(box, above, since).select("uid").orderBy("uid").limit(batch).agg(F.max("uid")).first()[0]
    if top is None:
        return None
    plan = (len(plans) + 1, validity, above, top, since)
    _note(box, folder, "plan", plan)
    return plan


def imported(box: DataFrame, folder: str, before: int | None = None) -> DataFrame:
    """What is imported so far (by the batches before one)."""
    spark = box.sparkSession
    known = [r.n for r in _log(box, folder, "done") if before is None or r.n < before]
    return spark.read.schema(box.schema).parquet(*[f"{folder}/rows/n={n}" for n in known]) if known else spark.createDataFrame([], box.schema)


def step(box: DataFrame, folder: str, validity: int, since, batch: int = BATCH) -> bool:
    """Import one batch of box (uid, at, identity, ...); False if there is none.

    The plan is on disk before anything else, so a batch that died halfway is run again over the
    same numbers and overwrites its own part.  Of rows with one identity the least uid is taken.
    """
    plan = next_plan(box, folder, validity, since, batch)
    if plan is None:
        return False
    n, _, above, upto, since_ = plan
    own = _chosen(box, above, since_).where(F.col("uid") <= upto)
    rest = [F.col(c) for c in box.columns]
    first = own.groupBy("identity").agg(F.min_by(F.struct(*rest), "uid").alias("r")).select("r.*")
    first.join(imported(box, folder, n).select("identity"), "identity", "left_anti").select(*rest).write.mode("overwrite").parquet(f"{folder}/rows/n={n}")
    _note(box, folder, "done", plan)
    return True


def sync(box: DataFrame, folder: str, validity: int, since, batch: int = BATCH, steps: int | None = None) -> DataFrame:
    """Import all that is pending, or `steps` batches; the rows imported so far."""
    k = 0
    while (steps is None or k < steps) and step(box, folder, validity, since, batch):
        k += 1
    return imported(box, folder)


def since_column(days: int, now: Column | None = None) -> Column:
    """The start of a date window of so many days."""
    return (F.current_timestamp() if now is None else now) - F.make_dt_interval(F.lit(days))
