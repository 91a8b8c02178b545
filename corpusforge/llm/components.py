"""Connected components of a link table, wholly on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

MAX_ROUNDS = 60


def components(links: DataFrame, folder: str, name: str = "cc") -> DataFrame:
    """id, component (the smallest id reachable) of every id in links (u, v).

    Each round takes the least label among neighbours and then follows the label's own label
    (pointer jumping), so paths shorten geometrically.  Labels are written to the shared folder
    every round; only their sum and count reach the driver.
    """
    both = stored(links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct(), folder, f"{name}-links")
    labels = stored(both.groupBy(F.col("u").alias("id")).agg(F.least(F.col("id"), F.min("v")).alias("component")), folder, f"{name}-0")
    last = None
    for k in range(1, MAX_ROUNDS):
        near = both.join(labels, both.v == labels.id).groupBy("u").agg(F.min("component").alias("least"))
        met = labels.join(near, labels.id == near.u).select("id", F.least("component", "least").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("next"))
        labels = stored(met.join(jump, "component", "left").select("id", F.least("component", F.coalesce("next", "component")).alias("component")), folder, f"{name}-{k}")
        now = labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        if now == last or now is None:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return labels
