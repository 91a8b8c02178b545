"""Event-stream frames from fragments that were cut anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def frames(fragments: DataFrame, by: list[str], order: list[str], text: str = "text") -> DataFrame:
    """by, frame (from 0), content, is_rest: fragments put together and parted at blank lines; what follows the last one is the rest.

    No stream is joined as a whole.  A run of line ends parts frames two by two, also where the run
    is spread over fragments, so what a fragment needs to know of those before it is how many line
    ends stand directly before it: its offset less the end of the last other character, two
    running sums.  An odd one is moved from the end of a fragment to the next; then every
    fragment is parted on its own, and a running count of the parts numbers the frames.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    f = fragments.select(*by, *order, F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n", "\n").alias("_t")).where(F.length("_t") > 0)
    f = f.withColumn("_at", F.coalesce(F.sum(F.length("_t")).over(before), F.lit(0)))
    f = f.withColumn("_other", F.when(F.col("_t").rlike("[^\n]"), F.col("_at") + F.length(F.regexp_replace("_t", "\n+$", ""))))
    f = f.withColumn("_open", (F.col("_at") - F.coalesce(F.max("_other").over(before), F.lit(0))) % 2)
    end = F.col("_at") + F.length("_t")
    f = f.withColumn("_left", (end - F.coalesce(F.max("_other").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))) % 2)
    last = F.lead(F.lit(True)).over(w).isNull()
    body = F.concat(F.when(F.col("_open") == 1, "\n").otherwise(""), F.col("_t"))
    body = F.when((F.col("_left") == 1) & ~last, F.substring(body, F.lit(1), F.length(body) - 1)).otherwise(body)
    f = f.withColumn("_parts", F.split(body, "\n\n"))
    f = f.withColumn("_first", F.coalesce(F.sum(F.size("_parts") - 1).over(before), F.lit(0)))
    ends = F.max(F.col("_first") + F.size("_parts") - 1).over(Window.partitionBy(*by))
    p = f.withColumn("_final", ends).select(*by, *order, "_final", "_first", F.posexplode("_parts").alias("_i", "_part"))
    g = p.groupBy(*by, (F.col("_first") + F.col("_i")).alias("frame"), "_final").agg(F.array_sort(F.collect_list(F.struct(*order, "_part"))).alias("a"))
    return g.select(*by, "frame", F.array_join(F.transform("a", lambda x: x["_part"]), "").alias("content"), (F.col("frame") == F.col("_final")).alias("is_rest"))


def deltas(framed: DataFrame, by: list[str]) -> DataFrame:
    """by, frame, delta: the contents of a stream's data frames up to [DONE]; frames without data, malformed ones and the rest give none."""
    line = F.get(F.filter(F.split("content", "\n"), lambda x: x.startswith("data:")), F.lit(0))
    payload = F.trim(F.regexp_replace(line, "^data:", ""))
    f = framed.where("not is_rest").select(*by, "frame", payload.alias("payload"))
    done = F.min(F.when(F.col("payload") == "[DONE]", F.col("frame"))).over(Window.partitionBy(*by))
    f = f.withColumn("done", done).where("done is null or frame < done")
    return f.select(*by, "frame", F.get_json_object("payload", "$.choices[0].delta.content").alias("delta")).where("delta <> ''")
