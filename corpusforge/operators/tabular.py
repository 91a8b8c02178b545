"""Tables as documents: numeric columns, statistics with labels, row slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import number_of

SLICE = 20


def header_names(cells: Column) -> Column:
    """Names of a header row's cells: blank and null ones become `Column i`."""
    name = lambda c, i: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.trim(c)).otherwise(F.concat(F.lit("Column "), (i + 1).cast("string")))
    return F.transform(cells, name)


def numeric_columns(df: DataFrame) -> DataFrame:
    """name, filled, parsed, numeric: a column is numeric if 80 % of its filled cells (one at least) are numbers."""
    aggs = []
    for c in df.columns:
        s = F.col(c).cast("string")
        aggs += [F.count_if(F.trim(s) != "").alias(f"f_{c}"), F.count_if(number_of(s).isNotNull()).alias(f"p_{c}")]
    row = df.agg(*aggs)
    wide = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"f_{c}").alias("filled"), F.col(f"p_{c}").alias("parsed")) for c in df.columns])
    return row.select(F.explode(wide).alias("x")).select("x.*").withColumn("numeric", F.col("parsed") >= F.greatest(F.lit(1), F.floor(F.col("filled") * 0.8)))


def statistics(df: DataFrame, label: str, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """by, column, count, sum, mean, median, and the extreme values with their row labels (first label on ties for the greatest, last for the least)."""
    by = by or []
    long = df.select(*by, F.col(label).cast("string").alias("label"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select(*by, "label", "x.*").where("v is not null")
    return long.groupBy(*by, "column").agg(
        F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("sum"), F.round(F.avg("v"), 4).alias("mean"), F.round(F.median("v"), 4).alias("median"),
        F.max("v").alias("max"), F.min(F.struct((-F.col("v")).alias("k"), "label"))["label"].alias("max_label"),
        F.min("v").alias("min"), F.max(F.struct((-F.col("v")).alias("k"), "label"))["label"].alias("min_label"),
    )


def extremes(df: DataFrame, label: str, value: str, by: list[str], k: int = 3) -> DataFrame:
    """The k greatest and the k least rows of each group: by, side, place, label, value."""
    top = df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), F.asc(label)))).where(F.col("place") <= k).withColumn("side", F.lit("top"))
    low = df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.asc(value), F.asc(label)))).where(F.col("place") <= k).withColumn("side", F.lit("bottom"))
    return top.unionByName(low).select(*by, "side", "place", F.col(label).alias("label"), F.col(value).alias("value"))


def markdown_row(cells: list[Column]) -> Column:
    """| a | b |, with bars escaped and line breaks as blanks."""
    safe = [F.replace(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\n", " "), F.lit("|"), F.lit(r"\|")) for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *safe), F.lit(" |"))


def slices(df: DataFrame, by: list[str], order: str, cells: list[str], size: int = SLICE) -> DataFrame:
    """by, slice, label (rows a–b), body: markdown blocks of `size` rows."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    rows = df.select(*by, n.alias("n"), markdown_row([F.col(c) for c in cells]).alias("line")).withColumn("slice", F.floor((F.col("n") - 1) / size).cast("int"))
    return rows.groupBy(*by, "slice").agg(
        F.concat(F.lit("rows "), F.min("n").cast("string"), F.lit("–"), F.max("n").cast("string")).alias("label"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("body"),
    )
