"""Table queries: statistics and slices of parts and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tabular as T
from ..registry import query
from ..sources.readers import table

_STAT = "count(*) AS n, round(sum({c}), 4) AS sum, round(avg({c}), 4) AS mean, round(median({c}), 4) AS median, max({c}) AS max, min(CAST({l} AS VARCHAR)) FILTER ({c} = m) AS max_label, min({c}) AS min, max(CAST({l} AS VARCHAR)) FILTER ({c} = k) AS min_label"


def _stat(c: str) -> str:
    return f"SELECT p_brand, '{c}' AS \"column\", " + _STAT.format(c="v", l="p_partkey") + f" FROM (SELECT p_brand, p_partkey, CAST({c} AS DOUBLE) AS v, max(CAST({c} AS DOUBLE)) OVER (PARTITION BY p_brand) AS m, min(CAST({c} AS DOUBLE)) OVER (PARTITION BY p_brand) AS k FROM part) GROUP BY p_brand"


@query("table_stats", _stat("p_size") + " UNION ALL " + _stat("p_retailprice"))
def table_stats(spark, d):
    return T.statistics(table(spark, d, "part"), "p_partkey", ["p_size", "p_retailprice"], ["p_brand"])


@query("table_extremes", "SELECT p_brand, side, CAST(place AS INTEGER) AS place, p_partkey AS label, p_retailprice AS value FROM (SELECT *, 'top' AS side, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS place FROM part UNION ALL SELECT *, 'bottom', row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) FROM part) WHERE place <= 3")
def table_extremes(spark, d):
    return T.extremes(table(spark, d, "part"), "p_partkey", "p_retailprice", ["p_brand"])


@query("table_numeric_columns", "SELECT name, filled, parsed, name IN ('p_partkey', 'p_size', 'p_retailprice') AS numeric FROM (SELECT unnest(['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice']) AS name, count(*) AS filled FROM part GROUP BY 1) JOIN (SELECT unnest(['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice']) AS name, unnest([count(*), 0, 0, 0, count(*), count(*)]) AS parsed FROM part) USING (name)")
def table_numeric_columns(spark, d):
    return T.numeric_columns(table(spark, d, "part"))


@query("table_slices", "WITH r AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n, '| ' || p_partkey || ' | ' || replace(p_name, '|', '\\|') || ' | ' || p_size || ' |' AS line FROM part) SELECT p_brand, CAST((n - 1) // 20 AS INTEGER) AS slice, 'rows ' || min(n) || '–' || max(n) AS label, string_agg(line, chr(10) ORDER BY n) AS body FROM r GROUP BY p_brand, (n - 1) // 20")
def table_slices(spark, d):
    return T.slices(table(spark, d, "part"), ["p_brand"], "p_partkey", ["p_partkey", "p_name", "p_size"])


@query("table_blocks", "WITH r AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part) SELECT p_brand, 0 AS ordinal, 'stats' AS kind FROM part GROUP BY p_brand UNION ALL SELECT p_brand, CAST((n - 1) // 20 + 1 AS INTEGER), 'rows' FROM r GROUP BY p_brand, (n - 1) // 20")
def table_blocks(spark, d):
    """A table's blocks: statistics first, then its slices."""
    part = table(spark, d, "part")
    stats = part.select("p_brand").distinct().select("p_brand", F.lit(0).alias("ordinal"), F.lit("stats").alias("kind"))
    rows = T.slices(part, ["p_brand"], "p_partkey", ["p_partkey"]).select("p_brand", (F.col("slice") + 1).alias("ordinal"), F.lit("rows").alias("kind"))
    return stats.unionByName(rows)


@query("header_names", "SELECT p_brand, ['Name', 'Column 2', CASE WHEN n % 2 = 0 THEN 'Size' ELSE 'Column 3' END] AS names FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand)")
def header_names(spark, d):
    """Names of each brand's table: blanks become numbered columns."""
    n = table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    cells = F.array(F.lit(" Name"), F.lit("  "), F.when(F.col("n") % 2 == 0, "Size "))
    return n.select("p_brand", T.header_names(cells).alias("names"))
