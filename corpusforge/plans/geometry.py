"""Geometry queries: maps of embeddings, boxes, addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import geometry as G
from ..registry import query
from ..sources.readers import table


@query("pca3_map")
def pca3_map(spark, d):
    return G.pca(table(spark, d, "embeddings"))[0]


@query("pca3_variance", None)
def pca3_variance(spark, d):
    return spark.createDataFrame([(k + 1, float(v)) for k, v in enumerate(G.pca(table(spark, d, "embeddings"))[1])], "component int, share double")


@query("robust_spread", "SELECT label, greatest(list_sort(list(m))[least(count(*) - 1, CAST(floor(count(*) * 0.9) AS BIGINT)) + 1], 0.05) AS spread FROM (SELECT label, round(abs(CAST(embedding[1] AS DOUBLE)), 6) AS m FROM embeddings) GROUP BY label")
def robust_spread(spark, d):
    m = table(spark, d, "embeddings").select("label", F.round(F.abs(F.col("embedding")[0].cast("double")), 6).alias("m"))
    return G.robust_spread(m, ["label"])


@query("unit_vectors", "SELECT vec_id, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm, 1.0::DOUBLE AS unit_norm FROM embeddings")
def unit_vectors(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.round(V.norm(V.unit(F.col("embedding"))), 6).alias("unit_norm"))


@query("sigmoid_clamp", "SELECT event_id, round(1 / (1 + exp(-value / 100)), 6) AS s, greatest(0.0, least(1.0, value / 100)) AS c FROM events")
def sigmoid_clamp(spark, d):
    v = F.col("value") / 100
    return table(spark, d, "events").select("event_id", F.round(V.sigmoid(v), 6).alias("s"), V.clamp01(v).alias("c"))


def boxes(spark, d):
    e = table(spark, d, "part")
    x, y = (F.col("p_partkey") % 7 / 10).cast("double"), (F.col("p_partkey") % 11 / 20).cast("double")
    return e.select("p_partkey", "p_brand", x.alias("x0"), y.alias("y0"), (x + F.col("p_size") / 100).alias("x1"), (y + 0.2).alias("y1"))


_BOX = "bx AS (SELECT p_partkey, p_brand, p_partkey % 7 / 10 AS x0, p_partkey % 11 / 20 AS y0, p_partkey % 7 / 10 + p_size / 100 AS x1, p_partkey % 11 / 20 + 0.2::DOUBLE AS y1 FROM part)"


@query("bbox_union", f"WITH {_BOX} SELECT p_brand, round(min(x0), 4) AS x0, round(min(y0), 4) AS y0, round(max(x1), 4) AS x1, round(max(y1), 4) AS y1 FROM bx GROUP BY p_brand")
def bbox_union(spark, d):
    return G.union(boxes(spark, d), ["p_brand"])


@query("box_decode", "SELECT p_partkey, CASE WHEN ok THEN x0 END AS x0, CASE WHEN ok THEN y0 END AS y0, CASE WHEN ok THEN x1 END AS x1, CASE WHEN ok THEN y1 END AS y1 FROM (SELECT *, x1 > x0 AND y1 > y0 AND p_partkey % 7 <> 3 AS ok FROM (SELECT p_partkey, p_partkey % 900 / 1000 AS x0, p_size / 100 AS y0, least(1.0, (p_partkey % 900 + 20 * p_size - 200) / 1000) AS x1, least(1.0, (p_size * 10 + 300) / 1000) AS y1 FROM part))")
def box_decode(spark, d):
    """Boxes of models with either order of axes; inverted ones and those of three numbers are none."""
    p, first = table(spark, d, "part"), F.col("p_partkey") % 2 == 0
    x0, y0, x1, y1 = F.col("p_partkey") % 900, F.col("p_size") * 10, F.col("p_partkey") % 900 + F.col("p_size") * 20 - 200, F.col("p_size") * 10 + 300
    four = F.when(first, F.array(y0.cast("long"), x0, y1.cast("long"), x1)).otherwise(F.array(x0, y0.cast("long"), x1, y1.cast("long")))
    raw = F.when(F.col("p_partkey") % 7 == 3, F.slice(four, 1, 3)).otherwise(four)
    return p.select("p_partkey", G.decoded_box(raw, first).alias("b")).select("p_partkey", "b.*")


@query("iou_neighbours", f"WITH {_BOX}, p AS (SELECT a.p_partkey, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS i, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS s FROM bx a JOIN bx b ON b.p_partkey = a.p_partkey + 7) SELECT p_partkey, round(i / (s - i), 6) AS iou FROM p")
def iou_neighbours(spark, d):
    b = boxes(spark, d).select("p_partkey", F.struct("x0", "y0", "x1", "y1").alias("box"))
    other = b.select((F.col("p_partkey") - 7).alias("p_partkey"), F.col("box").alias("other"))
    return b.join(other, "p_partkey").select("p_partkey", F.round(G.iou(F.col("box"), F.col("other")), 6).alias("iou"))


_BLOCKS = ", ".join(f"({sum(int(x) << s for x, s in zip(b.split('/')[0].split('.'), (24, 16, 8, 0)))}, {1 << (32 - int(b.split('/')[1]))})" for b in G.BLOCKED)
_QUADS = "a AS (SELECT c_custkey, [10, 100, 127, 169, 172, 192, 198, 203, 8, 224, 0, 1][c_custkey % 12 + 1] ::BIGINT AS q1, [0, 31, 64, 254, 168, 51, 18, 113, 16][c_custkey // 12 % 9 + 1] AS q2, c_nationkey * 11 AS q3, c_custkey % 256 AS q4 FROM customer)"


@query(
    "ip_blocked",
    f"""WITH {_QUADS}, b(lo, n) AS (VALUES {_BLOCKS})
SELECT c_custkey, CASE c_custkey % 7 WHEN 5 THEN c_custkey % 2 = 0 WHEN 6 THEN true ELSE q3 > 255 OR EXISTS (SELECT 1 FROM b WHERE ((q1 * 256 + q2) * 256 + q3) * 256 + q4 >= lo AND ((q1 * 256 + q2) * 256 + q3) * 256 + q4 < lo + n) END AS blocked FROM a""",
)
def ip_blocked(spark, d):
    """Addresses that no fetch may reach: private and reserved blocks of both protocols, and what is no address."""
    key, at = F.col("c_custkey"), lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    quad = F.concat_ws(".", at((10, 100, 127, 169, 172, 192, 198, 203, 8, 224, 0, 1), key % 12).cast("string"), at((0, 31, 64, 254, 168, 51, 18, 113, 16), F.floor(key / 12) % 9).cast("string"), (F.col("c_nationkey") * 11).cast("string"), (key % 256).cast("string"))
    six = F.concat(F.when(key % 2 == 0, "fe80::").otherwise("2606:4700::"), F.lower(F.hex(key % 65536)))
    address = F.when(key % 7 == 5, six).when(key % 7 == 6, F.concat(F.lit("host-"), key.cast("string"))).otherwise(quad)
    return table(spark, d, "customer").select("c_custkey", G.blocked_address(address).alias("blocked"))
