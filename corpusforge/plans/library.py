"""Queries over stored chunks, names, filters and the map's view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import geometry as G
from ..operators import regions as R
from ..operators import search as S
from ..operators import store
from ..registry import query
from ..session import shared_folder
from ..sources.readers import table
from .retrieval import POSTINGS


def docs(spark, d):
    return table(spark, d, "documents")


@query("store_mutations", "SELECT doc_id, source AS kb, CASE WHEN doc_id % 5 = 0 THEN 3 WHEN doc_id % 10 <> 9 THEN 1 ELSE 2 END AS version FROM documents WHERE source <> 'src3' AND (doc_id % 10 <> 9 OR doc_id % 3 = 0 OR doc_id % 5 = 0)")
def store_mutations(spark, d):
    """A store is written, completed by absent rows, given new versions, and loses one collection."""
    columns, folder = "doc_id long, ordinal int, version int, kb string", shared_folder(spark)
    rows = lambda keep, v: docs(spark, d).where(keep).select("doc_id", F.lit(0).alias("ordinal"), F.lit(v).alias("version"), F.col("source").alias("kb"))
    store.create(rows("doc_id % 10 <> 9", 1), folder)
    store.insert_absent(spark, folder, rows("doc_id % 3 = 0", 2), columns)
    store.replace_documents(spark, folder, rows("doc_id % 5 = 0", 3), columns)
    store.delete_kb(spark, folder, "src3")
    return store.read(spark, folder, columns).select("doc_id", "kb", "version")


@query("payload_search", f"WITH documents AS (SELECT * FROM main.documents WHERE source = 'src1' AND lang IN ('en', 'fr') AND doc_id % 4 = 1 AND doc_id % 3 IN (0, 2)), {POSTINGS} SELECT item_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM sparse WHERE rank <= 12")
def payload_search(spark, d):
    """Top-k among the rows of one collection that pass filters by modality, page and region type."""
    rows = docs(spark, d).withColumns({"kb": F.col("source"), "modality": F.col("lang"), "page": F.col("doc_id") % 4, "region_type": F.element_at(F.array(*[F.lit(x) for x in ("chart", "text", "table")]), (F.col("doc_id") % 3 + 1).cast("int"))})
    own = S.payload(rows, "src1", modality=("en", "fr"), page=1, region_type=("chart", "table"))
    return S.sparse_topk(own, table(spark, d, "benchmark"), 12)


@query("owned_documents", "SELECT o_orderkey AS doc_id, l_linenumber AS chunk FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)")
def owned_documents(spark, d):
    """Chunks whose document belongs to a collection of the asking user (orders to customers of one nation)."""
    mine = table(spark, d, "customer").where("c_nationkey = 7").select(F.col("c_custkey").alias("o_custkey"))
    held = table(spark, d, "orders").join(mine, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("doc_id"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("chunk")).join(held, "doc_id")


_MAIL = "SELECT doc_id, doc_id % 4 < 3 AS m, CASE doc_id % 4 WHEN 0 THEN source || ' — ' || lang || '.TXT' WHEN 1 THEN source || ' — a — ' || lang WHEN 2 THEN source || '.txt' ELSE source || ' — x' END AS f FROM documents"


@query(
    "mail_display_name",
    f"WITH f AS ({_MAIL}), b AS (SELECT doc_id, m, f, regexp_replace(f, '(?i)\\.txt$', '') AS b FROM f), s AS (SELECT *, string_split(b, ' — ') AS p FROM b) SELECT doc_id, CASE WHEN m AND len(p) > 1 THEN array_to_string(p[:-2], ' — ') WHEN m THEN b ELSE f END AS name, CASE WHEN len(p) > 1 THEN p[-1] END AS sender FROM s",
)
def mail_display_name(spark, d):
    """Mails by subject, other documents by their file's name."""
    k = F.col("doc_id") % 4
    name = F.when(k == 0, F.concat("source", F.lit(" — "), "lang", F.lit(".TXT"))).when(k == 1, F.concat("source", F.lit(" — a — "), "lang")).when(k == 2, F.concat("source", F.lit(".txt"))).otherwise(F.concat("source", F.lit(" — x")))
    return docs(spark, d).select("doc_id", T.display_name(name, k < 3).alias("name"), T.mail_parts(name)["sender"].alias("sender"))


@query("analysed_question", "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN trim(text) WHEN turn % 3 = 1 THEN role ELSE role END AS q FROM conversations WHERE role = 'user' AND (turn % 3 <> 0 OR trim(text) <> '') UNION ALL SELECT conv_id, turn, role FROM conversations WHERE role = 'user' AND turn % 3 = 0 AND coalesce(trim(text), '') = ''")
def analysed_question(spark, d):
    """The wording that is searched: the resolved question; the user's own where analysis gave a blank or failed."""
    k = F.col("turn") % 3
    resolved = F.when(k == 0, F.concat(F.lit("  "), F.col("text"), F.lit(" "))).when(k == 1, "   ")
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", T.search_query(resolved, F.col("role")).alias("q"))


@query("events_since", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def events_since(spark, d):
    """Events of the last seven days before the newest one."""
    e = table(spark, d, "events").select("event_id", "ts")
    since = e.agg(F.max("ts").alias("now")).select((F.col("now") - F.make_dt_interval(F.lit(7))).alias("since"))
    return e.join(F.broadcast(since), F.col("ts") >= F.col("since")).select("event_id")


@query("map_projection", "WITH p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings), r AS (SELECT vec_id, x * cos(0.6) - z * sin(0.6) AS x1, x * sin(0.6) + z * cos(0.6) AS z1, y FROM p), t AS (SELECT vec_id, x1, y * cos(-0.3) - z1 * sin(-0.3) AS y1, y * sin(-0.3) + z1 * cos(-0.3) AS z2 FROM r) SELECT vec_id, round(400 + x1 * 180 / (1.8 - z2 * 0.35), 6) AS px, round(300 - y1 * 180 / (1.8 - z2 * 0.35), 6) AS py, round(z2, 6) AS depth FROM t")
def map_projection(spark, d):
    """Points of the map on the screen, for one rotation."""
    e = table(spark, d, "embeddings")
    at = G.projected(*[F.col("embedding")[i].cast("double") for i in range(3)], yaw=0.6, pitch=-0.3, scale=180, centre=(400, 300))
    return e.select("vec_id", at.alias("p")).select("vec_id", *[F.round(F.col(f"p.{s}"), 6).alias(n) for s, n in (("x", "px"), ("y", "py"), ("depth", "depth"))])


@query("embedding_map")
def embedding_map(spark, d):
    """Three coordinates of every vector and of a question (id -1), which takes part in the fit; previews of 160 characters."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    asked = e.where("vec_id = 0").select(F.lit(-1).cast("long").alias("vec_id"), "embedding")
    mapped, _ = G.pca(e.unionByName(asked))
    said = docs(spark, d).select(F.col("doc_id").alias("vec_id"), F.substring("text", 1, 160).alias("preview"))
    return mapped.join(said, "vec_id", "left").withColumn("is_query", F.col("vec_id") == -1)


_GRID = "g AS (SELECT p_brand, p_partkey, p_partkey % 2 = 0 AS l, (p_partkey // 2 % 40) / 50 + CASE WHEN p_partkey % 2 = 1 THEN p_size % 3 * 0.004 ELSE 0 END AS cy, p_size % 4 < 2 AS num, len(regexp_split_to_array(trim(p_name), '\\s+')) <= 4 AS few FROM part WHERE p_size % 5 < 3 OR p_brand > 'Brand#3')"


@query(
    "gutter_is_grid",
    f"""WITH {_GRID}, n AS (SELECT p_brand, count(*) FILTER (l) AS nl, count(*) FILTER (NOT l) AS nr, count(*) FILTER (l AND num) AS ml, count(*) FILTER (NOT l AND num) AS mr, bool_and(num OR few) AS cells FROM g GROUP BY p_brand),
p AS (SELECT a.p_brand, a.l, count(*) FILTER (EXISTS (SELECT 1 FROM g b WHERE b.p_brand = a.p_brand AND b.l <> a.l AND abs(a.cy - b.cy) <= 0.35 * 0.015)) AS k FROM g a GROUP BY a.p_brand, a.l)
SELECT n.p_brand, coalesce(nl >= 2 AND nr >= 2 AND p.k >= 0.8 * least(nl, nr) AND (ml >= 0.5 * nl OR mr >= 0.5 * nr OR cells), false) AS is_grid FROM n LEFT JOIN p ON p.p_brand = n.p_brand AND p.l = (nl <= nr)""",
)
def gutter_is_grid(spark, d):
    """Lines left and right of a gutter: columns of one table, or two columns of prose."""
    right, cell = F.col("p_partkey") % 2 == 1, F.when(F.col("p_size") % 4 < 2, F.col("p_size").cast("string")).otherwise(F.col("p_name"))
    cy = F.floor(F.col("p_partkey") / 2) % 40 / 50 + F.when(right, F.col("p_size") % 3 * 0.004).otherwise(0.0)
    lines = table(spark, d, "part").where("p_size % 5 < 3 or p_brand > 'Brand#3'").select("p_brand", (~right).alias("is_left"), (cy - 0.0075).alias("y0"), (cy + 0.0075).alias("y1"), cell.alias("text"))
    return G.gutter_is_grid(lines, ["p_brand"])


@query("region_likeness", "WITH b AS (SELECT p_partkey, p_partkey % 3 AS k, p_size % 10 / 20 AS s FROM part), v AS (SELECT p_partkey, k, greatest(0, 0.5 - s) AS i FROM b) SELECT p_partkey, round(CASE k WHEN 0 THEN 0.5 WHEN 1 THEN 1 / 3 ELSE i / (1 - i) END, 6) AS score FROM v")
def region_likeness(spark, d):
    """Two readings of a region by their numbers, else by their cells, else by their boxes."""
    k, s = F.col("p_partkey") % 3, F.col("p_size") % 10 / 20
    none = F.array().cast("array<string>")
    words = lambda *x: F.array(*[F.lit(w) for w in x])
    box = lambda x: F.struct(x.alias("x0"), F.lit(0.0).alias("y0"), (x + 0.5).alias("x1"), F.lit(1.0).alias("y1"))
    score = R.likeness(F.when(k == 0, words("1", "2", "3")).otherwise(none), F.when(k == 0, words("2", "3", "4")).otherwise(none), F.when(k == 1, words("a", "b")).otherwise(none), F.when(k < 2, words("b", "c")).otherwise(none), box(F.lit(0.0)), box(s))
    return table(spark, d, "part").select("p_partkey", F.round(score, 6).alias("score"))
