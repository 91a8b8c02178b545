"""Text queries: sentences, chunks, pages, questions, labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunks as C
from ..operators.search import numbered, sparse_topk
from ..registry import query
from ..sources import readers as R
from ..sources.readers import table

_SHORT = "|".join(T.ABBREVIATIONS)
_PROTECT = rf"regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '(^|[^A-Za-z0-9_])([A-Z]|{_SHORT})\.', '\1\2' || chr(2), 'g')"
SENTENCES = rf"""sp AS (SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace({_PROTECT}, '([.!?])\s+([^a-z\s])', '\1' || chr(1) || '\2', 'g'), '\n(#{{1,6}}[ \t])', chr(1) || '\1', 'g'), chr(1)), lambda s: trim(s, ' ' || chr(10) || chr(9)) <> '') AS s FROM documents)"""


@query("sentence_split", f"WITH {SENTENCES} SELECT doc_id, CAST(len(s) AS INTEGER) AS n_sentences, CAST(max_len AS INTEGER) AS longest FROM (SELECT doc_id, s, list_max(list_transform(s, lambda x: length(x))) AS max_len FROM sp)")
def sentence_split(spark, d):
    s = table(spark, d, "documents").select("doc_id", T.split_sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("n_sentences"), F.array_max(F.transform("s", F.length)).alias("longest"))


@query("sentence_rows", rf"WITH {SENTENCES} SELECT doc_id, pos - 1 AS pos, replace(x, chr(2), '.') AS sentence FROM (SELECT doc_id, unnest(s) AS x, CAST(generate_subscripts(s, 1) AS INTEGER) AS pos FROM sp)")
def sentence_rows(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.split_sentences(F.col("text"))).alias("pos", "sentence"))


#: What Python and Java take for white space.
_BLANK = "".join(map(chr, [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]))


def chunks_sql(sentences: str, target: int = C.TARGET, overlap: int = C.OVERLAP) -> str:
    """CTEs sen, walk and packed (id, part, text, start, stop): sentences of texts packed one by one; `sentences` selects id, text and the list s."""
    joined = lambda x: f"array_to_string({x}, ' ')"
    size = lambda x: f"coalesce(list_sum(list_transform({x}, lambda z: length(z))), 0)"
    return f"""sen AS MATERIALIZED (SELECT id, text, list_transform(s, lambda z: replace(z, chr(2), '.')) AS s FROM ({sentences}) WHERE length(text) > {target}),
walk AS (SELECT id, 0 AS k, CAST([] AS VARCHAR[]) AS held, CAST(0 AS BIGINT) AS size, CAST(0 AS BIGINT) AS place, CAST(0 AS BIGINT) AS cur, CAST(NULL AS VARCHAR) AS a, CAST(0 AS BIGINT) AS a_at, CAST(NULL AS VARCHAR) AS b, CAST(0 AS BIGINT) AS b_at FROM sen
UNION ALL SELECT id, k, CASE WHEN full_ THEN tail ELSE held2 END, CASE WHEN full_ THEN {size("tail")} ELSE size2 END, CASE WHEN full_ THEN cur2 - {size("tail")} ELSE place2 END, cur2, a, a_at, CASE WHEN full_ THEN {joined("held2")} END, place2
FROM (SELECT *, CASE WHEN cut <= 1 THEN CAST([] AS VARCHAR[]) ELSE held2[cut:] END AS tail
FROM (SELECT *, size2 >= {target} AS full_, list_min(list_filter(range(1, len(held2) + 1), lambda i: i = len(held2) OR {size("held2[i:]")} <= {overlap})) AS cut
FROM (SELECT id, k, a, a_at, list_append(held1, x) AS held2, size1 + length(x) AS size2, start + length(x) AS cur2, CASE WHEN len(held1) = 0 THEN start ELSE place END AS place2
FROM (SELECT *, CASE WHEN opens THEN CAST([] AS VARCHAR[]) ELSE held END AS held1, CASE WHEN opens THEN 0 ELSE size END AS size1, CASE WHEN opens THEN {joined("held")} END AS a, place AS a_at
FROM (SELECT w.id, w.k + 1 AS k, w.held, w.size, w.place, sen.s[w.k + 1] AS x, CASE WHEN instr(substr(text, w.cur + 1), sen.s[w.k + 1]) > 0 THEN w.cur + instr(substr(text, w.cur + 1), sen.s[w.k + 1]) - 1 ELSE w.cur END AS start,
regexp_matches(sen.s[w.k + 1], '^#{{1,6}}[ \t]') AND w.size >= {C.HEADING_MIN} AS opens FROM walk w JOIN sen USING (id) WHERE w.k < len(sen.s))))))),
emitted AS (SELECT id, k, 1 AS o, a AS body, a_at AS place FROM walk WHERE a IS NOT NULL UNION ALL SELECT id, k, 2, b, b_at FROM walk WHERE b IS NOT NULL
UNION ALL SELECT id, k + 1, 3, {joined("held")}, place FROM walk JOIN sen USING (id) WHERE k = len(sen.s)),
packed AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY k, o) - 1 AS INTEGER) AS part, trim(body, '{_BLANK}') AS text, CAST(place AS INTEGER) AS start, CAST(place + length(body) AS INTEGER) AS stop FROM emitted WHERE trim(body, '{_BLANK}') <> '')"""


_CHUNKS = f"""WITH RECURSIVE {SENTENCES}, {chunks_sql("SELECT documents.doc_id AS id, text, s FROM documents JOIN sp USING (doc_id)")}
SELECT id AS doc_id, part AS ordinal, text, start, stop FROM packed UNION ALL SELECT doc_id, 0, trim(text, '{_BLANK}'), 0, CAST(length(text) AS INTEGER) FROM documents WHERE length(text) <= {C.TARGET} AND trim(text, '{_BLANK}') <> ''"""


@query("chunk_documents", _CHUNKS)
def chunk_documents(spark, d):
    """Fold over sentences with overlap; held against the column-expression form in the tests."""
    return C.chunks(table(spark, d, "documents"))


@query("chunk_fold", _CHUNKS)
def chunk_fold(spark, d):
    """The same chunks by a JVM-side fold."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(C.pack(F.col("text"))).alias("ordinal", "c")).select("doc_id", "ordinal", "c.text", "c.start", "c.stop")


_BLOCKS = """blocks AS (SELECT conv_id AS doc_id, turn AS place, CASE turn % 7 WHEN 3 THEN 'image' WHEN 5 THEN 'region' ELSE 'text' END AS kind, CASE WHEN turn % 7 IN (3, 5) THEN 'layout' WHEN turn // 3 % 2 = 0 THEN 'asr' ELSE 'text' END AS source,
text, CAST(turn // 12 AS INTEGER) AS page, turn * 10.0::DOUBLE AS ts_start, turn * 10.0::DOUBLE + 8 AS ts_end, 's' || turn // 6 AS section FROM conversations
UNION ALL SELECT 1000000 + doc_id, 0, 'text', 'text', '# Part ' || doc_id % 10 || chr(10) || text, 1, NULL, NULL, 'none' FROM documents UNION ALL SELECT 1000000 + doc_id, 1, 'text', 'text', 'See above.', 2, NULL, NULL, 'end' FROM documents)"""


def _blocks(spark, d):
    """Conversations as transcripts with images and regions in between, documents as one long block and a short one."""
    t = F.col("turn")
    c = table(spark, d, "conversations").select(
        F.col("conv_id").alias("doc_id"), t.alias("place"), F.when(t % 7 == 3, "image").when(t % 7 == 5, "region").otherwise("text").alias("kind"),
        F.when((t % 7).isin(3, 5), "layout").when(F.floor(t / 3) % 2 == 0, "asr").otherwise("text").alias("source"), "text", F.floor(t / 12).cast("int").alias("page"),
        (t * 10.0).alias("ts_start"), (t * 10.0 + 8).alias("ts_end"), F.concat(F.lit("s"), F.floor(t / 6).cast("string")).alias("section"),
    )
    d_ = table(spark, d, "documents").select((F.col("doc_id") + 1_000_000).alias("doc_id"), F.concat(F.lit("# Part "), (F.col("doc_id") % 10).cast("string"), F.lit("\n"), "text").alias("long"))
    part = lambda place, text, page, section: F.struct(F.lit(place).cast("long").alias("place"), F.lit("text").alias("kind"), F.lit("text").alias("source"), text.alias("text"), F.lit(page).alias("page"), F.lit(None).cast("double").alias("ts_start"), F.lit(None).cast("double").alias("ts_end"), F.lit(section).alias("section"))
    return c.unionByName(d_.select("doc_id", F.explode(F.array(part(0, F.col("long"), 1, "none"), part(1, F.lit("See above."), 2, "end"))).alias("b")).select("doc_id", "b.*"))


_PLAN = rf"""WITH RECURSIVE {_BLOCKS}, b1 AS (SELECT doc_id, place, kind, source, coalesce(text, '') AS text, page, ts_start, ts_end, section, kind = 'text' AND source = 'asr' AS asr FROM blocks),
b2 AS (SELECT *, sum(CASE WHEN asr AND coalesce(before AND page0 = page, false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY place) AS run FROM (SELECT *, lag(asr) OVER w AS before, lag(page) OVER w AS page0 FROM b1 WINDOW w AS (PARTITION BY doc_id ORDER BY place))),
b AS (SELECT *, CASE WHEN kind IN ('region', 'image') THEN kind WHEN count(*) OVER (PARTITION BY doc_id, run) > 1 THEN 'transcript' WHEN length(text) > {C.TARGET} THEN 'split' ELSE 'whole' END AS route FROM b2),
lines AS (SELECT doc_id, place, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, place, string_split_regex(text, '[\n\r\x{{2028}}\x{{2029}}]') AS l FROM b)),
heads AS (SELECT doc_id, place, n AS at_, substr(trim(regexp_extract(line, '^#{{1,6}}[ \t]+(.+?)[ \t#]*$', 1)), 1, 200) AS title FROM (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id, place ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM lines) WHERE regexp_matches(line, '^#{{1,6}}[ \t]+(.+?)[ \t#]*$')),
speech AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY place) AS n FROM b WHERE route = 'transcript'),
joined AS (SELECT doc_id, run, n, 0 AS part, length(text) AS size FROM speech WHERE n = 1 UNION ALL SELECT s.doc_id, s.run, s.n, j.part + CASE WHEN j.size > 0 AND j.size + length(s.text) > {C.TARGET} THEN 1 ELSE 0 END, CASE WHEN j.size > 0 AND j.size + length(s.text) > {C.TARGET} THEN 0 ELSE j.size END + length(s.text) FROM joined j JOIN speech s ON s.doc_id = j.doc_id AND s.run = j.run AND s.n = j.n + 1),
said AS (SELECT s.doc_id, min(place) AS place, 'transcript' AS route, arg_min(kind, place) AS kind, arg_min(source, place) AS source, trim(string_agg(trim(text), ' ' ORDER BY place)) AS text, arg_min(page, place) AS page, arg_min(ts_start, place) AS ts_start, arg_max(ts_end, place) AS ts_end, arg_min(section, place) AS section FROM speech s JOIN joined j ON j.doc_id = s.doc_id AND j.run = s.run AND j.n = s.n GROUP BY s.doc_id, s.run, j.part),
docs2 AS (SELECT doc_id * 100000 + place AS id, text FROM b WHERE route = 'split'),
{SENTENCES.replace("sp AS (SELECT doc_id,", "sp2 AS (SELECT id,").replace("FROM documents", "FROM docs2")},
{chunks_sql("SELECT id, text, s FROM docs2 JOIN sp2 USING (id)")},
cut AS (SELECT b.doc_id, b.place, p.part, b.route, kind, source, p.text, page, p.start, CAST(least(p.start + length(p.text), length(b.text)) AS INTEGER) AS stop, ts_start, ts_end, p.start + length(p.text) AS until, section FROM packed p JOIN b ON b.doc_id * 100000 + b.place = p.id AND b.route = 'split'),
placed AS (SELECT doc_id, place, 0 AS part, route, kind, source, CASE WHEN route = 'image' THEN text ELSE trim(text, '{_BLANK}') END AS text, page, CASE WHEN route = 'whole' THEN 0 END AS start, CASE WHEN route = 'whole' THEN CAST(length(text) AS INTEGER) END AS stop, ts_start, ts_end, CASE WHEN route = 'whole' THEN length(text) END AS until, section FROM b WHERE route = 'image' OR route IN ('region', 'whole') AND trim(text, '{_BLANK}') <> ''
UNION ALL SELECT * FROM cut UNION ALL SELECT doc_id, place, 0, route, kind, source, text, page, NULL, NULL, ts_start, ts_end, NULL, section FROM said WHERE text <> '')
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place, part) - 1 AS INTEGER) AS ordinal, route, kind, source, text, page, start, stop, ts_start, ts_end,
CASE WHEN until IS NULL THEN section ELSE coalesce((SELECT arg_max(title, at_) FROM heads h WHERE h.doc_id = placed.doc_id AND h.place = placed.place AND at_ <= start), (SELECT arg_min(title, at_) FROM heads h WHERE h.doc_id = placed.doc_id AND h.place = placed.place AND at_ > start AND at_ < until), section) END AS section FROM placed"""


@query("chunk_plan", _PLAN)
def chunk_plan(spark, d):
    """Chunks of all routes: regions and images as they are, transcripts merged by page, short texts whole, long ones packed; sections from heading lines."""
    return C.plan_chunks(_blocks(spark, d))


@query("chunk_ordinals", "SELECT doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INTEGER) AS ordinal FROM documents")
def chunk_ordinals(spark, d):
    """Ordinals within a source: places in one order of all rows, less the place where the source begins; no source is gathered."""
    rows = numbered(table(spark, d, "documents").select("source", "doc_id"), [F.asc("source"), F.asc("doc_id")])
    begin = rows.groupBy("source").agg(F.min("place").alias("begin"))
    return rows.join(begin, rows["source"].eqNullSafe(begin["source"])).select("doc_id", (F.col("place") - F.col("begin")).cast("int").alias("ordinal"))


_RUNS = "r AS (SELECT conv_id, turn, role, text, sum(CASE WHEN role <> 'system' AND coalesce(lag_role <> 'system', false) THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS lag_role FROM conversations))"


@query("run_detection", f"WITH {_RUNS} SELECT conv_id, turn, CAST(run AS BIGINT) AS run FROM r")
def run_detection(spark, d):
    return C.runs(table(spark, d, "conversations"), "conv_id", "turn", F.col("role") != "system").select("conv_id", "turn", "run")


@query(
    "merge_runs",
    f"""WITH RECURSIVE {_RUNS}, o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, run ORDER BY turn) AS n FROM r),
w AS (SELECT conv_id, run, n, turn, 0 AS part, turn AS first, text AS t FROM o WHERE n = 1
UNION ALL SELECT o.conv_id, o.run, o.n, o.turn, CASE WHEN length(w.t) + length(o.text) + 1 <= 800 THEN w.part ELSE w.part + 1 END, CASE WHEN length(w.t) + length(o.text) + 1 <= 800 THEN w.first ELSE o.turn END, CASE WHEN length(w.t) + length(o.text) + 1 <= 800 THEN w.t || ' ' || o.text ELSE o.text END FROM w JOIN o ON o.conv_id = w.conv_id AND o.run = w.run AND o.n = w.n + 1)
SELECT conv_id, CAST(run AS BIGINT) AS run, CAST(part AS INTEGER) AS part, first, max(turn) AS last, arg_max(t, n) AS text FROM w GROUP BY conv_id, run, part, first""",
)
def merge_runs(spark, d):
    r = C.runs(table(spark, d, "conversations"), "conv_id", "turn", F.col("role") != "system")
    return C.merge_runs(r, "conv_id", "turn", "text")


@query("section_carry", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM events")
def section_carry(spark, d):
    """The last heading so far, carried forward (purchases stand in for headings)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), True).over(w).alias("carried"))


@query(
    "section_of_span",
    "WITH h AS (SELECT doc_id, list(x ORDER BY x) AS h FROM (SELECT doc_id, unnest([50, 400, 1200]) AS x FROM documents) GROUP BY doc_id) SELECT doc_id, CASE WHEN doc_id % 1500 >= 1200 THEN 's1200' WHEN doc_id % 1500 >= 400 THEN 's400' WHEN doc_id % 1500 >= 50 THEN 's50' WHEN doc_id % 1500 + 100 > 50 THEN 's50' ELSE source END AS section FROM documents",
)
def section_of_span(spark, d):
    heads = F.array(*[F.struct(F.lit(a).alias("at"), F.lit(f"s{a}").alias("title")) for a in (50, 400, 1200)])
    start = (F.col("doc_id") % 1500).cast("int")
    return table(spark, d, "documents").select("doc_id", C.section_at(heads, start, start + 100, F.col("source")).alias("section"))


_HTML = r"""regexp_replace(html, '<head\b[^>]*>.*?</head>', ' ', 'gis')"""
for _k in range(1, 7):
    _HTML = rf"regexp_replace({_HTML}, '<h{_k}\b[^>]*>', chr(10) || chr(10) || '{'#' * _k} ', 'gi')"
for _p, _r, _o in (
    (r"</(th|td)>", "' | '", "gi"), (r"\[\s*edit\s*\]", "' '", "gi"),
    *((rf"<{t}\b[^>]*>.*?</{t}>", "' '", "gis") for t in ("script", "style", "nav", "footer", "header", "aside")),
    (r"<br\s*/?>", "chr(10)", "gi"), (r"</(p|div|h[1-6]|li|tr)>", "chr(10)", "gi"), (r"<[^>]+>", "' '", "g"),
    ("&nbsp;", "' '", "gi"), ("&amp;", "'&'", "gi"), ("&lt;", "'<'", "gi"), ("&gt;", "'>'", "gi"), ("&quot;", "'\"'", "gi"), ("&#39;", "''''", "gi"),
    (r"[ \t]+", "' '", "g"), (r"(?m)^ +| +$", "''", "g"), (r"\n{3,}", "chr(10) || chr(10)", "g"), (r"^\s+|\s+$", "''", "g"),
):
    _HTML = f"regexp_replace({_HTML}, '{_p}', {_r}, '{_o}')"


@query("html_to_text", f"SELECT page_id, md5({_HTML}) AS text_md5, CAST(length({_HTML}) AS INTEGER) AS n FROM pages")
def html_to_text(spark, d):
    t = table(spark, d, "pages").select("page_id", T.html_to_text(F.col("html"), with_title=False).alias("t"))
    return t.select("page_id", F.md5("t").alias("text_md5"), F.length("t").alias("n"))


@query("html_title", r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g')) AS title FROM pages")
def html_title(spark, d):
    return table(spark, d, "pages").select("page_id", T.html_title(F.col("html")).alias("title"))


@query("html_document", rf"SELECT page_id, CASE WHEN title <> '' THEN '# ' || title || chr(10) || chr(10) ELSE '' END || {_HTML} AS text FROM (SELECT page_id, html, trim(regexp_replace(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g')) AS title FROM pages)")
def html_document(spark, d):
    """Title line and body as one text, as an ingested page."""
    return table(spark, d, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


def _safe_sql(x: str) -> str:
    kept = rf"regexp_replace(nfc_normalize(regexp_extract({x}, '([^/]*)/*$', 1)), '[^\p{{L}}\p{{M}}\p{{N}}_.\- ]+', '_', 'g')"
    return f"coalesce(nullif(list_last(list_filter(list_transform(range(0, least(length({kept}), 200) + 1), lambda i: substr({kept}, 1, i)), lambda t: strlen(t) <= 200)), ''), 'upload')"


@query(
    "url_filename",
    rf"""WITH u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url || '/a%20b+c%C3%A9' WHEN 1 THEN 'https://Ex.org/100%/' ELSE url END AS url FROM pages), l AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host, regexp_extract(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/+$', ''), '([^/]+)$', 1) AS last FROM u),
s AS (SELECT page_id, CASE WHEN last = '' THEN host WHEN last = '100%' THEN last ELSE url_decode(last) END AS n FROM l), b AS (SELECT page_id, {_safe_sql("n")} AS b FROM s)
SELECT page_id, CASE WHEN contains(b, '.') THEN b WHEN page_id % 2 = 0 THEN b || '.pdf' ELSE b || '.txt' END AS filename FROM b""",
)
def url_filename(spark, d):
    """Names of fetched pages; some urls carry escapes, sound and broken."""
    k = F.col("page_id") % 4
    url = F.when(k == 0, F.concat("url", F.lit("/a%20b+c%C3%A9"))).when(k == 1, "https://Ex.org/100%/").otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", T.url_filename(url, F.when(F.col("page_id") % 2 == 0, "application/pdf").otherwise("text/html")).alias("filename"))


@query("safe_filename", f"WITH n AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN substr(text, 1, 80) || chr(101) || chr(769) || '.txt' WHEN 2 THEN source || '/' || substr(text, 1, 40) || '//' ELSE substr(text, 1, 300) END AS n FROM documents) SELECT doc_id, {_safe_sql('n')} AS filename FROM n")
def safe_filename(spark, d):
    """Beginnings of texts as names: with folders, decomposed accents, or too many bytes."""
    k = F.col("doc_id") % 5
    name = F.when(k == 0, "").when(k == 1, F.concat(F.substring("text", 1, 80), F.lit("é.txt"))).when(k == 2, F.concat("source", F.lit("/"), F.substring("text", 1, 40), F.lit("//"))).otherwise(F.substring("text", 1, 300))
    return table(spark, d, "documents").select("doc_id", T.safe_filename(name).alias("filename"))


_KW = ", ".join(f"'{w}'" for w in T.QUESTION_STOPWORDS)


def keywords_sql(text: str) -> str:
    return rf"array_to_string(list_filter(list_transform(regexp_split_to_array({text}, '\s+'), lambda t: regexp_replace(t, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')), lambda t: t <> '' AND (regexp_matches(t, '[0-9\-./]') OR regexp_matches(t, '^.+\p{{Lu}}') OR NOT list_contains([{_KW}], lower(t)))), ' ')"


@query("keyword_query", f"SELECT item_id, {keywords_sql('text')} AS q FROM benchmark")
def keyword_query(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.keyword_query(F.col("text")).alias("q"))


@query("named_locations", r"SELECT conv_id, turn, [turn + 1, 7] AS pages FROM conversations WHERE turn + 1 <> 7 UNION ALL SELECT conv_id, turn, [7] FROM conversations WHERE turn + 1 = 7")
def named_locations(spark, d):
    c = table(spark, d, "conversations")
    ask = F.concat(F.lit("What does Page "), (F.col("turn") + 1).cast("string"), F.lit(" say, and p. 7? pages of history, slide 0"))
    return c.select("conv_id", "turn", F.transform(T.named_locations(ask), lambda x: x.cast("long")).alias("pages"))


_SAYS = {k: " OR ".join(f"regexp_matches(q, '{p}')" for p in patterns) for k, patterns in T.EVIDENCE.items()}


@query(
    "evidence_class",
    f"""WITH c AS (SELECT conv_id, turn, lower(text || ' ' || ['', 'which year was the peak', 'list all the marks', 'the flow chart', 'a photo', 'compare the bar chart and the table'][turn % 6 + 1]) AS q FROM conversations),
k AS (SELECT *, {_SAYS["visual"]} AS v, {_SAYS["diagram"]} AS g, {_SAYS["chart"]} AS c, {_SAYS["table"]} AS t, {_SAYS["compare"]} AS m FROM c)
SELECT conv_id, turn, CASE WHEN m AND (v OR g OR c OR t) OR (CAST(v AS INT) + CAST(g AS INT) + CAST(c AS INT) + CAST(t AS INT)) > 1 THEN 'mixed' WHEN c THEN 'chart' WHEN t THEN 'table' WHEN g THEN 'diagram' WHEN v THEN 'visual' ELSE 'text' END AS evidence FROM k""",
)
def evidence_class(spark, d):
    asks = F.array(*[F.lit(x) for x in ("", "which year was the peak", "list all the marks", "the flow chart", "a photo", "compare the bar chart and the table")])
    q = F.concat_ws(" ", F.col("text"), F.element_at(asks, (F.col("turn") % 6 + 1).cast("int")))
    return table(spark, d, "conversations").select("conv_id", "turn", T.evidence_class(q).alias("evidence"))


_EVIDENCE_KINDS = ("text", "chart", "table", "diagram", "visual", "mixed")
_REGION_CASES = " ".join(f"WHEN '{k}' THEN CAST([{', '.join(repr(x) for x in v)}] AS VARCHAR[])" for k, v in T.REGIONS_FOR.items())


@query("region_types", f"SELECT item_id, CASE kind {_REGION_CASES} END AS regions FROM (SELECT item_id, ['{"', '".join(_EVIDENCE_KINDS)}'][item_id % 6 + 1] AS kind FROM benchmark)")
def region_types(spark, d):
    """Kinds of regions that the evidence of a question may stand in."""
    kind = F.element_at(F.array(*map(F.lit, _EVIDENCE_KINDS)), (F.col("item_id") % 6 + 1).cast("int"))
    return table(spark, d, "benchmark").select("item_id", T.region_types(kind).alias("regions"))


_GREETINGS = ("Hi there!", "how are you?", "Thanks!!", "bye", "who are you?", "help", "ok", "what is on page 3", "right, what does it say", "???")
_FIRST = "regexp_extract(lower(text), '[a-z]+', 0)"
_TYPED = f"""typed AS (SELECT conv_id, turn, CASE (conv_id * 7 + turn) % 8 WHEN 0 THEN regexp_replace({_FIRST}, '[aeiouy]', '', 'g') WHEN 1 THEN {_FIRST} || repeat(substr({_FIRST}, 1, 1), 4)
WHEN 2 THEN substr('qwertyuiopasdfghjkl', CAST(conv_id % 12 + 1 AS INTEGER), CAST(turn % 4 + 3 AS INTEGER)) WHEN 3 THEN {_FIRST} || conv_id % 10 || {_FIRST} WHEN 4 THEN substr(text, 1, 30)
WHEN 5 THEN [{", ".join(f"'{x}'" for x in _GREETINGS)}][conv_id % {len(_GREETINGS)} + 1] WHEN 6 THEN {_FIRST} || ' ' || regexp_replace({_FIRST}, '[aeiouy]', '', 'g') ELSE upper({_FIRST}) || conv_id % 10 END AS t FROM conversations)"""


def _noise_sql(w: str) -> str:
    bare = rf"regexp_replace(lower({w}), '[^\p{{L}}\p{{N}}]', '', 'g')"
    letters = f"regexp_replace({bare}, '[0-9]', '', 'g')"
    rows = T.KEYS.split()
    slid = " OR ".join([f"contains('{r}', {letters})" for r in rows] + [f"contains({letters}, '{r[:4]}')" for r in rows])
    held = f"len(list_filter(range(1, length({bare}) - 2), lambda i: substr({bare}, CAST(i AS INTEGER), 4) = repeat(substr({bare}, CAST(i AS INTEGER), 1), 4))) > 0"
    signs = f"{held} OR regexp_matches({bare}, '[a-z][0-9]+[a-z]') OR (length({letters}) >= 4 AND ({slid})) OR regexp_matches({letters}, '[^aeiouy]{{6,}}') OR (length({letters}) >= 5 AND NOT regexp_matches({letters}, '[aeiouy]'))"
    return rf"(regexp_matches({bare}, '^[a-z0-9]+$') AND NOT regexp_matches({w}, '[./]') AND NOT regexp_matches({w}, '^\p{{Lu}}{{2,}}[0-9]*$') AND ({signs}))"


_NORM = r"trim(regexp_replace(regexp_replace(lower(t), '[^\p{L}\p{N}\s'']', ' ', 'g'), '\s+', ' ', 'g'))"
_KINDS = " ".join(f"WHEN regexp_matches(norm, '{p.replace(chr(39), chr(39) * 2)}') THEN '{k}'" for k, p in T.SMALLTALK)
_SMALLTALK = rf"""{_TYPED}, m AS (SELECT *, {_NORM} AS norm, list_transform(string_split_regex(trim(t), '\s+'), lambda w: CASE WHEN {_noise_sql("w")} THEN 2 WHEN regexp_matches(w, '^[bcdfghjklmnpqrstvwxz]{{1,3}}$') THEN 1 ELSE 0 END) AS marks FROM typed),
mashed AS (SELECT *, trim(t) <> '' AND (NOT regexp_matches(t, '[\p{{L}}\p{{N}}]') OR (len(marks) <= 3 AND list_max(marks) = 2 AND list_min(marks) >= 1)) AS mash FROM m),
kinds AS (SELECT conv_id, turn, CASE WHEN norm = '' THEN CASE WHEN mash THEN 'unintelligible' END WHEN len(string_split(norm, ' ')) > 7 OR regexp_matches(norm, '{T.CORPUS_WORDS}') THEN NULL {_KINDS} WHEN mash THEN 'unintelligible' END AS kind FROM mashed)"""


def typed_messages(spark, d):
    """Turns as messages that people type: words without vowels, held keys, slides over the keyboard, greetings, openings of questions."""
    c, first = table(spark, d, "conversations"), F.regexp_extract(F.lower("text"), "[a-z]+", 0)
    bare = F.regexp_replace(first, "[aeiouy]", "")
    k = (F.col("conv_id") * 7 + F.col("turn")) % 8
    slide = F.substring(F.lit("qwertyuiopasdfghjkl"), (F.col("conv_id") % 12 + 1).cast("int"), (F.col("turn") % 4 + 3).cast("int"))
    digit = (F.col("conv_id") % 10).cast("string")
    picked = F.element_at(F.array(*map(F.lit, _GREETINGS)), (F.col("conv_id") % len(_GREETINGS) + 1).cast("int"))
    kinds = [bare, F.concat(first, F.repeat(F.substring(first, 1, 1), 4)), slide, F.concat(first, digit, first), F.substring("text", 1, 30), picked, F.concat_ws(" ", first, bare)]
    t = F.concat(F.upper(first), digit)
    for i, x in enumerate(kinds):
        t = F.when(k == i, x).otherwise(t)
    return c.select("conv_id", "turn", t.alias("text"))


@query("smalltalk_class", f"WITH {_SMALLTALK} SELECT conv_id, turn, kind FROM kinds")
def smalltalk_class(spark, d):
    return typed_messages(spark, d).select("conv_id", "turn", T.smalltalk_class(F.col("text")).alias("kind"))


@query("smalltalk_routing", f"WITH {_SMALLTALK} SELECT kind, count(*) AS n FROM kinds GROUP BY kind")
def smalltalk_routing(spark, d):
    """Messages by kind; those without one go on to retrieval."""
    return typed_messages(spark, d).withColumn("kind", T.smalltalk_class(F.col("text"))).groupBy("kind").agg(F.count("*").alias("n"))


@query("title_truncate", "SELECT conv_id, turn, CASE WHEN length(text) > 60 THEN rtrim(substr(text, 1, 60)) || '…' ELSE text END AS title FROM conversations")
def title_truncate(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.truncated(F.col("text"), 60).alias("title"))


@query("clock_labels", "SELECT event_id, CASE WHEN s >= 3600 THEN CAST(s // 3600 AS VARCHAR) || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') ELSE CAST(s // 60 AS VARCHAR) || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') END AS clock FROM (SELECT event_id, event_id % 9000 AS s FROM events)")
def clock_labels(spark, d):
    return table(spark, d, "events").select("event_id", T.clock(F.col("event_id") % 9000).alias("clock"))


@query("locator_labels", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'page ' || (doc_id % 9 + 1) WHEN doc_id % 4 = 1 THEN (doc_id % 60) // 60 || ':' || lpad(CAST(doc_id % 60 AS VARCHAR), 2, '0') || '–0:' || lpad(CAST(doc_id % 60 AS VARCHAR), 2, '0') WHEN doc_id % 4 = 2 THEN '§ ' || source ELSE lang END AS label FROM documents")
def locator_labels(spark, d):
    """Where a citation points: page, span of time, section, or the host."""
    k, t = F.col("doc_id") % 4, T.clock(F.col("doc_id") % 60)
    label = F.when(k == 0, F.concat(F.lit("page "), (F.col("doc_id") % 9 + 1).cast("string"))).when(k == 1, F.concat(t, F.lit("–"), t)).when(k == 2, F.concat(F.lit("§ "), F.col("source"))).otherwise(F.col("lang"))
    return table(spark, d, "documents").select("doc_id", label.alias("label"))


@query("nul_clean", "SELECT doc_id, md5(text) AS h, substr(split_part('failed: ' || source || chr(10) || 'params: 1', chr(10) || 'params:', 1), 1, 500) AS error FROM documents")
def nul_clean(spark, d):
    raw = F.concat(F.lit("failed: "), F.col("source"), F.lit("\nparams: 1"))
    return table(spark, d, "documents").select("doc_id", F.md5(T.clean_nul(F.col("text"))).alias("h"), T.error_text(raw).alias("error"))


@query("number_print", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE format('{:.4g}', v) END AS said FROM (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 4 WHEN 0 THEN l_quantity WHEN 1 THEN l_extendedprice / 8 + 1 / 64.0 WHEN 2 THEN (l_partkey + 1) / 1048576.0 ELSE -(l_discount + 1 / 3.0) END AS v FROM lineitem)")
def number_print(spark, d):
    """Quantities, prices, small shares and negative amounts as tables print them."""
    k = F.col("l_linenumber") % 4
    v = F.when(k == 0, F.col("l_quantity")).when(k == 1, F.col("l_extendedprice") / 8 + F.lit(1 / 64)).when(k == 2, (F.col("l_partkey") + 1) / F.lit(1048576.0)).otherwise(-(F.col("l_discount") + F.lit(1 / 3)))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", T.printed(v).alias("said"))


_ASKED = ("What was the market size in 2024?", "List all students of the class", "Explain the architecture", "What is in the photo?", "Compare the chart with the text", "What does the text say?")
_ASKED_KINDS = ("chart", "table", "diagram", "visual", "mixed", "text")


@query("evidence_route", f"SELECT conv_id, turn, CASE WHEN said IS NULL THEN worded WHEN said = 'text' AND worded <> 'text' THEN 'mixed' ELSE said END AS route FROM (SELECT conv_id, turn, ['{"', '".join(_ASKED_KINDS)}'][conv_id % 6 + 1] AS worded, CASE turn % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'table' WHEN 2 THEN 'diagram' END AS said FROM conversations)")
def evidence_route(spark, d):
    """What the analysis says and what the wording says, merged; a text answer against the wording searches both."""
    k = F.col("turn") % 4
    asked = F.element_at(F.array(*map(F.lit, _ASKED)), (F.col("conv_id") % 6 + 1).cast("int"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.evidence_route(F.when(k == 0, "text").when(k == 1, "table").when(k == 2, "diagram"), asked).alias("route"))


@query("number_parse", """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 4 WHEN 0 THEN l_extendedprice WHEN 1 THEN CAST(l_quantity AS INTEGER) * 1.0 WHEN 2 THEN -l_extendedprice END AS v FROM lineitem""")
def number_parse(spark, d):
    """Prices with thousands commas, shares in per cent, negative amounts between blanks, and cells that are no numbers."""
    k, price = F.col("l_linenumber") % 4, F.format_number("l_extendedprice", 2)
    word = F.element_at(F.array(*map(F.lit, ("nan", "12 pieces", "", "1.2.3", "-", "1e"))), (F.col("l_partkey") % 6 + 1).cast("int"))
    cell = F.when(k == 0, price).when(k == 1, F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("%"))).when(k == 2, F.concat(F.lit(" -"), price, F.lit(" "))).otherwise(word)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", T.number_of(cell).alias("v"))


@query("embedding_text", "SELECT doc_id, coalesce(nullif(array_to_string(list_filter([trim(substr(text, 1, doc_id % 3 * 20)), CASE WHEN doc_id % 2 = 0 THEN source END], lambda x: x IS NOT NULL AND x <> ''), ' '), ''), source || ' image ' || doc_id) AS t FROM documents")
def embedding_text(spark, d):
    text, caption = F.trim(F.substring(F.col("text"), F.lit(1), (F.col("doc_id") % 3 * 20).cast("int"))), F.when(F.col("doc_id") % 2 == 0, F.col("source"))
    joined = F.concat_ws(" ", F.nullif(text, F.lit("")), caption)
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.nullif(joined, F.lit("")), F.concat(F.col("source"), F.lit(" image "), F.col("doc_id").cast("string"))).alias("t"))


@query("mail_text", "SELECT o_orderkey, 'From: c' || o_custkey || chr(10) || 'To: desk' || CASE WHEN o_orderkey % 3 = 0 THEN chr(10) || 'Cc: boss' ELSE '' END || chr(10) || 'Subject: ' || o_orderstatus || chr(10) || chr(10) || 'body ' || o_orderkey AS text FROM orders")
def mail_text(spark, d):
    o = table(spark, d, "orders")
    cc = F.when(F.col("o_orderkey") % 3 == 0, "boss")
    body = F.concat(F.lit(" body "), F.col("o_orderkey").cast("string"))
    return o.select("o_orderkey", R.mail_text(F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.lit("desk"), cc, F.lit(None).cast("string"), F.col("o_orderstatus"), body, F.lit(None).cast("string")).alias("text"))


@query("mail_identity", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '<' || o_orderkey || '@mail>' ELSE 'uid:' || o_orderkey END AS identity, (CASE WHEN o_orderkey % 4 = 0 THEN '<' || o_orderkey || '@mail>' ELSE 'uid:' || o_orderkey END) || '#1' AS attachment FROM orders")
def mail_identity(spark, d):
    k = F.col("o_orderkey").cast("string")
    own = F.coalesce(F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("<"), k, F.lit("@mail>"))), F.concat(F.lit("uid:"), k))
    return table(spark, d, "orders").select("o_orderkey", own.alias("identity"), F.concat(own, F.lit("#1")).alias("attachment"))


_MAIL_ERRORS = ("AUTHENTICATIONFAILED Invalid credentials for ", "getaddrinfo ENOTFOUND imap.", "connect ECONNREFUSED 10.0.0.", "Socket timeout ETIMEDOUT after ", "self signed certificate of ", "mailbox is full: ")
_MAIL_KINDS = ("credentials", "host", "refused", "timeout", "certificate", "other")


@query("mail_errors", f"SELECT kind, event_type, count(*) AS n FROM (SELECT event_type, ['{"', '".join(_MAIL_KINDS)}'][event_id % 6 + 1] AS kind FROM events) GROUP BY kind, event_type")
def mail_errors(spark, d):
    """Error messages of events by kind: ordered rules, the first that fits names it."""
    e = table(spark, d, "events").select("event_type", F.concat(F.element_at(F.array(*map(F.lit, _MAIL_ERRORS)), (F.col("event_id") % 6 + 1).cast("int")), F.col("user_id").cast("string")).alias("msg"))
    m = F.lower("msg")
    kind = F.when(m.rlike("auth|credential|login"), "credentials").when(m.rlike("enotfound|getaddrinfo"), "host").when(m.rlike("econnrefused"), "refused").when(m.rlike("timeout|etimedout"), "timeout").when(m.rlike("certificate|tls|ssl"), "certificate").otherwise("other")
    return e.groupBy(kind.alias("kind"), "event_type").agg(F.count("*").alias("n"))


@query("retry_delay", "SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN user_id % 90 * 1000 WHEN 1 THEN user_id % 60 * 60000 + 2500 WHEN 2 THEN user_id % 90 * 10 END AS BIGINT) AS ms FROM events")
def retry_delay(spark, d):
    """Delays named in rate-limit messages: in seconds, in minutes and seconds, in parts of a second, or not at all."""
    k, u = F.col("event_id") % 4, F.col("user_id")
    secs, mins, parts = (u % 90).cast("string"), (u % 60).cast("string"), F.format_string("%.2f", (u % 90) / 100)
    said = F.when(k == 0, F.concat(F.lit('{"error":{"retryDelay":"'), secs, F.lit('s"}}'))).when(k == 1, F.concat(F.lit("Limit reached. Please try again in "), mins, F.lit("m2.5s."))).when(k == 2, F.concat(F.lit("try again in "), parts, F.lit("s"))).otherwise("quota exceeded")
    return table(spark, d, "events").select("event_id", T.retry_delay_ms(said).alias("ms"))


@query("search_parse", "SELECT page_id, list_filter(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1), lambda x: x LIKE '/%')[1:4] AS links FROM pages")
def search_parse(spark, d):
    """Result links of a page: the first four."""
    links = F.filter(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), F.lit(1)), lambda x: x.startswith("/"))
    return table(spark, d, "pages").select("page_id", F.slice(links, 1, 4).alias("links"))


@query("percent_format", "SELECT label, printf('%.1f%%', 100.0 * n / t) AS share FROM (SELECT label, count(*) AS n, sum(count(*)) OVER () AS t FROM embeddings GROUP BY label)")
def percent_format(spark, d):
    e = table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    return e.select("label", F.format_string("%.1f%%", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


@query("focus_window")
def focus_window(spark, d):
    """The part of each passage's best documents that its terms point at."""
    docs, b = table(spark, d, "documents"), table(spark, d, "benchmark")
    top = sparse_topk(docs, b, 3).select("item_id", "doc_id")
    terms = b.select("item_id", F.array_distinct(T.bm25_terms(F.col("text"))).alias("terms"))
    return docs.select("doc_id", "text").join(F.broadcast(top), "doc_id").join(terms, "item_id").select("doc_id", "item_id", T.focus_window(F.col("text"), F.col("terms")).alias("focus"))


_MIMES = (
    ("application/pdf", "pdf", "pdf"), ("image/png", "image", "image"), ("audio/mpeg", "audio", "audio"), ("video/mp4", "video", "video"), ("text/csv; charset=utf-8", "text", "text"), ("text/csv", "table", "text"),
    ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", "docx", "text"), ("Application/JSON", "text", "text"), ("message/rfc822", "unresolved", "text"), ("application/x-foo", "unresolved", None),
)


@query("mime_routing", "SELECT doc_id, extractor, modality FROM documents JOIN (VALUES " + ", ".join(f"({i}, '{e}', {repr(m) if m else 'NULL'})" for i, (_, e, m) in enumerate(_MIMES)) + f") t(k, extractor, modality) ON doc_id % {len(_MIMES)} = k")
def mime_routing(spark, d):
    """Documents with a type each, routed to their extractors and modalities."""
    mime = F.element_at(F.array(*(F.lit(m) for m, _, _ in _MIMES)), (F.col("doc_id") % len(_MIMES) + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", R.extractor_of(mime).alias("extractor"), R.modality_of(mime).alias("modality"))


@query("keyframes", "SELECT id, start, least(start + 30, duration) AS \"end\" FROM (SELECT event_id AS id, CAST(event_id % 200 + 0.5 AS DOUBLE) AS duration, unnest(range(0, 241, 30)) AS start FROM events) WHERE start < duration")
def keyframes(spark, d):
    m = table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 200 + F.lit(0.5)).cast("double").alias("duration"))
    return R.keyframes(m).select("id", F.col("start").cast("long").alias("start"), "end")


@query("audio_segments", "SELECT conv_id AS path, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS ordinal, 'text' AS kind, 'asr' AS source, trim(text) AS text, turn * 5.0::DOUBLE AS ts_start, turn * 5.0::DOUBLE + 4 AS ts_end FROM conversations WHERE trim(coalesce(text, '')) <> '' AND turn % 6 <> 5")
def audio_segments(spark, d):
    """Recognised speech as blocks, one a segment with its span; silent segments give none."""
    t = F.col("turn")
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("path"), (t * 5.0).alias("start"), (t * 5.0 + 4).alias("end"), F.when(t % 6 == 5, "  ").otherwise(F.col("text")).alias("text"))
    return R.segment_blocks(c)


@query("audio_pieces", "SELECT id, CAST(off // 1200 AS INTEGER) AS piece, CAST(off AS BIGINT) AS \"offset\", least(1200, duration - off) AS length FROM (SELECT event_id AS id, CAST(event_id % 5000 + 0.5 AS DOUBLE) AS duration, unnest(range(0, 6001, 1200)) AS off FROM events) WHERE off < duration")
def audio_pieces(spark, d):
    m = table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 5000 + F.lit(0.5)).cast("double").alias("duration"))
    return R.audio_pieces(m).select("id", "piece", F.col("offset").cast("long").alias("offset"), "length")


@query("empty_reason", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'No text was found in this image.' WHEN 1 THEN 'No speech was found in this audio.' WHEN 2 THEN 'The pages hold no text.' ELSE 'The file is empty.' END AS reason FROM documents")
def empty_reason(spark, d):
    m = F.element_at(F.array(*[F.lit(x) for x in ("image", "audio", "pdf", "text")]), (F.col("doc_id") % 4 + 1).cast("int"))
    reason = F.when(m == "image", "No text was found in this image.").when(m.isin("audio", "video"), F.concat(F.lit("No speech was found in this "), m, F.lit("."))).when(m == "pdf", "The pages hold no text.").otherwise("The file is empty.")
    return table(spark, d, "documents").select("doc_id", reason.alias("reason"))


@query("json_repair", "SELECT c_custkey, CASE WHEN c_custkey % 4 < 3 THEN c_nationkey END AS a, CASE WHEN c_custkey % 4 < 3 THEN c_name END AS b FROM customer")
def json_repair(spark, d):
    """Model output as JSON: code fences off, doubled colons and trailing commas mended, else null."""
    k, body = F.col("c_custkey") % 4, F.to_json(F.struct(F.col("c_nationkey").alias("a"), F.col("c_name").alias("b")))
    fenced = F.concat(F.lit("```json\n"), F.regexp_replace(body, r"\}$", ",}"), F.lit("\n```"))
    raw = F.when(k == 0, body).when(k == 1, fenced).when(k == 2, F.regexp_replace(body, '"a":', '"a"::')).otherwise(F.concat(F.lit("Sorry, nothing for "), "c_name"))
    fixed = F.regexp_replace(F.regexp_replace(F.regexp_replace("raw", r"^\s*```[a-z]*\s*|\s*```\s*$", ""), "::", ":"), r",(\s*[}\]])", "$1")
    rows = table(spark, d, "customer").select("c_custkey", raw.alias("raw"))
    return rows.select("c_custkey", F.from_json(fixed, "a int, b string").alias("j")).select("c_custkey", "j.a", "j.b")
