"""Main text of web pages: element structure, and a suffix array over each host's token streams.

Method.  A page is read into blocks.  Markup decides most of them: scripts, styles, menus,
headers, footers, sidebars, notices, adverts, forms and reader comments are furniture; what
stands inside an article (or main) element is content.  Everything else (all of a page without
such an element) is open.  Open and furniture blocks of a host's pages form one token stream;
its suffix array, by prefix doubling to full depth, and the common prefixes of neighbours from
distinct pages give the longest repeated run at every token; open tokens covered by runs of RUN
tokens or more are boilerplate, the unique runs are kept.  Content is never judged by repetition,
since articles quote and copy each other.

A class, id or role marks furniture by whole tokens: all parts of one (at hyphens, underscores and
capitals) have to be names of furniture or neutral ones, so "cookieNotice", "site-header" and
"reader-comments" do and "share-prices" and "comment-free" do not.  Names of lists of links (menu,
breadcrumbs, pager) mark furniture inside an article only if half of the element's text is links:
a menu may be one of dishes.  On headings there, words that may be a text's own subject (notice,
search, comment) mark nothing.  Hidden elements are furniture.  A header element inside an article
is a header, headline included, but a class that calls something the header of an article or post
marks nothing; text outside the article of a page that has one is not main text.

A host with many pages is dealt to shards of about SHARD pages, each with a suffix array of its
own.  Fingerprints of all runs of such a host are counted over its shards (one row a fingerprint
and task before the shuffle, and one for each shard whose undecided pages hold it), and a shard
gets back those of its undecided pages' runs that stand in two shards; so a host's pages have the
same text whatever the shards.  The html is read into blocks twice: for the fingerprints, hashed
in the same worker, and for the texts.

Cases: null and empty html give an empty text; broken or unclosed markup is read as far as it
goes; repeated rows and pages without a url (one host of their own) are ordinary; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SMALL_BATCH_BYTES, chunks_of, column, covered, ints, read, ship, signed, window_hash, word_hashes, words_of
from .labelled import local

RUN = 6
SHARD = 256
PAGES = 128  # pages that a task holds as blocks at a time
HEAVY_HOSTS = 100_000  # host counts sent to all tasks at most; beyond it they are joined
CONTENT, FURNITURE, OPEN = 0, 1, 2
_BLANK = np.zeros(256, bool)
_BLANK[0x20] = True

_RAW = r"script|style|noscript|template|iframe|textarea|select|title|canvas|audio|video"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*?(?:/>|>.*?(?:</(?P=raw)\s*>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=\s|/|$|=)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*(?:display\s*:\s*none|visibility\s*:\s*hidden)""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_FURNITURE = frozenset("nav header footer aside form head button dialog menu".split())
_MAIN = frozenset(("article", "main"))
_CHROME = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle adslot banner sponsor sponsored promo promos promotion promoted cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup paywall sidebar widget widgets related recommended recommendations share sharing sharebar sharethis addthis addtoany social menu nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments commentlist commentform reply replies respond disqus login signin search pagination pager toolbar contentinfo complementary topnav sidenav subnav bottomnav taboola outbrain".split()
)
#: Names of lists of links.
_LISTS = frozenset("menu nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar topnav sidenav subnav bottomnav".split())
#: Names that may be a heading's own subject.
_SUBJECTS = frozenset("notice notices alert search comment comments reply replies banner share sharing social related header menu widget promotion promotions subscription".split())
#: Parts of a class name that say where something stands, not what it is.
_NEUTRAL = frozenset(
    "site page main top bottom left right global user social primary secondary wrapper container box block bar list section area inner outer item items link links module panel slot unit row col text content body article articles post posts story stories entry blog news reader readers thread threads card cards label labels button buttons icon icons legal group holder strip feed tools title heading count meta form field".split()
)
_HEADER_OF = frozenset("article post story entry blog news section title heading card".split())
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_CAPITAL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
YES, LINKS, NO = 2, 1, 0


def _chrome(attrs: str, heading: bool = False) -> int:
    """YES: names of furniture or hidden; LINKS: only names of lists of links."""
    out = NO
    for _, value in _ATTR.findall(attrs):
        for token in value.strip("\"'").split():
            parts = [x for x in re.split(r"[-_]+|[0-9]+", _CAPITAL.sub("-", token).lower()) if x]
            found = {x for x in parts if x in _CHROME}
            if not found or any(x not in _CHROME and x not in _NEUTRAL for x in parts):
                continue
            if found <= {"header", "masthead"} and _HEADER_OF.intersection(parts) or heading and found <= _SUBJECTS:
                continue
            out = max(out, LINKS if found <= _LISTS else YES)
    return YES if _HIDDEN.search(attrs) else out


def blocks_of(page: str | None) -> list[tuple[int, str]]:
    """(kind, text) of every block with text, in page order; white space is one space."""
    out: list[tuple[int, str, int]] = []
    stack: list[tuple[str, bool, bool, int]] = []  # tag, furniture, inside content, number of the list of links around (0: none)
    size, linked = [0], [0]  # characters of each such list, and those in links
    text: list[str] = []
    page = page or ""
    at = anchors = 0
    outside = ("", False, False, 0)

    def flush() -> None:
        if text:
            words = html.unescape("".join(text)).split()
            text.clear()
            if words:
                _, furniture, content, around = stack[-1] if stack else outside
                out.append((FURNITURE if furniture else CONTENT if content else OPEN, " ".join(words), around))

    def put(piece: str) -> None:
        text.append(piece)
        if stack and stack[-1][3]:
            n = len("".join(piece.split()))
            size[stack[-1][3]] += n
            linked[stack[-1][3]] += n if anchors else 0

    def drop(k: int) -> None:
        nonlocal anchors
        anchors -= sum(x[0] == "a" for x in stack[k:])
        del stack[k:]

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            put(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in _INLINE:
            flush()
        if tag in _VOID:
            continue
        if m["close"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if stack[k][1:] != (stack[k - 1] if k else outside)[1:]:
                        flush()
                    drop(k)
                    break
        elif not m["attrs"].endswith("/"):
            if tag not in _INLINE:  # a block ends an open paragraph, an item the one before
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p" or stack[k][0] == tag == "li":
                        drop(k)
                        break
                    if stack[k][0] not in _INLINE:
                        break
            _, furniture, content, around = stack[-1] if stack else outside
            named = _chrome(m["attrs"], content and tag in _HEADINGS) if m["attrs"] and tag not in ("html", "body", "article", "main") else NO
            chrome = tag in _FURNITURE or named == YES or named == LINKS and not content
            if named == LINKS and content and not around and not chrome:
                size.append(0)
                linked.append(0)
                around = len(size) - 1
            if tag in _INLINE and (chrome and not furniture or around != (stack[-1] if stack else outside)[3]):
                flush()
            stack.append((tag, furniture or chrome, content or tag in _MAIN, around))
            anchors += tag == "a"
    if at < len(page):
        put(page[at:])
    flush()
    menus = {k for k in range(1, len(size)) if 2 * linked[k] >= size[k]}
    return [(FURNITURE if around in menus else kind, words) for kind, words, around in out]


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, and the rank of every place by its first 1, 2, 4, ... tokens (prefix doubling until all differ)."""
    ranks, width = [np.unique(tokens, return_inverse=True)[1].astype(np.int64)], 1
    while width < len(tokens) and ranks[-1].max(initial=0) + 1 < len(tokens):
        after = np.full(len(tokens), -1, np.int64)
        after[: len(tokens) - width] = ranks[-1][width:]
        ranks.append(np.unique(ranks[-1] * (len(tokens) + 1) + after + 1, return_inverse=True)[1].astype(np.int64))
        width *= 2
    return np.argsort(ranks[-1], kind="stable"), ranks


def common_prefix(a: np.ndarray, b: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Tokens that the suffixes a and b begin with alike: doubled widths, the widest first."""
    out, n = np.zeros(len(a), np.int64), len(ranks[0])
    for k in range(len(ranks) - 1, -1, -1):
        x, y = a + out, b + out
        ok = (x < n) & (y < n)
        ok[ok] = ranks[k][x[ok]] == ranks[k][y[ok]]
        out[ok] += 1 << k
    return out


def repeated(tokens: np.ndarray, page: np.ndarray, run: int = RUN) -> np.ndarray:
    """Marks tokens covered by a run of `run` tokens or more that stands on two distinct pages."""
    if len(tokens) < run:
        return np.zeros(len(tokens), bool)
    edge = np.flatnonzero(page[1:] != page[:-1]) + 1
    wide = np.insert(tokens.astype(np.int64), edge, -1 - np.arange(len(edge)))  # a token of its own ends each page
    owner = np.insert(page.astype(np.int64), edge, -1)
    order, ranks = suffix_array(wide)
    order = order[owner[order] >= 0]
    own, longest = owner[order], np.zeros(len(wide), np.int64)
    for way in (1, -1):  # the nearest neighbour of another page, before and after
        o, p = order[::way], own[::way]
        first = np.concatenate([[0], np.flatnonzero(p[1:] != p[:-1]) + 1])
        mate = np.repeat(first - 1, np.diff(np.append(first, len(p))))
        i = np.flatnonzero(mate >= 0)
        longest[o[i]] = np.maximum(longest[o[i]], common_prefix(o[i], o[mate[i]], ranks))
    at = np.flatnonzero(longest >= run)
    return covered(at, longest[at], len(wide))[owner >= 0]


def fingerprints(pages: list[list[tuple[int, str]]], run: int = RUN) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hash, page and first token (counted over all pages) of every run of the open and furniture blocks of each page, by chunks."""
    base = 0
    for c in chunks_of(pa.array([" ".join(text for kind, text in own if kind != CONTENT) for own in pages], pa.string())):
        start, end, n = words_of(c, _BLANK)
        h = window_hash(word_hashes(c, start, end), run)
        owner = np.repeat(np.arange(c.rows.start, c.rows.start + c.n), n)
        at = np.flatnonzero(owner[: len(h)] == owner[run - 1 :][: len(h)])
        yield signed(h[at]), owner[at], base + at
        base += len(owner)


def judge(pages: list[list[tuple[int, str]]], run: int = RUN, shared: np.ndarray | None = None) -> list[str]:
    """Main text of each of a host's pages; shared: sorted fingerprints of runs that other shards hold too."""
    ids: dict[str, int] = {}
    tokens, owner, where = [], [], []
    for p, own in enumerate(pages):
        for k, (kind, text) in enumerate(own):
            if kind != CONTENT:
                words = text.split(" ")
                tokens += [ids.setdefault(w, len(ids)) for w in words]
                owner += [p] * len(words)
                where.append((p, k, len(words)))
    cover = repeated(np.array(tokens, np.int64), np.array(owner, np.int64), run)
    if shared is not None and len(shared):
        at = np.concatenate([first[np.isin(h, shared)] for h, _, first in fingerprints(pages, run)])
        cover |= covered(at, np.full(len(at), run), len(cover))
    left: dict[tuple[int, int], str] = {}
    at = 0
    for p, k, n in where:
        kind, text = pages[p][k]
        if kind == OPEN:
            left[p, k] = " ".join(w for w, gone in zip(text.split(" "), cover[at : at + n].tolist(), strict=True) if not gone)
        at += n
    out = []
    for p, own in enumerate(pages):
        has_main = any(kind == CONTENT for kind, _ in own)
        parts = [text if kind == CONTENT else "" if has_main or kind == FURNITURE else left[p, k] for k, (kind, text) in enumerate(own)]
        out.append(" ".join(x for x in parts if x))
    return out


def extract(pages: DataFrame, run: int = RUN, shard: int = SHARD) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""
    spark = pages.sparkSession
    ship(spark, SMALL_BATCH_BYTES)
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    own = pages.select("page_id", "url", "html", host.alias("host"))
    heavy = own.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") > shard)
    salt = F.xxhash64("page_id", "url")
    some = heavy.limit(HEAVY_HOSTS + 1).collect()
    if len(some) <= HEAVY_HOSTS:
        small = local(spark, host=(pa.string(), [r.host for r in some]), n=(pa.int64(), [r.n for r in some]))
        own = own.join(F.broadcast(small), "host", "left")
    else:
        own = own.join(heavy, "host", "left")
    own = own.withColumn("shard", F.pmod(salt, F.coalesce(F.ceil(F.col("n") / shard), F.lit(1)).cast("long")))
    kinds, ids = "page_id long, url string, host string, shard long, kinds binary, texts array<string>", pages.schema["page_id"].dataType

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, PAGES):
                part = b.slice(k, PAGES)
                got = [blocks_of(x) for x in column(part, "html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [column(part, "page_id"), column(part, "url"), column(part, "host"), column(part, "shard"), pa.array([bytes(kind for kind, _ in x) for x in got], pa.binary()), pa.array([[t for _, t in x] for x in got], pa.list_(pa.string()))],
                    ["page_id", "url", "host", "shard", "kinds", "texts"],
                )

    def blocks(b: pa.RecordBatch | pa.Table) -> list[list[tuple[int, str]]]:
        return [list(zip(k, x, strict=True)) for k, x in zip(b.column("kinds").to_pylist(), b.column("texts").to_pylist(), strict=True)]

    def decide(t: pa.Table, shared: np.ndarray | None = None) -> pa.Table:
        text = judge(blocks(t), run, shared)
        return pa.table({"page_id": t.column("page_id"), "url": t.column("url"), "text": pa.array(text, pa.string()), "n_chars": pa.array([len(x) for x in text], pa.int64())})

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """host, shard, fingerprint, whether a page that needs it holds it: distinct rows of some pages."""
        for b in (b.slice(k, PAGES) for b in batches for k in range(0, b.num_rows, PAGES)):
            pages_, hosts = [blocks_of(x) for x in column(b, "html").to_pylist()], column(b, "host").dictionary_encode()
            shards, codes = ints(b, "shard"), hosts.indices.to_numpy()
            needs = np.array([all(kind != CONTENT for kind, _ in own) and any(kind == OPEN for kind, _ in own) for own in pages_], bool)
            for h, page, _ in fingerprints(pages_, run):
                got = np.unique(np.stack([codes[page].astype(np.int64), shards[page], h, needs[page].astype(np.int64)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([hosts.dictionary.take(pa.array(got[:, 0])), pa.array(got[:, 1]), pa.array(got[:, 2]), pa.array(got[:, 3] == 1)], ["host", "shard", "run", "needed"])

    id_kind = ids.simpleString()
    kinds, done = kinds.replace("page_id long", f"page_id {id_kind}"), f"page_id {id_kind}, url string, text string, n_chars long"
    split = own.select("page_id", "url", "html", "host", "shard").mapInArrow(parse, kinds)
    if not some:
        return split.groupBy("host", "shard").applyInArrow(lambda t: decide(t), done)
    found = own.where(F.col("n").isNotNull()).select("html", "host", "shard").mapInArrow(runs, "host string, shard long, run long, needed boolean")
    found = found.groupBy("host", "run", F.when(F.col("needed"), F.col("shard")).alias("for")).agg(F.min("shard").alias("least"), F.max("shard").alias("most"))
    of_run = Window.partitionBy("host", "run")
    met = found.select("host", "run", F.col("for").alias("shard"), F.min("least").over(of_run).alias("least"), F.max("most").over(of_run).alias("most"))
    shared = met.where("shard is not null and least < most").select("host", "shard", "run")
    return split.groupBy("host", "shard").cogroup(shared.groupBy("host", "shard")).applyInArrow(lambda t, known: decide(t, np.sort(known.column("run").to_numpy())), done)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
