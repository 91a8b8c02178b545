"""Operators for training corpora against brute force, round trips and held-out labels."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusforge.llm import bloom, bpe, common, decontaminate, hnsw, html_extract, minhash, quality, secret_scan, substring, suffix, toxicity
from corpusforge.llm.common import shared_dir
from corpusforge.llm.labelled import Sample

sha = lambda b: hashlib.sha256(b).hexdigest()
WORD = re.compile(r"[^\x20\x09-\x0D]+")
lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def unite(ids, links):
    root = {i: i for i in ids}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


# ---- 1


def page(body, head="<title>t</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


PAGES = [
    (1, "http://a.org/1", page("<nav>Home</nav><article><h1>Title &amp; more</h1><p>One <b>b</b>old<br>two</p><aside>side</aside></article><footer>foot</footer>"), "Title & more One bold two"),
    (2, "http://a.org/2", None, ""),
    (3, None, "", ""),
    (4, "http://a.org/4", page('<div class="cookie-notice">Accept</div><main><p>x &lt; y</p><div id="comments"><p>First!</p></div><form>f</form></main>'), "x < y"),
    (5, "http://b.org/5", page("<article><p>unclosed <script>var a='</p>';</script><!-- gone --> text"), "unclosed text"),
    (6, "http://b.org/6", page("<article>A \n  b&nbsp;c</article>"), "A b c"),
    (6, "http://b.org/6", page("<article>A \n  b&nbsp;c</article>"), "A b c"),
]


def test_html(spark):
    df = spark.createDataFrame([(i, u, h, "x") for i, u, h, _ in PAGES], "page_id long, url string, html string, text string")
    got = html_extract.extract(df).collect()
    assert Counter((r.page_id, r.text, r.n_chars) for r in got) == Counter((i, t, len(t)) for i, _, _, t in PAGES)
    assert html_extract.extract(df.where("page_id < 0")).count() == 0


@pytest.mark.parametrize("body,want", [
    ('<article>A<section class="share-prices"><p>Share prices rose.</p></section><div class="comment-free">Main para</div></article>', "A Share prices rose. Main para"),
    ('<article><p>x</p><p class="advert">buy</p><p class="cookie-notice">ok<p>y</p><div hidden>z</div><div style="display: none">q</div></article>', "x y"),
    ("<article>a <math><mi>x</mi></math> b<svg><text>label</text></svg></article>", "a x b label"),
    ('<div class="topnav">Home News</div><p>own words</p>', "own words"),
    ('<article><ul><li class="ad">buy<li>kept</ul><span class="promo">go</span> on</article>', "kept on"),
    ("<article>" + "long text " * 200_000 + "</article>", ("long text " * 200_000).strip()),
])
def test_html_markup(body, want):
    """Class names by whole tokens, paragraphs and hidden elements, formulas, a menu on one page only, open items, a very long page."""
    assert html_extract.judge([html_extract.blocks_of(page(body))]) == [want]


def plain_main(pages_):
    """Open words of pages without content that stand in no six words of another page's open or furniture words."""
    streams = [" ".join(t for kind, t in own if kind != html_extract.CONTENT).split() for own in pages_]
    grams = [{tuple(w[i : i + 6]) for i in range(len(w) - 5)} for w in streams]
    out = []
    for p, own in enumerate(pages_):
        others, w = set().union(*(g for k, g in enumerate(grams) if k != p)), streams[p]
        gone = {j for i in range(len(w) - 5) if tuple(w[i : i + 6]) in others for j in range(i, i + 6)}
        if any(kind == html_extract.CONTENT for kind, _ in own):
            out.append(" ".join(t for kind, t in own if kind == html_extract.CONTENT))
        else:
            kinds = [kind for kind, t in own for _ in t.split()]
            out.append(" ".join(x for j, x in enumerate(w) if j not in gone and kinds[j] == html_extract.OPEN))
    return out


def test_html_by_brute_force(spark):
    """Hosts with templates, pairs of blocks and articles, as the whole operator against plain sets of words."""
    r = random.Random(12)
    lines = [" ".join(f"w{r.randrange(30)}" for _ in range(r.randint(3, 14))) for _ in range(60)]
    rows = []
    for i in range(60):
        body = "".join(r.choice(["<p>{}</p>", "<div>{}</div>", "<nav>{}</nav>"]).format(r.choice(lines)) for _ in range(6))
        rows.append((i, f"http://h{i % 3}.org/{i}", page(f"<article>{r.choice(lines)}</article>{body}" if i % 10 == 0 else body)))
    got = {x.page_id: x.text for x in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for host in range(3):
        own = [x for x in rows if x[0] % 3 == host]
        assert [got[i] for i, *_ in own] == plain_main([html_extract.blocks_of(h) for *_, h in own])


def test_html_host_template_goes_from_pages_without_article(spark):
    template = "<div>Welcome to our little site about nothing at all</div>"
    rows = [(i, f"http://h.org/{i}", page(f"{template}<p>{i} own words of page {i * 7}</p>")) for i in range(5)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"{i} own words of page {i * 7}" for i in range(5)}


def test_html_shards_do_not_change_texts(spark):
    """Blocks on two pages of a host, a template, furniture repeated as open text, and a notice, over pages dealt to many shards."""
    r = random.Random(9)
    prose = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    pairs, notice, menu = [prose(9) for _ in range(20)], prose(12), prose(10)
    rows = []
    for i in range(40):
        body = f"<div>{pairs[i % 20]}</div><p>{prose(8)} own é {i}</p>" + (f"<p>{notice}</p>" if i % 9 == 0 else "")
        rows.append((i, f"http://h.org/{i}", page(body)))
    rows += [(40, "http://h.org/a", page(f"<nav>{menu}</nav><article>text</article>")), (41, "http://h.org/b", page(f"<p>{menu}</p>")), (42, "http://other.org/b", page(f"<p>{pairs[0]}</p>")), (43, "http://h.org/c", None), (44, "http://h.org/d", page("<p>few words</p>"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    one, many = ({x.page_id: x.text for x in html_extract.extract(df, shard=n).collect()} for n in (256, 2))
    assert one == many and one[41] == "" and one[42] == pairs[0]
    assert not any(p in one[i] for i in range(40) for p in [*pairs, notice])


def test_html_of_large_hosts_is_read_twice_by_one_pool_of_workers(spark, monkeypatch):
    """One worker a task reads pages and hashes their runs, once for all fingerprints; a list of rows would start a second pool of Python workers beside it."""
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *_: pytest.fail("rows of a list"))
    df = spark.range(12).selectExpr("id as page_id", "concat('http://h.org/', id) as url", "concat('<body><p>one line that stands on every page</p><p>', id, ' own words of page ', 7 * id, '</p></body>') as html")
    spark.conf.unset(common.BATCH_CONF)
    got = html_extract.extract(df, shard=3)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == common.SMALL_BATCH_BYTES
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2
    assert {r.page_id: r.text for r in got.collect()} == {i: f"{i} own words of page {i * 7}" for i in range(12)}


def test_repeated_runs_by_brute_force():
    r = np.random.default_rng(2)
    tokens, owner = r.integers(0, 3, 400), np.repeat(np.arange(8), 50)
    want = np.zeros(400, bool)
    seen = defaultdict(set)
    for i in range(395):
        if owner[i] == owner[i + 5]:
            seen[tuple(tokens[i : i + 6])].add(owner[i])
    for i in range(395):
        if owner[i] == owner[i + 5] and len(seen[tuple(tokens[i : i + 6])]) > 1:
            want[i : i + 6] = True
    assert (html_extract.repeated(tokens, owner, 6) == want).all()


# ---- 2


def test_forest_on_held_out_findings():
    own = secret_scan.labelled_findings(3000, seed=1)
    forest = secret_scan.train(own, trees=15)
    rest = secret_scan.labelled_findings(1500, seed=2)
    s = forest.score(np.array([secret_scan.features(a, v, z) for a, v, z, _ in rest]))
    assert np.mean((s >= 0.5) == np.array([y for *_, y in rest])) > 0.97


def test_secret_scan_and_redact(spark, docs, empty):
    secret = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    rows = [(1, f'é before token = "{secret}" after'), (2, "plain prose with nothing in it"), (3, None), (4, ""), (5, f"commit {secret}"), (6, f'A token = "{secret}" B token = "{secret[::-1]}"'), (7, "mail 92@mail6.example.com and 4122859641637651")]
    df = spark.createDataFrame([(*r, 1, 0.1) for r in rows], "doc_id long, text string, n_chars long, score double")
    found = [(r.doc_id, r.start) for r in secret_scan.scan(df).where("is_secret").collect()]
    assert sorted(found) == [(1, len('é before token = "'.encode())), (6, 11), (6, 64)]
    out = {r.doc_id: (r.text, r.n_chars, r.score) for r in secret_scan.redact(df).collect()}
    assert out[1] == ('é before token = "[SECRET]" after', 33, 0.1) and out[6][0] == 'A token = "[SECRET]" B token = "[SECRET]"'
    assert out[3][0] is None and out[5][0] == f"commit {secret}"
    assert secret_scan.scan(empty).count() == 0 and secret_scan.redact(empty).count() == 0
    assert secret_scan.redact(docs).count() == docs.count()


KEY = "q7Zr2LkX9vTb4NwJ8mHs5PdY1cGf6RaE3uVo0WiB"


def candidates_of(text):
    import pyarrow as pa

    from corpusforge.llm.common import chunks_of

    return [bytes(c.raw[s:e]).decode() for c in chunks_of(pa.array([text])) for s, e in zip(*(x.tolist() for x in secret_scan.candidates(c)), strict=True)]


def test_secrets_in_long_runs(spark):
    r = random.Random(5)
    blob = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(6000))
    long = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(5000))
    rows = [(1, f"{blob}==token={KEY} end", KEY), (2, "-" * 5000 + f"token={KEY}", KEY), (3, "=" * 5000 + f"password={KEY} x", KEY), (4, "anduntilthe" * 500 + f"_token={KEY}", KEY), (5, f'api_key = "{long}"', long), (6, f"token={KEY}==", f"{KEY}==")]
    assert all(value in candidates_of(t) for _, t, value in rows)
    df = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    found = {(x.doc_id, x.value_sha256) for x in secret_scan.scan(df).where("is_secret").collect()}
    assert found >= {(i, sha(v.encode())) for i, _, v in rows}
    assert not any(v in x.text for x, (_, _, v) in zip(secret_scan.redact(df).orderBy("doc_id").collect(), rows, strict=True))


def test_named_secrets_without_digits_or_short(spark):
    values = ["AbCdQwErTyUiOpLkJhGf", "correcthorsebatterystaple", "qWeRtYuIoPaSdFgHjKlZxCvB", "Tr0ub4dor", "xK9mQ2vL"]
    rows = list(enumerate([f"token = {values[0]} x", f"password={values[1]}", f"Authorization: Bearer {values[2]} x", f'password = "{values[3]}"', f"db_password={values[4]}", "the token economy and a secret ingredient, password required"]))
    found = {(x.doc_id, x.value_sha256) for x in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).where("is_secret").collect()}
    assert found == {(i, sha(v.encode())) for i, v in enumerate(values)}
    assert candidates_of("a token") == [] and "ordinary" not in str(candidates_of("ordinary words here"))


def test_held_out_findings_are_candidates():
    rest = [x for x in secret_scan.labelled_findings(1500, seed=2) if x[3]]
    kept = [v.decode().rstrip(".-~") in candidates_of((a + v + z).decode()) for a, v, z, _ in rest]
    assert np.mean(kept) > 0.995


def test_long_values_are_judged_whole(monkeypatch):
    import pyarrow as pa

    from corpusforge.llm.common import chunks_of

    seen, own = [], secret_scan.features
    monkeypatch.setattr(secret_scan, "features", lambda a, v, z: seen.append(len(v)) or own(a, v, z))
    for c in chunks_of(pa.array(['token = "' + KEY * 50 + '"'])):
        secret_scan.findings_of(c, secret_scan.Forest([]))
    assert seen == [40 * 50]


# ---- 3


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return path, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_matches_library(docs, texts, empty, library):
    path, enc = library
    want = Counter()
    for i, t in texts:
        ids = enc.encode_ordinary(t or "")
        want[(i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode()))] += 1
    assert Counter(map(tuple, bpe.digests(docs, path).collect())) == want
    assert bpe.digests(empty, path).count() == 0
    coded = bpe.encode(docs, path)
    back = {r.doc_id: bytes(r.text) for r in bpe.decode(coded, path).collect()}
    assert back == {i: (t or "").encode() for i, t in texts}
    assert bpe.encoded(docs, path).where("not round_trip").count() == 0
    vocab = bpe.codec(path)
    for r in coded.join(docs.select("doc_id", "text"), "doc_id").collect():
        raw, at = (r.text or "").encode(), [*r.starts, len((r.text or "").encode())]
        assert len(r.starts) == len(r.ids)
        assert all(raw[a:b] == vocab.decode(np.array([i])) for i, a, b in zip(r.ids, at[:-1], at[1:], strict=True))


def test_bpe_text_beyond_a_chunk(spark, library):
    """A text of 3 MB between small ones: one text is one chunk, whatever its size."""
    path, enc = library
    rows = [(1, "short"), (2, "A longer text, größer als 1 MB; it's 漢字 too. " * 60_000), (3, None), (4, "after")]
    got = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in bpe.digests(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), path).collect()}
    assert got == {i: (len(enc.encode_ordinary(t or "")), sha((t or "").encode())) for i, t in rows}


def test_bpe_random_strings(library):
    import pyarrow as pa

    from corpusforge.llm.common import chunks_of

    path, enc = library
    own, r = bpe.codec(path), random.Random(8)
    alphabet = [" ", "  ", "\n", "'", "'s", "'re", "'ll", "'l", "'ve", "e", "l", "Z", "é", "1", "²", "!", " ", "\x1c", "漢", "🙂", "'d", "t"]
    strings = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 25))) for _ in range(4000)] + ["a" * 700, "'" * 300, "ab" * 90 + " " * 50]
    for c in chunks_of(pa.array(strings), 5000):
        ids, n = own.encode(c)
        at = np.concatenate([[0], np.cumsum(n)])
        for k in range(c.n):
            assert ids[at[k] : at[k + 1]].tolist() == enc.encode_ordinary(strings[c.rows.start + k])


# ---- 4


def plain_windows(texts, window=20):
    first = {}
    gone = {}
    for i, t in sorted(texts, key=lambda x: x[0]):
        w = WORD.findall(t or "")
        mark = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first.setdefault(tuple(w[k : k + window]), (i, k)) < (i, k):
                mark[k : k + window] = [True] * window
        gone[i] = (i, len(w), sum(mark), sha(" ".join(x for x, m in zip(w, mark, strict=True) if not m).encode()))
    return gone


def test_substring_dedup(docs, texts, empty):
    got = {r.doc_id: tuple(r) for r in substring.deduplicate(docs).drop("kept").collect()}
    assert got == plain_windows(texts)
    assert sum(r[2] for r in got.values()) > 1000
    assert substring.deduplicate(empty).count() == 0


def test_fingerprint_index_grows_and_compacts(spark, docs, texts):
    index = substring.FingerprintIndex(spark, shared_dir(spark))
    cuts = sorted(i for i, _ in texts)
    found = None
    for lo, hi in zip([0, *cuts[15::15]], [*cuts[15::15], 10**9], strict=True):
        part = docs.where((F.col("doc_id") >= lo) & (F.col("doc_id") < hi))
        again = index.append(substring.fingerprints(part, None))
        found = again if found is None else found.unionByName(again)
        if len(index.runs) > 2:
            index.compact()
    assert len(index.runs) <= 2
    got = {r.doc_id: tuple(r) for r in substring.remove(docs, found, shared_dir(spark)).drop("kept").collect()}
    assert got == plain_windows(texts)


def test_fingerprint_index_opens_again(spark, docs, texts):
    """A batch added after the index was opened anew gives what one pass gives; history is not shuffled; a batch given twice is found in its own documents."""
    folder, cut = shared_dir(spark), sorted(i for i, _ in texts)[30]
    first = substring.FingerprintIndex.open(spark, folder)
    old = first.append(substring.fingerprints(docs.where(F.col("doc_id") < cut), None))
    first.close()
    again = substring.FingerprintIndex.open(spark, folder)
    assert again.runs == ["run-1"] and again.made == 1
    plan = again._table("run-1").groupBy("h", "v").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    new = again.append(substring.fingerprints(docs.where(F.col("doc_id") >= cut), None))
    got = {r.doc_id: tuple(r) for r in substring.remove(docs, old.unionByName(new), shared_dir(spark)).drop("kept").collect()}
    assert got == plain_windows(texts)
    assert again.append(substring.fingerprints(docs.where(F.col("doc_id") < cut), None)).exceptAll(old).count() == 0
    again.compact()
    assert len(again.runs) == 1 and substring.FingerprintIndex.open(spark, folder).runs == again.runs
    again.close()


# ---- 5


def plain_hits(texts, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wins = defaultdict(set)
    for item, t in items:
        w = word.findall(lower(t))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wins[tuple(w[k : k + window])].add(item)
    out, df = [], Counter(x for _, t in texts for x in set(word.findall(lower(t))))
    for i, t in texts:
        w = word.findall(lower(t))
        mark, names = [False] * len(w), set()
        for size in {len(x) for x in wins}:
            for k in range(len(w) - size + 1):
                if (hit := wins.get(tuple(w[k : k + size]))) is not None:
                    names |= hit
                    mark[k : k + size] = [True] * size
        names = sorted(map(str, names))
        out.append((i, len(w), sum(mark), len(names), sha(",".join(names).encode()), any(mark), plain_near_items(w, df, items)))
    return Counter(out)


def plain_near_items(words, df, items, rarest=3, within=10):
    """Items whose rarest words, by rows of texts that hold them (df) and then by spelling, stand together in words."""
    word, found = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), set()
    for item, t in items:
        terms = set(word.findall(lower(t)))
        pick = sorted((x for x in terms if df[x]), key=lambda x: (df[x], x.encode()))[:rarest]
        if pick and len(pick) >= min(rarest, len(terms)) and any(x == pick[0] and set(pick) <= set(words[max(0, k - within) : k + within + 1]) for k, x in enumerate(words)):
            found.add(item)
    return len(found)


def items_of(texts):
    own = dict(texts)
    ids = [i for i, t in texts if t and len(t.split()) > 40]
    return [(1, " ".join(own[ids[2]].split()[3:20])), (2, "one two"), (3, None), (4, ""), (5, own[ids[4]].upper()), (12, "no such words anywhere at all"), (1, "one")]


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_decontamination(spark, docs, texts, empty, block):
    items = items_of(texts)
    bench = spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, doc_id string")
    got = decontaminate.report(decontaminate.matches(docs, bench, block_bytes=block))
    want = plain_hits(texts, items)
    assert Counter(map(tuple, got.collect())) == want
    assert {r.doc_id for r in decontaminate.clean(docs, bench, block_bytes=block).collect()} == {x[0] for x in want if not x[5]}
    none = bench.where("item_id < 0")
    assert decontaminate.report(decontaminate.matches(docs, none)).where("contaminated").count() == 0
    assert decontaminate.report(decontaminate.matches(empty, bench)).count() == 0


def test_decontamination_answers_every_row_with_many_blocks(spark):
    """Repeated rows, and rows without an id of equal length, one of them contaminated; blocks of 200 bytes."""
    long, other = (" ".join(f"{x}{i}" for i in range(60)) for x in "wv")
    texts = [(1, long), (1, long), (None, long), (None, other), (None, None), (None, ""), (3, None), (7, other)]
    items = [(1, long), (2, "one two three"), (3, "no such words anywhere")]
    d, b = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 200):
        assert Counter(map(tuple, decontaminate.report(decontaminate.matches(d, b, block_bytes=block)).collect())) == plain_hits(texts, items)


def test_proximity(spark):
    d = spark.createDataFrame([(1, "alpha x beta y gamma"), (2, "alpha " + "x " * 30 + "beta gamma"), (3, None)], "doc_id long, text string")
    b = spark.createDataFrame([(9, "gamma beta alpha")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.proximity(d, b, 3, 5).collect()] == [(1, 9)]


def test_proximity_does_not_depend_on_neighbours(spark):
    """The item's three rarest terms of the table are side by side in one document; its other terms stand in other partitions, or nowhere."""
    texts = [(1, "alpha x beta y gamma"), *((i, "common usual words") for i in range(2, 12))]
    b = spark.createDataFrame([(9, "gamma common beta usual alpha"), (8, "gamma beta alpha nowhere")], "item_id long, text string")
    d = spark.createDataFrame(texts, "doc_id long, text string")
    for parts in (1, 11):
        assert sorted(map(tuple, decontaminate.proximity(d.repartitionByRange(parts, "doc_id"), b, 3, 5).collect())) == [(1, 8, 1), (1, 9, 1)]


# ---- 6


def plain_bytes(texts, size=200):
    count = Counter()
    for _, t in texts:
        b = (t or "").encode()
        count.update(b[k : k + size] for k in range(len(b) - size + 1))
    out = []
    for i, t in texts:
        b = (t or "").encode()
        mark = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if count[b[k : k + size]] > 1:
                mark[k : k + size] = b"\1" * size
        runs = len(re.findall(rb"\x01+", bytes(mark)))
        out.append((i, len(b), sum(mark), runs, sha(bytes(x for x, m in zip(b, mark, strict=True) if not m))))
    return Counter(out)


@pytest.mark.parametrize("hot", [suffix.HOT, 3])
def test_suffix_dedup(docs, texts, empty, hot):
    got = suffix.deduplicate(docs, hot).drop("kept").collect()
    assert Counter(map(tuple, got)) == plain_bytes(texts)
    assert suffix.deduplicate(empty).count() == 0


def test_suffix_sort_orders_as_bytes_do():
    r = np.random.default_rng(6)
    x = r.integers(97, 99, (300, suffix.WIDE)).astype(np.uint8)
    x[100:200] = x[:100]
    x[150:200, -1] += 1
    s = suffix.Suffixes(x, suffix.prefix_rows(x), np.arange(300) % 3)
    keys = [(int(s.group[i]), x[i, suffix.LEFT :].tobytes()) for i in s.sort()]
    assert keys == sorted(keys)


# ---- 7 and 10


def labelled(kind, n=260, seed=3):
    r = random.Random(seed)
    stems = ["th", "er", "on", "ing", "re", "at", "ou", "es"]
    text = lambda: " ".join("".join(r.choice(stems) for _ in range(r.randint(1, 4))) for _ in range(r.randint(40, 120)))
    rows = []
    for i in range(n):
        t, bad = text(), r.random() < 0.25
        if bad and kind == "quality":
            t = r.choice([lambda: t.upper().replace(" ", "!! "), lambda: t.replace(" ", "%%% "), lambda: " ".join(w for w in t.split() for _ in range(8)), lambda: t.replace(" ", " | ")])()
        elif bad:
            words = t.split()
            for _ in range(4):
                words[r.randrange(len(words))] = r.choice(["idiot", "scum", "vekru" + r.choice(stems), "losti" + r.choice(stems)])
            t = " ".join(words)
        rows.append((i, t, int(bad) if kind == "toxic" else int(not bad)))
    return rows


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_classifiers_on_held_out_rows(spark, kind):
    rows = labelled(kind)
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (902, "word " * 20000)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, y, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    out = quality.score(df, quality.train(quality.sample(df, lab, "quality"))) if kind == "quality" else toxicity.score(df, toxicity.fit(df, lab))
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(rows) + 3 and all(0 <= r.score <= 1 for r in got.values())
    import zlib

    own = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i].predicted == y for i, y in own]) > 0.93
    if kind == "toxic":
        clean = {r.doc_id for r in toxicity.reject(df, toxicity.fit(df, lab)).collect()}
        assert clean == {i for i, r in got.items() if not r.predicted}


def test_toxicity_of_long_texts(spark):
    """An insult at one word in 40 is as toxic in 24,000 or 100,000 words as in 1,200; clean texts of any length stay clean."""
    rows = labelled("toxic")
    clean = " ".join(t for _, t, y in rows if not y).split()
    plant = lambda n: " ".join("idiot" if i % 40 == 7 else w for i, w in zip(range(n), clean * (n // len(clean) + 1), strict=False))
    sizes = [1_200, 24_000, 100_000]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000 + n, plant(n)) for n in sizes] + [(500_000, " ".join(clean[:5000]) + " "), (500_001, " ".join(clean[:5000] * 20))], "doc_id long, text string")
    lab = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(df, toxicity.fit(df, lab)).where("doc_id >= 1000").collect()}
    scores = [got[1000 + n].score for n in sizes]
    assert all(got[1000 + n].predicted for n in sizes) and max(scores) - min(scores) < 0.1, scores
    assert not got[500_000].predicted and not got[500_001].predicted


def test_labels_of_held_out_rows_are_not_learned(spark):
    rows = labelled("toxic")
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    lab = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    turned = lab.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.fit(df, x) for x in (lab, turned))
    assert all((x == y).all() if isinstance(x, np.ndarray) else x == y for x, y in zip(a, b, strict=True))


def test_classifiers_without_labels(spark, docs):
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score(docs, quality.train(quality.sample(docs, lab, "quality"))).count() == docs.count()
    assert toxicity.score(docs, toxicity.fit(docs, lab)).count() == docs.count()
    assert toxicity.train(Sample([], [], 0.0))[0].size > 0


# ---- 8


def shingles(t, k):
    w = WORD.findall(lower(t))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def plain_near(texts, k, percent):
    sets = {i: shingles(t, k) for i, t in texts}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = unite(ids, links)
    return {i: (i, len(sets[i]), root[i], root[i] == i) for i in ids}


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_minhash(docs, texts, empty, k, percent):
    got = {r.doc_id: tuple(r) for r in minhash.near_duplicates(docs, k, percent).collect()}
    assert got == plain_near(texts, k, percent)
    assert minhash.near_duplicates(empty, k, percent).count() == 0


def test_minhash_shuffles_documents_and_keys_of_several(spark, docs, monkeypatch):
    """Representatives are told before their keys are listed, keys of one document alone stay out of the join, few rows make few files, and batches are small."""
    plans, keep, folders = {}, minhash.stored, []
    monkeypatch.setattr(minhash, "stored", lambda df, folder, name, **k: folders.append(folder) or plans.update({name: df._jdf.queryExecution().optimizedPlan().toString()}) or keep(df, folder, name, **k))
    spark.conf.unset(common.BATCH_CONF)
    minhash.near_duplicates(docs)
    assert plans["keys"].index("Generate") < plans["keys"].index("Join")
    assert "MapInArrow" in plans["shared"]
    assert all(len(spark.read.parquet(f"{folders[0]}/{x}").inputFiles()) == 1 for x in ("common-keys", "links"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == common.SMALL_BATCH_BYTES


def test_minhash_loses_no_link_to_the_star(spark, monkeypatch):
    """Copies near the threshold: many miss the centre and link with each other only."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    r = random.Random(11)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(r.randint(1, 7)):
            words[r.randrange(len(words))] = f"n{r.randrange(40)}"
        rows.append((i, " ".join(words)))
    got = {x.doc_id: tuple(x) for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == plain_near(rows, 3, 85)


def test_minhash_large_groups(spark, docs, texts, monkeypatch):
    """Classes, hubs and groups that count as large are dealt another way and give the same; so do more large groups than all tasks are told."""
    want = plain_near(texts, 3, 85)
    for limit in (100_000, 0):
        monkeypatch.setattr(minhash, "FAN", 1)
        monkeypatch.setattr(minhash, "BLOCK", 4)
        monkeypatch.setattr(minhash, "LARGE_GROUPS", limit)
        monkeypatch.setattr(common, "LARGE_GROUPS", limit)
        assert {r.doc_id: tuple(r) for r in minhash.near_duplicates(docs, 3, 85).collect()} == want


def test_wide_bitmap(spark, monkeypatch):
    """Merged by pieces on the executors, a bitmap is the same."""
    h = spark.range(0, 5000, 1, 7).select(F.xxhash64("id").alias("h"))
    one = bloom.build(h)
    monkeypatch.setattr(bloom, "WIDE_BITS", 8)
    assert (bloom.build(h) == one).all() and one.any()


def test_without(spark, docs):
    ids = docs.select("doc_id").where("doc_id % 3 = 0")
    assert {r.doc_id for r in minhash.without(docs, ids).collect()} == {r.doc_id for r in docs.where("doc_id % 3 <> 0").collect()}


# ---- 9


def vectors():
    r = np.random.default_rng(5)
    out = []
    for c in range(6):
        centre = r.normal(size=16)
        out += [((centre + r.normal(size=16) * 0.12 * (k % 4)).tolist(), c % 3) for k in range(40)]
    out += [(r.normal(size=16).tolist(), 1) for _ in range(60)]
    out += [(out[0][0], 0)] * 5 + [(out[0][0], None), (None, 1), ([0.0] * 16, 1), ([float("nan")] * 16, 1), ([None] * 16, 1), ([], 1), (out[0][0], 2), ([1.0, 0.0], 1), ([2.0, 0.0], 1)]
    return [(1000 - 3 * i, v, label) for i, (v, label) in enumerate(out)]


@pytest.mark.parametrize("shard", [hnsw.SHARD, 50])
def test_vectors_against_brute_force(spark, shard):
    rows = vectors()
    df = spark.createDataFrame([(*x, "e") for x in rows], "vec_id long, embedding array<float>, label int, x string")
    got = {r.vec_id: tuple(r) for r in hnsw.near_duplicates(df, shard=shard).collect()}
    unit = {}
    for i, v, label in rows:
        a = np.array([np.nan if z is None else z for z in v or []], np.float32).astype(float)
        if label is not None and len(a) and np.isfinite(a).all() and a.any():
            unit[i] = (label, a / np.sqrt(a @ a))
    links = [(i, j) for i in unit for j in unit if i < j and unit[i][0] == unit[j][0] and len(unit[i][1]) == len(unit[j][1]) and unit[i][1] @ unit[j][1] >= 0.93]
    n = Counter(x for p in links for x in p)
    root = unite(sorted(i for i, *_ in rows), links)
    wrong = [i for i, *_ in rows if got[i] != (i, n[i], root[i], root[i] == i)]
    assert len(got) == len(rows) and len(wrong) <= 0.02 * len(rows), wrong
    assert hnsw.near_duplicates(df.where("vec_id < -1000000")).count() == 0


def test_vectors_in_double_precision(spark):
    """A pair whose cosine is under the threshold by less than single precision can tell."""
    c = 0.93 - 1e-9
    rows = [(1, [1.0, 0.0], 1), (2, [c, float(np.sqrt(1 - c * c))], 1), (3, [0.0, 1.0], 2), (4, [float(np.sqrt(1 - 0.9301**2)), 0.9301], 2), (None, [1.0, 0.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (0, 1, True), 2: (0, 2, True), 3: (1, 3, True), 4: (1, 3, False), None: (0, None, True)}


def test_audit_sees_rare_links():
    """Two linked pairs among 3,000 vectors: the audit goes on until it holds them, and every pair is found."""
    r = np.random.default_rng(4)
    x = hnsw.unit(r.normal(size=(3000, 32)))
    x[2000], x[2500] = hnsw.unit(x[[10, 20]] + 0.02 * r.normal(size=(2, 32)))
    pick, true = hnsw.audited(x, x, np.arange(3000), 0.93)
    assert len(pick) == 3000 and true.sum() == 4
    pick, true = hnsw.audited(x, x, np.arange(3000), -1.0)
    assert len(pick) == hnsw.AUDIT and true.sum() == hnsw.AUDIT * 2999


def test_graph_recall():
    r = np.random.default_rng(1)
    x = hnsw.unit(r.normal(size=(3000, 24)))
    graph = hnsw.Hnsw(x)
    _, ids = graph.search(x[:200].astype(np.float32), 48)
    best = np.argsort(-(x[:200] @ x.T), axis=1)[:, :5]
    found = graph.order[ids]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(best.tolist(), found.tolist(), strict=True)]) > 0.9


# ---- rows without ids


def test_null_ids(spark, library):
    path, _ = library
    long = " ".join(f"w{i}" for i in range(60))
    d = spark.createDataFrame([(1, long, 1), (None, long, 2), (3, None, None), (None, None, 3), (1, long, 1), (9, long[:-1], 1)], "doc_id long, text string, n_chars long")
    lab = spark.createDataFrame([(1, 1, 0), (None, 1, 1), (3, None, None), (9, 0, 1)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, long), (None, "a"), (2, None)], "item_id long, text string")
    for out in (bpe.digests(d, path), bpe.encoded(d, path), decontaminate.report(decontaminate.matches(d, items)), substring.deduplicate(d), suffix.deduplicate(d), quality.score(d, quality.train(quality.sample(d, lab, "quality"))), minhash.near_duplicates(d), toxicity.score(d, toxicity.fit(d, lab))):
        assert sorted(r.doc_id or 0 for r in out.collect()) == [0, 0, 1, 1, 3, 9]
    assert {(r.doc_id, r.n_removed) for r in suffix.deduplicate(d).collect()} == {(1, len(long)), (None, len(long)), (None, 0), (3, 0), (9, len(long) - 1)}
    assert {(r.doc_id, r.n_removed) for r in substring.deduplicate(d).collect()} == {(1, 0), (None, 0), (3, 0), (9, 59)}
    assert minhash.without(d, d.select("doc_id").where("doc_id = 1 or doc_id is null")).count() == 4
    assert secret_scan.scan(d).count() == 0 and secret_scan.redact(d).count() == 6 and decontaminate.clean(d, items).count() == 2
