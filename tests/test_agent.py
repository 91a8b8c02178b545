"""Stages of the question loop: searches in one pass, grading chains, answers, frames."""

import json
import random

from pyspark.sql import functions as F

from corpusforge.operators import answer as A
from corpusforge.operators import frames as E
from corpusforge.operators import grading as G
from corpusforge.operators import multi as M
from corpusforge.operators import search as S

# ---- searches


def test_each_search_equals_one_of_its_own(spark):
    r = random.Random(1)
    words = "chunk chunks chunking index indexes page pages table tables graph merge merged merging river rivers".split()
    docs = spark.createDataFrame([(i, " ".join(r.choice(words) for _ in range(r.randint(0, 30)))) for i in range(80)], "doc_id long, text string")
    payload = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "image").otherwise("text").alias("modality"), F.when(F.col("doc_id") % 3 == 0, "chart").alias("region_type"), (F.col("doc_id") % 5).cast("int").alias("page"))
    plans = [(1, 0, "rewrite", "chunk river", [], [], 7), (1, 1, "hint", "chunk river", [], ["image"], 4), (1, 2, "region", "chunk river", [], ["chart"], 3), (1, 3, "page", "chunk river", [2], [], 5), (1, 4, "rewrite", "merging", [], [], 20), (2, 0, "rewrite", "none of these", [], [], 5)]
    df = spark.createDataFrame(plans, "item_id long, seq int, kind string, query string, pages array<int>, types array<string>, width int")
    own = S.index(docs)
    got = {}
    for x in M.multi_search(own, payload, df).orderBy("item_id", "seq", "rank").collect():
        got.setdefault((x.item_id, x.seq), []).append((x.doc_id, x.score))
    for item, seq, _, q, pages, types, width in plans:
        scores = S.sparse_scores(own, spark.createDataFrame([(item, q)], "item_id long, text string")).join(payload, "doc_id").collect()
        fit = [(x.doc_id, x.score) for x in scores if (not types or x.modality in types or x.region_type in types) and (not pages or x.page in pages)]
        assert got.get((item, seq), []) == sorted(fit, key=lambda x: (-x[1], x[0]))[:width]
    assert (2, 0) not in got and len(got[1, 0]) == 7


def test_stems_find_other_forms(spark):
    docs = spark.createDataFrame([(1, "All chunks were indexed."), (2, "Rivers."), (3, None), (4, "")], "doc_id long, text string")
    top = S.sparse_topk(docs, spark.createDataFrame([(9, "chunk indexing"), (8, "the river")], "item_id long, text string")).collect()
    assert {(x.item_id, x.doc_id) for x in top} == {(9, 1), (8, 2)}


def test_index_is_built_once_for_the_same_files(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, "one two")], "doc_id long, text string").write.parquet(path)
    first = S.index(spark.read.parquet(path))
    assert S.index(spark.read.parquet(path)) is first
    assert S.index(spark.read.parquet(path).where("doc_id > 0")) is not first
    spark.createDataFrame([(2, "three")], "doc_id long, text string").write.mode("append").parquet(path)
    assert {r.term for r in S.index(spark.read.parquet(path)).posts.collect()} == {"one", "two", "three"}


def test_shared_folders_go_when_asked(spark, tmp_path):
    import os

    from corpusforge.session import FOLDERS, drop_folders

    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, "one two")], "doc_id long, text string").write.parquet(path)
    first = S.index(spark.read.parquet(path))
    folders = list(spark.sparkContext.__dict__[FOLDERS])
    assert sum(os.path.exists(f.removeprefix("file:")) for f in folders) >= 2
    assert drop_folders(spark) == len(folders) and not any(os.path.exists(f.removeprefix("file:")) for f in folders)
    again = S.index(spark.read.parquet(path))
    assert again is not first and again.posts.count() == 2


def scanned(df):
    """Rows that the scan of a simple query hands on."""
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df.collect()
        leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
        return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))
    finally:
        df.sparkSession.conf.set("spark.sql.adaptive.enabled", "true")


def test_index_skips_row_groups_of_other_terms(spark):
    """Files hold ranges of terms, and a search for one term reads only those whose range and Bloom filter may hold it."""
    docs = spark.createDataFrame([(i, " ".join(f"word{(i * 7 + k) % 900:03d}" for k in range(0, 80, 2))) for i in range(400)], "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        posts = S.index(docs).posts
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    bounds = posts.groupBy(F.input_file_name().alias("f")).agg(F.min("term").alias("lo"), F.max("term").alias("hi")).orderBy("lo").collect()
    assert len(bounds) == 4 and all(a.hi <= b.lo for a, b in zip(bounds, bounds[1:]))
    total = posts.count()
    assert scanned(posts.where("term = 'word123'")) < total / 2
    assert scanned(posts.where("term = 'word1234'")) == 0  # between the others, but in no file


def test_dense_search_in_slices(spark, monkeypatch):
    import numpy as np

    r = np.random.default_rng(2)
    x = r.integers(-2, 3, (150, 4)).astype(float)  # many ties
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(2)
    asked = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x[:20])], "item_id long, query array<double>")
    monkeypatch.setattr(S, "QUERY_BLOCK", 7)
    monkeypatch.setattr(S, "VECTOR_BLOCK", 16)
    got = {}
    for z in S.dense_topk(vectors, asked, 9).orderBy("item_id", "rank").collect():
        got.setdefault(z.item_id, []).append((z.vec_id, z.score))
    unit = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)
    for k in range(20):
        own = [(-round(float(unit[k] @ unit[i]), 6), i) for i in range(150) if x[i].any() and x[k].any()]
        assert got.get(k, []) == [(i, -s if s else 0.0) for s, i in sorted(own)[:9]]


# ---- grading


class Planted:
    """Fails as the question says."""

    def __init__(self, name):
        self.name = name

    def grade(self, question, passages):
        plan = dict(x.split("=") for x in question.split())
        if plan.get(self.name) == "quota":
            raise G.RateLimited
        if plan.get(self.name) == "broken" and "p0" in passages:
            raise ValueError
        return [(i, p.endswith(("1", "3")), 0.9) for i, p in enumerate(passages) if p != "p5"] + [(-1, True, 1.0), (len(passages), True, 1.0)]


def test_chain_of_graders(spark):
    plans = {1: "", 2: "a=quota", 3: "a=quota b=quota", 4: "a=broken", 5: "a=quota b=broken"}
    rows = [(q, k, k + 1, plan, f"p{k}", None if q == 3 else k / 20) for q, plan in plans.items() for k in range(15)]
    c = spark.createDataFrame(rows, "item_id long, doc_id long, place int, question string, passage string, rerank_score double")
    graded = G.grade_chain(c, [("a", lambda: Planted("a")), ("b", lambda: Planted("b"))])
    got = {(r.item_id, r.doc_id): (r.relevant, r.score, r.graded_by, r.llm_failed) for r in graded.collect()}
    by_model = lambda k, name: (k in (1, 3, 11, 13), 0.9, name, False) if k != 5 else (False, None, None, False)
    by_rank = lambda k: (k / 20 >= 0.2, k / 20, "rerank", True)
    for k in range(15):
        assert got[1, k] == by_model(k, "a") and got[2, k] == by_model(k, "b")
        assert got[3, k] == (False, None, None, True)
        assert got[4, k] == (by_rank(k) if k < 12 else by_model(k, "a"))  # one batch fails alone
        assert got[5, k] == (by_rank(k) if k < 12 else by_model(k, "b"))
    state = {r.item_id: (r.n_kept, r.llm_graded, r.llm_failed, r.grade_failed) for r in G.grading_state(graded).collect()}
    assert state == {1: (4, True, False, False), 2: (4, True, False, False), 3: (0, False, True, True), 4: (9, True, True, False), 5: (9, True, True, False)}
    alone = G.grade_chain(c.where("item_id = 1"), []).collect()
    assert {(r.graded_by, r.llm_failed) for r in alone} == {("rerank", False)} and sum(r.relevant for r in alone) == 11


# ---- answers


def test_answers_quote_what_adds_most(spark):
    q = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "epsilon"), (3, "zeta"), (4, None)], "item_id long, text string")
    ev = spark.createDataFrame([(1, 1, "Alpha is here. Alpha beta gamma stand together. Nothing else."), (1, 2, "Delta alone. Alpha beta again."), (3, 1, "Nothing of it."), (2, 1, None)], "item_id long, n int, text string")
    state = spark.createDataFrame([(2, False, True, True), (3, False, True, False), (4, False, False, False)], "item_id long, llm_graded boolean, llm_failed boolean, grade_failed boolean")
    got = {r.item_id: (r.answer, r.n_sentences, r.abstained) for r in A.answers(q, ev, state).collect()}
    assert got[1] == ("Alpha beta gamma stand together. [^1] Delta alone. [^2]", 2, False)
    assert [got[i][0].split()[:2] for i in (2, 3, 4)] == [["The", "passages"], ["Only", "part"], ["The", "library"]] and all(got[i][2] for i in (2, 3, 4))
    short = A.answers(q, ev, most=1, chars=20).where("item_id = 1").first()
    assert (short.answer, short.n_sentences) == ("Alpha beta again. [^2]", 1)


# ---- frames


def chunked(r, s):
    out = []
    while s:
        n = r.randint(1, 5)
        out.append(s[:n])
        s = s[n:]
    return out


def test_frames_do_not_depend_on_the_cuts(spark):
    r = random.Random(4)
    streams = {}
    for k in range(40):
        streams[k] = "".join(r.choice(["a", "data: x", "\n", "\n\n", "\n\n\n", "bc"]) for _ in range(r.randint(1, 30)))
    for _ in range(2):
        rows = [(k, i, t) for k, s in streams.items() for i, t in enumerate(chunked(r, s))] + [(99, 0, None), (98, 0, "")]
        df = spark.createDataFrame(rows, "s int, i int, text string").repartition(3)
        got = {}
        for x in E.frames(df, ["s"], ["i"]).orderBy("s", "frame").collect():
            got.setdefault(x.s, []).append((x.content, x.is_rest))
        for k, s in streams.items():
            own = s.split("\n\n")
            assert got[k] == [(x, i == len(own) - 1) for i, x in enumerate(own)], s
        assert 99 not in got and 98 not in got


def test_deltas(spark):
    say = lambda t: "data: " + json.dumps({"choices": [{"delta": {"content": t}}]})
    whole = "\n\n".join([say("Hel"), "event: x\n" + say("lo"), ": note", "data: {oops", "data:", say(""), say(" wörld\n"), "data: [DONE]", say("gone"), "data: half"])
    r = random.Random(5)
    rows = [(1, i, t) for i, t in enumerate(chunked(r, whole))] + [(2, i, t) for i, t in enumerate(chunked(r, say("a") + "\n\n" + say("b")))]
    got = E.deltas(E.frames(spark.createDataFrame(rows, "s int, i int, text string"), ["s"], ["i"]), ["s"]).orderBy("s", "frame").collect()
    assert [(x.s, x.delta) for x in got] == [(1, "Hel"), (1, "lo"), (1, " wörld\n"), (2, "a")]
