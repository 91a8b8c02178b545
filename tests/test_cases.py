"""Hand-computed cases of the engine's operators."""

import pytest
from pyspark.sql import functions as F

from corpusforge.functions import text as T
from corpusforge.functions import vectors as V
from corpusforge.operators import chunks as C
from corpusforge.operators import cite, evaluate, geometry, search, tabular
from corpusforge.operators.loop import agentic
from corpusforge.operators.search import numbered
from corpusforge.sources import readers


def one(spark, expr, **cols):
    row = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in cols.items())) if cols else spark.range(1)
    return row.select(expr.alias("x")).first().x


def ranked(spark, ids):
    return spark.createDataFrame([(1, x, i + 1) for i, x in enumerate(ids)], "q int, id string, rank int")


def test_rrf_prefers_both_lists(spark):
    rows = search.rrf(ranked(spark, "abc"), ranked(spark, "cad"), ["q"], "id").orderBy("position").collect()
    assert rows[0].id == "a" and {r.id for r in rows} == set("abcd")
    assert [r.dense_rank for r in rows if r.id == "d"] == [None]


def test_rrf_weights_and_symmetry(spark):
    d, s = ranked(spark, ["semantic", "x", "y", "exact"]), ranked(spark, ["exact", "z"])
    plain = {r.id: r.score for r in search.rrf(d, s, ["q"], "id").collect()}
    heavy = {r.id: r.score for r in search.rrf(d, s, ["q"], "id", (1.0, 3.0)).collect()}
    assert max(plain, key=plain.get) == max(heavy, key=heavy.get) == "exact"
    assert heavy["exact"] - heavy["semantic"] > plain["exact"] - plain["semantic"]
    assert {r.id: r.score for r in search.rrf(s, d, ["q"], "id").collect()} == plain


def test_rerank_prune(spark):
    f = lambda scores, **kw: [r.id for r in search.rerank_prune(spark.createDataFrame([(1, i, s) for i, s in enumerate(scores, 1)], "q int, id int, rerank_score double"), ["q"], "id", **kw).orderBy("rank").collect()]
    assert f([0.1, 0.9, 0.005, 0.6], top_k=2, keep=0) == [2, 4]
    assert f([0.004, 0.001, 0.0099, 0.002], keep=2) == [3, 1]


GATE = [
    ([("rerank", 0.99, 0.99), ("rerank", 0.26, 0.26)], "answer"), ([("llm", 0.95, 0.999)], "answer"), ([("llm", 0.95, 0.1)], "retry"), ([("rerank", 0.9996, 0.9996)], "answer"), ([("rerank", 0.8, 0.8)], "retry"), ([("llm", 0.7, None)], "retry"),
]


@pytest.mark.parametrize("rows,want", GATE)
def test_gate(spark, rows, want):
    ev = spark.createDataFrame([(1, by, s, r, False, False, False, False) for by, s, r in rows], "item_id int, graded_by string, score double, rerank_score double, from_image boolean, external boolean, pinned boolean, scoped boolean")
    assert search.sufficiency(ev).first().decision == want


def test_gate_pinned_image_and_last_round(spark):
    schema = "item_id int, graded_by string, score double, rerank_score double, from_image boolean, external boolean, pinned boolean, scoped boolean"
    f = lambda row, **kw: search.sufficiency(spark.createDataFrame([(1, *row)], schema), **kw).first().decision
    assert f(("llm", 0.7, None, False, False, True, False)) == "answer"
    assert f(("llm", 0.95, 0.02, True, False, False, False)) == "answer"
    assert f(("llm", 0.1, None, False, False, False, False), iteration=3) == "web"
    assert f(("llm", 0.1, None, False, False, False, False), iteration=3, web_enabled=False) == "abstain"


def test_confidence(spark):
    ev = spark.createDataFrame([(1, 1, "llm", 0.9), (1, 2, "llm", 0.6), (1, 3, "rerank", 0.3), (1, 4, "rerank", 0.1)], "item_id int, doc_id int, graded_by string, score double")
    r = search.confidence(ev).first()
    assert (r.mean_top3, r.top_score, r.n_relevant, r.basis) == (0.6, 0.9, 4, "mixed")


KEYWORDS = {"What is the role of the generator in RAG?": "generator RAG", "What is TB-2048?": "TB-2048", "What does section 3.2 say about equation 4.1?": "section 3.2 equation 4.1", "Who is the author of 2005.11401v4.pdf?": "author 2005.11401v4.pdf"}


@pytest.mark.parametrize("text,want", KEYWORDS.items())
def test_keyword_query(spark, text, want):
    assert one(spark, T.keyword_query(F.col("t")), t=text) == want


@pytest.mark.parametrize("text,want", [("What does slide 3 say?", [3]), ("Summarise page 12 and p. 4", [12, 4]), ("pages of history", [])])
def test_named_locations(spark, text, want):
    assert one(spark, T.named_locations(F.col("t")), t=text) == want


@pytest.mark.parametrize("text,want", [("Hiii!!", "greeting"), ("how are you", "how_are_you"), ("ok", "acknowledgement"), ("right, what does the handbook say", None), ("what is on page 3", None), ("asdf", "unintelligible"), ("???", "unintelligible"), ("bm25", None), ("OCR", None), ("x7q2z", "unintelligible"), ("x7q2z budget", None), ("minutes.2019v4.pdf", None), ("sdfgh", "unintelligible"), ("xkcdrtbb", "unintelligible")])
def test_smalltalk(spark, text, want):
    assert one(spark, T.smalltalk_class(F.col("t")), t=text) == want


@pytest.mark.parametrize("text,want", [("What does the text say?", "text"), ("What was the market size in 2024?", "chart"), ("List all students", "table"), ("Explain the architecture", "diagram"), ("What is in the photo?", "visual"), ("Compare the chart with the table", "mixed")])
def test_evidence(spark, text, want):
    assert one(spark, T.evidence_class(F.col("t")), t=text) == want


def test_sentences(spark):
    assert len(one(spark, T.split_sentences(F.col("t")), t="See Fig. 3 for detail. The result holds. Next section follows.")) == 3
    assert one(spark, T.headings(F.col("t")), t="# Intro\nText.\n## Method 2.1\nMore.") == ["Intro", "Method 2.1"]


def test_markers(spark):
    assert one(spark, T.normalise_markers(F.col("t")), t="[^¹²] and [³]") == "[^12] and [^3]"
    got = one(spark, T.answer_sentences(F.col("t")), t="Section 3.2 defines RAG.[^1] The generator writes the answer [^2]. Done.")
    assert len(got) == 3 and "[^1]" in got[0]


def test_strip_unsupported(spark):
    a = spark.createDataFrame([(1, "First claim stands. The second one fails [^2]. The last is kept [^1].")], "id int, text string")
    r = cite.strip_unsupported(a, spark.createDataFrame([(1, 2)], "id int, marker int"), ["id"]).first()
    assert r.dropped == 1 and "[^1]" in r.text and "second" not in r.text


def test_html(spark):
    html = "<html><head><title>RAG</title></head><body><nav>menu</nav><h2>Process[edit]</h2><table><tr><td>Aanya</td><td>91</td></tr></table></body></html>"
    out = one(spark, T.html_to_text(F.col("t")), t=html)
    assert out.startswith("# RAG") and "## Process" in out and "Aanya | 91 |" in out and "menu" not in out and "edit" not in out


def test_fold_and_loop_give_the_same_chunks(spark):
    text = " ".join(f"Sentence number {i} of this text says little more than that." for i in range(60)) + "\n# Heading\n" + " ".join(f"After it comes {i}." for i in range(90))
    docs = spark.createDataFrame([(1, text), (2, "  short  "), (3, text.replace("Sentence", "S"))], "doc_id long, text string")
    loop = {(r.doc_id, r.ordinal): (r.text, r.start, r.stop) for r in C.chunks(docs).collect()}
    fold = docs.select("doc_id", F.posexplode(C.pack(F.col("text"))).alias("ordinal", "c")).collect()
    assert len(fold) == len(loop) > 6 and all(loop[r.doc_id, r.ordinal] == tuple(r.c) for r in fold)
    assert loop[2, 0] == ("short", 0, 9)
    assert sorted(k for d, k in loop if d == 1) == list(range(sum(d == 1 for d, _ in loop)))


def test_numbering_over_ranges(spark):
    rows = spark.range(0, 5000, numPartitions=7).select((F.col("id") * 7919 % 5000).alias("x"), (F.col("id") % 3).alias("y"))
    got = numbered(rows, [F.desc("y"), F.asc("x")]).orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, 5001))
    assert [(r.y, r.x) for r in got] == sorted([(r.y, r.x) for r in got], key=lambda t: (-t[0], t[1]))
    assert numbered(rows.limit(0), [F.asc("x")]).count() == 0


def test_loop_keeps_evidence_and_looks_past_it(spark):
    """Two passages are enough, one counts once over all rounds; readings of images and web rows come on top of what is kept."""
    docs = spark.createDataFrame([(1, "amber brass cedar delta elm"), (2, "amber brass"), (3, "fir"), (4, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "amber brass cedar delta elm fir gum holly ivy juniper"), (2, "zinc"), (3, None)], "item_id long, text string")
    got = {r.item_id: (r.decision, r.iteration, r.n_evidence) for r in agentic(asked, docs).collect()}
    assert got == {1: ("answer", 1, 2), 2: ("abstain", 3, 0), 3: ("abstain", 3, 0)}
    one = {r.item_id: (r.decision, r.iteration, r.n_evidence) for r in agentic(asked, docs.where("doc_id = 1")).collect()}
    assert one[1] == ("abstain", 3, 1)
    found = spark.createDataFrame([(1, -1, 0.6), (2, -1, 0.9)], "item_id long, doc_id long, score double")
    looked = {r.item_id: (r.decision, r.n_evidence) for r in agentic(asked, docs.where("doc_id = 1"), images=found).collect()}
    assert looked == {1: ("answer", 2), 2: ("answer", 1), 3: ("abstain", 0)}
    web = spark.createDataFrame([(2, -1, 0.5), (2, -2, 0.5), (3, -1, 0.5)], "item_id long, doc_id long, score double")
    went = {r.item_id: (r.decision, r.n_evidence) for r in agentic(asked, docs.where("doc_id = 1"), web=web).collect()}
    assert went == {1: ("abstain", 1), 2: ("answer", 2), 3: ("abstain", 1)}


def test_ranking_metrics(spark):
    res = spark.createDataFrame([(1, "a", 1, True), (1, "b", 2, False), (1, "c", 3, True), (1, "d", 4, False)], "item_id int, doc_id string, rank int, relevant boolean")
    n = spark.createDataFrame([(1, 2), (2, 1)], "item_id int, n_labels int")
    r = {x.item_id: x for x in evaluate.ranking_metrics(res, n, (1, 4, 9)).collect()}
    assert (r[1].precision_1, r[1].precision_4, r[1].precision_9, r[1].recall_4, r[1].rr) == (1.0, 0.5, 0.5, 1.0, 1.0)
    assert (r[2].precision_4, r[2].hit_4, r[2].rr) == (0.0, 0, 0.0)


def test_table_statistics(spark):
    t = spark.createDataFrame([("Aanya", 8, 91), ("Nandini", 6, 84), ("Rahul", 3, 52), ("Karan", 2, 41)], "Student string, Hours int, Score int")
    r = tabular.statistics(t, "Student", ["Score"]).first()
    assert (r.mean, r["sum"], r.max, r.max_label, r.min, r.min_label) == (67.0, 268.0, 91.0, "Aanya", 41.0, "Karan")
    assert {x.name for x in tabular.numeric_columns(t).where("numeric").collect()} == {"Hours", "Score"}
    rows = spark.createDataFrame([(f"S{i}", i) for i in range(45)], "s string, i int").withColumn("g", F.lit(1))
    got = tabular.slices(rows, ["g"], "i", ["s", "i"]).orderBy("slice").collect()
    assert len(got) == 3 and got[-1].label == "rows 41–45"


def test_vectors(spark):
    a = F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, V.norm(a)) == 5.0 and one(spark, V.cosine(a, a)) == pytest.approx(1.0)
    assert one(spark, V.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) is None


def test_pca_separates(spark):
    v = spark.createDataFrame([(i, [float(i), 0.1 * (i % 2), 0.0]) for i in range(40)], "vec_id long, embedding array<float>")
    df, share = geometry.pca(v, 2)
    assert share[0] > 0.99 and df.count() == 40


def test_dataset_reader(spark, tmp_path):
    good = '// note\n\n{"id": "a", "question": "q?", "relevantDocuments": ["x.pdf"]}\n{"id": "b", "question": "r?", "unanswerable": true}\n'
    (tmp_path / "d.jsonl").write_text(good)
    assert readers.read_dataset(spark, str(tmp_path / "d.jsonl")).count() == 2
    for bad in ("", good + '{"id": "a", "question": "q?", "relevantDocuments": ["x"]}\n', '{"id": "c", "question": "q?"}\n', "{nonsense}\n"):
        (tmp_path / "bad.jsonl").write_text(bad)
        with pytest.raises(ValueError):
            readers.read_dataset(spark, str(tmp_path / "bad.jsonl"))


def test_delimited_reader(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a;b\n1;2\n3;4\n")
    assert readers.read_delimited(spark, str(tmp_path / "t.csv")).columns == ["a", "b"]
    (tmp_path / "w.txt").write_text("one\ntwo")
    assert readers.read_text(spark, str(tmp_path / "w.txt")).first().text == "one\ntwo"


@pytest.mark.parametrize("x,want", [(3.0, "3"), (-12.0, "-12"), (0.0, "0"), (1234.5, "1234"), (12345.678, "1.235e+04"), (0.5, "0.5"), (0.00012345, "0.0001234"), (0.000012345, "1.234e-05"), (99999.5, "1e+05"), (9.9996, "10"), (123.456, "123.5"), (-0.25, "-0.25"), (2.50001, "2.5")])
def test_printed_numbers(spark, x, want):
    got = spark.createDataFrame([(x,)], "x double").select(T.printed(F.col("x")).alias("s")).first().s
    assert got == want or abs(float(got) - float(want)) <= abs(x) * 1e-3 and len(got) == len(want)


def test_decoded_boxes(spark):
    rows = [([100, 200, 300, 400], True), ([100, 200, 300, 400], False), ([300, 0, 100, 10], False), ([1, 2, 3], True), (None, True), ([-50, 0, 2000, 500], False), ([0, None, 1, 1], False)]
    got = [r.b and tuple(r.b) for r in spark.createDataFrame(rows, "raw array<int>, f boolean").select(geometry.decoded_box(F.col("raw"), F.col("f")).alias("b")).collect()]
    assert got == [(0.2, 0.1, 0.4, 0.3), (0.1, 0.2, 0.3, 0.4), None, None, None, (0.0, 0.0, 1.0, 0.5), None]


def test_evidence_route(spark):
    q, said = "What was the market size in 2024?", [None, "text", "table"]
    got = [r.k for r in spark.createDataFrame([(s,) for s in said], "s string").select(T.evidence_route(F.col("s"), F.lit(q)).alias("k")).collect()]
    assert got == ["chart", "mixed", "table"]


def test_printed_halves_go_to_the_even_digit(spark):
    cases = {2.0**-6: "0.01562", 3 * 2.0**-6: "0.04688", 5 * 2.0**-6: "0.07812", 2.0**-7: "0.007812", -(2.0**-6): "-0.01562", 1234.5: "1234", 1235.5: "1236", 0.10005: "0.1001", 1.0005: "1", 1e-5: "1e-05", 1e300: None, None: None}
    rows = spark.createDataFrame([(x,) for x in cases], "x double").select("x", T.printed(F.col("x")).alias("s")).collect()
    assert {r.x: r.s for r in rows} == cases | {1e300: f"{1e300:.4g}"}
