"""Building the index: repeated ids, parts of several tasks, and one shuffle."""

import math
from collections import Counter

from corpusforge.operators import search as S

ROWS = [(i, f"alpha w{i} w{i % 7} w{i % 7}" if i % 3 else "Alpha alphas gamma") for i in range(200)] + [(1, "alpha w1 w1 beta"), (3, "alpha alpha beta"), (None, "alpha"), (None, None), (500, ""), (501, None)]


def test_repeated_ids_in_far_parts_are_one_document(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3 * S.COMMON)
    got = [(r.doc_id, r.term, r.length, r.tf) for r in S.postings(docs).collect()]
    want = Counter()
    for doc_id, text in ROWS:
        words = (text or "").lower().split()
        for w in words:
            want[doc_id, "alpha" if w == "alphas" else w, len(words)] += 1
    assert sorted(got, key=str) == sorted([(*k, n) for k, n in want.items()], key=str)


def test_idf_of_a_term_in_many_chunks(spark):
    docs = spark.createDataFrame([(i, "alpha beta" if i % 2 else "alpha") for i in range(100)], "doc_id long, text string").repartition(2 * S.COMMON)
    idf = {r.term: (r.df, round(r.idf, 9)) for r in S.index(docs).idf.collect()}
    assert idf == {t: (n, round(math.log(1 + (100 - n + 0.5) / (n + 0.5)), 9)) for t, n in (("alpha", 100), ("beta", 50))}


def test_postings_are_shuffled_once_as_lists(spark):
    docs = spark.createDataFrame([(i, f"alpha beta w{i % 5}") for i in range(100)], "doc_id long, text string")
    posts = S.postings(docs)
    posts.collect()
    plan = posts._jdf.queryExecution().executedPlan().toString()
    plan = plan[: plan.index("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan
    assert plan.count("Exchange rangepartitioning") == 1 and "Exchange hashpartitioning" not in plan and "Join" not in plan


def test_scores_shuffle_each_post_once(spark, monkeypatch):
    """Questions with the same words do not multiply what is shuffled; too many terms to send give the same scores."""
    docs = spark.createDataFrame([(i, f"alpha beta w{i % 5}") for i in range(300)], "doc_id long, text string")
    asked = spark.createDataFrame([(k, f"alpha beta w{k % 5}") for k in range(50)], "item_id long, text string")
    own = S.index(docs)
    out = S.sparse_scores(own, asked)
    got = {(r.item_id, r.doc_id): r.score for r in out.collect()}
    assert len(got) == 300 * 50
    todo, written = [out._jdf.queryExecution().executedPlan()], []
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName()
        if kind == "ShuffleExchangeExec":
            written.append(p.metrics().apply("shuffleRecordsWritten").value())
        todo += [p.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [p.plan()] if kind.endswith("QueryStageExec") else [p.children().apply(i) for i in range(p.children().size())]
    assert sum(written) <= 4 * 300
    monkeypatch.setattr(S, "SENT_TERMS", 0)
    assert {(r.item_id, r.doc_id): r.score for r in S.sparse_scores(own, asked).collect()} == got
