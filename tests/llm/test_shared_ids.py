"""Rows that share a doc_id but not a text, and rows without one: no row may get another's result."""

import random
from collections import Counter

import pytest

from corpusforge.llm import bpe, decontaminate, minhash, quality, secret_scan, sentence_piece, substring, suffix, toxicity

from .test_llm import WORD, plain_bytes, sha

words = lambda r, n: " ".join(f"{r.choice('bdfgklmnprst')}{r.choice('aeiou')}{r.randrange(40)}" for _ in range(n))


def plain_words(rows, window=20):
    """Rows (doc_id, text): a window goes if a smaller doc_id has it, or the same text earlier."""
    least = {}
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - window + 1):
            if i is not None:
                g = tuple(w[k : k + window])
                least[g] = min(i, least.get(g, i))
    out = []
    for i, w in split:
        mark, own = [False] * len(w), set()
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            if g in own or (i is not None and least[g] < i):
                mark[k : k + window] = [True] * window
            own.add(g)
        out.append((i, len(w), sum(mark), sha(" ".join(x for x, m in zip(w, mark) if not m).encode())))
    return Counter(out)


def probes():
    r = random.Random(7)
    sixty = words(r, 60)
    yield [(3, sixty), (1, words(r, 30)), (3, words(r, 100) + " " + sixty), (2, sixty)]
    repeat = words(r, 120)
    yield [(1, f"{repeat} middle {repeat}"), (1, "short")]
    passages = [words(r, 45) for _ in range(6)]
    rows = []
    for _ in range(60):
        t = " ".join([words(r, r.randint(0, 30)), *(r.choice(passages) for _ in range(r.randint(0, 2))), words(r, 5)])
        rows += [(r.choice([None, 1, 2, 3, 4, 5, 900]), t)] * r.choice([1, 1, 2])
    yield rows


@pytest.mark.parametrize("rows", list(probes()))
@pytest.mark.parametrize("parts", [1, 5])
def test_spans_stay_with_their_row(spark, rows, parts):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    assert Counter(map(tuple, substring.deduplicate(df).drop("kept").collect())) == plain_words(rows)
    for hot in (suffix.HOT, 2):
        assert Counter(map(tuple, suffix.deduplicate(df, hot).drop("kept").collect())) == plain_bytes(rows)


def test_later_texts_of_an_id_meet_earlier_runs(spark):
    """Two texts of one id in one chunk, and the passage in an earlier batch of the index."""
    r = random.Random(3)
    passage = words(r, 30)
    rows = [(1, passage), (2, f"{passage} {words(r, 9)}"), (2, f"{words(r, 9)} {passage}"), *((k, words(r, 25)) for k in range(3, 12))]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert Counter(map(tuple, substring.deduplicate(df, batches=6).drop("kept").collect())) == plain_words(rows)


def test_operators_by_row(spark):
    """What operators say of a text does not depend on another text of its id."""
    import public_tokenizers

    r = random.Random(5)
    rows = [(1, words(r, 40)), (1, words(r, 80)), (1, None), (None, words(r, 50)), (None, ""), (2, words(r, 30)), (2, 'token = "hJ3kL9xPq2Zw8VbN4tRs"')]
    alone = [(k, t) for k, (_, t) in enumerate(rows)]
    schema = "doc_id long, text string"
    d, e = spark.createDataFrame(rows, schema).repartition(3), spark.createDataFrame(alone, schema)
    lab = spark.createDataFrame([(i, k % 2, k % 3 == 0) for k, i in enumerate([1, 2, 3, 4, 5])], "doc_id long, quality int, toxic boolean").selectExpr("doc_id", "quality", "cast(toxic as int) as toxic")
    items = spark.createDataFrame([(7, rows[1][1][:200]), (8, rows[3][1])], "item_id long, text string")
    good, bad = quality.train(quality.sample(d, lab, "quality")), toxicity.fit(d, lab)
    vocab, model = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")
    runs = {
        "bpe": lambda x: bpe.digests(x, vocab), "pieces": lambda x: sentence_piece.digests(x, model), "decontamination": lambda x: decontaminate.report(decontaminate.matches(x, items)),
        "quality": lambda x: quality.score(x, good).select("doc_id", "score"), "toxicity": lambda x: toxicity.score(x, bad).select("doc_id", "score"), "redacted": lambda x: secret_scan.redact(x).select("doc_id", "text"),
    }
    for name, run in runs.items():
        plain = lambda x: tuple(round(v, 9) if isinstance(v, float) else v for v in tuple(x)[1:])
        got = Counter((x.doc_id, *plain(x)) for x in run(d).collect())
        assert got == Counter((rows[x.doc_id][0], *plain(x)) for x in run(e).collect()), name


def test_near_duplicates_of_shared_ids(spark):
    """Rows of one id are one document there: linked if any of their texts is."""
    r = random.Random(9)
    a, b = words(r, 60), words(r, 60)
    d = spark.createDataFrame([(5, a), (3, b), (5, b), (9, a), (None, a)], "doc_id long, text string")
    got = {(x.doc_id, x.component_id) for x in minhash.near_duplicates(d).collect()}
    assert got == {(5, 3), (3, 3), (9, 3), (None, None)}


def test_vectors_of_any_magnitude(spark):
    """Squares of finite components may overflow or vanish; the cosine does not."""
    from corpusforge.llm import hnsw

    rows = [(k, [s, s * 1.01], 1) for k, s in enumerate([1e200, 2e200, 1.0, 2.0, 1e-200, 1e-320, 1.7e308])] + [(7, [0.0, 0.0], 1), (8, [-1e300, 1e300], 1), (9, [1e300, float("inf")], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {**{k: (6, 0) for k in range(7)}, 7: (0, 7), 8: (0, 8), 9: (0, 9)}
