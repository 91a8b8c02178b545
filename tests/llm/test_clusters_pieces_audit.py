"""Centroid clustering, SentencePiece and the filter audit against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusforge.llm import centroids, filter_audit, sentence_piece

sha = lambda b: hashlib.sha256(b).hexdigest()

# ---- 11


def plain_clusters(rows, clusters=8, rounds=10):
    """Rows (vec_id, embedding) clustered one by one in Python integers."""
    kept = [(i, [math.floor(x * 1024) if abs(x) < 2**53 else int(x) * 1024 for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    starts = sorted((sha(f"3:{i}".encode()), x) for i, x in kept if i is not None)[:clusters]
    if not starts:
        return []
    c = [x for _, x in starts]

    def nearest(x):
        far = [sum((a - b) ** 2 for a, b in zip(x, row)) for row in c]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        own = [[x for x, k in ((x, nearest(x)[0]) for _, x in kept) if k == j] for j in range(len(c))]
        c = [[sum(col) // len(v) for col in zip(*v)] if v else old for v, old in zip(own, c)]
    found = [(i, *nearest(x)) for i, x in kept]
    inertia = Counter()
    for _, k, d in found:
        inertia[k] += d
    fits = lambda v: v if v < 2**63 else None
    return [(i, k, fits(d), fits(inertia[k]), fits(sum(inertia.values())), sha(",".join(map(str, c[k])).encode())) for i, k, d in found]


def vectors(size, n=120, seed=1):
    r = random.Random(seed)
    centre = [[r.uniform(-size, size) for _ in range(64)] for _ in range(5)]
    rows = [(i, [x + r.uniform(-size, size) / 3 for x in r.choice(centre)]) for i in range(n)]
    return [*rows, rows[3], rows[3], (rows[5][0], rows[6][1]), (n + 1, None), (n + 2, []), (n + 3, [1.0] * 63), (n + 4, [1.0] * 65), (n + 5, [float("nan")] * 64), (n + 6, [float("-inf"), *[0.0] * 63]), (n + 7, [None, *[0.0] * 63]), (None, rows[7][1]), (n + 8, [0.0] * 64), (n + 9, [-0.0] * 64)]


KEY = lambda t: tuple(str(x) for x in t)


@pytest.mark.parametrize("size", [1.0, 5e3, 1e5, 1e12, 1e200])
def test_clusters_are_exact_at_every_magnitude(spark, size):
    """float64 products, int64 differences and Python integers, with every odd row."""
    rows = vectors(size)
    df = spark.createDataFrame([(i, e, "x", 7) for i, e in rows], "vec_id long, embedding array<double>, cluster string, distance int").repartition(3)
    got = [tuple(r) for r in centroids.cluster(df).collect()]
    assert sorted(got, key=KEY) == sorted(plain_clusters(rows), key=KEY)


def test_clusters_of_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(i, [float(i)] * 64) for i in range(3)]
    assert sorted(map(tuple, centroids.cluster(spark.createDataFrame(rows, schema)).collect()), key=KEY) == sorted(plain_clusters(rows), key=KEY)
    assert centroids.cluster(spark.createDataFrame([], schema)).collect() == []
    assert centroids.cluster(spark.createDataFrame([(None, [1.0] * 64), (1, [1.0])], schema)).collect() == []


def test_nearest_ties_and_bounds():
    c = np.array([[0, 2], [2, 0], [0, 2]], np.int64)
    for x in (np.array([[1, 1]], np.int64), np.array([[1, 1]], object)):
        assert [v.tolist() for v in centroids.nearest(x, c)] == [[0], [2]]
    r = np.random.default_rng(1)
    for high in (2**20, 2**23, 2**27, 2**31, 2**60):
        x, c = r.integers(-high, high, (50, 64)), r.integers(-high, high, (5, 64))
        far = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w)) for w in c] for v in x]
        best, least = centroids.nearest(x, c)
        assert best.tolist() == [f.index(min(f)) for f in far] and [int(v) for v in least] == [min(f) for f in far]


# ---- 12


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(path):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def odd_texts(model):
    r = random.Random(2)
    bits = [" ", "  ", "▁", "\n", "\t", "a", "e", "th", "tion", "é", "你", "ﬁ", "😀", "=", "==", "0", "<s>", "</s>", "<0x0A>", "\x00", "‍", "́", "के", "▁▁", "    ", "�", "٣"]
    out = ["", None, "a", " ", "   x", *(" " * k for k in range(1, 40)), *(" " * k + "w" for k in range(1, 40)), *("x" * k for k in range(1, 40))]
    out += ["".join(r.choice(bits) for _ in range(r.randint(1, 40))) for _ in range(1500)]
    pieces = list(model.id)
    out += ["".join(r.choice(pieces) for _ in range(r.randint(1, 12))) for _ in range(1500)]
    return [*out, "=" * 9000 + "-" * 9000 + " " * 9000 + "ab" * 9000, "你好" * 20_000]


def test_pieces_equal_the_library(spark, docs, texts, path, library):
    rows = [(i, t) for i, t in enumerate(odd_texts(sentence_piece.model(path)))]
    for df, own in ((docs, texts), (spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows)):
        want = Counter()
        for i, t in own:
            ids = library.encode(t or "", add_bos=True, add_eos=True)
            want[i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids).encode())] += 1
        assert Counter(map(tuple, sentence_piece.digests(df, path).collect())) == want


def test_pieces_encode_and_decode(spark, docs, empty, texts, path, library):
    coded = sentence_piece.encode(docs, path)
    got = {r.doc_id: r.ids for r in coded.collect()}
    assert got == {i: library.encode(t or "", add_bos=True, add_eos=True) for i, t in texts}
    back = {r.doc_id: r.text for r in sentence_piece.decode(coded, path).collect()}
    assert back == {i: t or "" for i, t in texts}
    assert sentence_piece.digests(empty, path).collect() == [] == sentence_piece.encode(empty, path).collect()


def test_decoding_of_any_ids(spark, path, library):
    r = random.Random(5)
    rows = [(k, [r.choice([r.randrange(5), r.randrange(3, 259), r.randrange(259, 280), r.randrange(259, 32_000)]) for _ in range(r.randint(0, 8))]) for k in range(3000)]
    df = spark.createDataFrame([*rows, (-1, None), (-2, [1, None, 99_999, -4])], "doc_id long, ids array<int>")
    got = {x.doc_id: x.text for x in sentence_piece.decode(df, path).collect()}
    assert got == {k: library.decode(ids) for k, ids in rows} | {-1: None, -2: " ⁇ " * 3}


def test_invalid_bytes_count_as_replacement_characters(spark, path, library):
    df = spark.createDataFrame([(1, bytearray(b"ab\xff cd\xe4\xbd")), (2, bytearray("é".encode()))], "doc_id long, b binary").select("doc_id", F.col("b").cast("string").alias("text"))
    got = {r.doc_id: r.ids_sha256 for r in sentence_piece.digests(df, path).collect()}
    want = {1: "ab� cd��", 2: "é"}
    assert got == {i: sha(np.array(library.encode(t, add_bos=True, add_eos=True), "<u4").tobytes()) for i, t in want.items()}


def test_backtracking_equals_merging(path):
    """Slices that nothing splits: longest matches with compatible neighbours against plain merging."""
    model, r = sentence_piece.model(path), random.Random(6)
    pieces = [p for p in model.id if len(p) > 2]
    for _ in range(1500):
        text = "".join(r.choice(pieces)[r.randrange(2) :] for _ in range(r.randint(1, 6)))
        assert model.parts(text) == model.merged(text)


# ---- 13


def plain_audit(docs, labels):
    """Every order of filters applied document by document: rows (doc_id, text, source)."""
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good, toxic = ({d for d, *own in labels if d is not None and own[k] == 1} for k in (0, 1))
    parts = {}
    for i, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i}
        parts.setdefault(s or "", []).append((i, {k for k, v in fails.items() if v}))
    out = {}
    for part, own in parts.items():
        share = Counter()
        for order in permutations("ABCDE"):
            left = list(own)
            for step, f in enumerate(order, 1):
                gone = [(i, m) for i, m in left if f in m]
                left = [(i, m) for i, m in left if f not in m]
                share[f] += len(gone)
                all_fail = sum(f in m for _, m in own)
                out[part, "".join(order), step] = [len(left), len(gone), all_fail - len(gone), sum(m == {f} for _, m in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), f]
        for key, row in out.items():
            if key[0] == part:
                row[-1] = share[row[-1]]
    return {k: tuple(v) for k, v in out.items()}


def audited(spark, docs, labels):
    d = spark.createDataFrame([(i, t, s, 1, "x") for i, t, s in docs], "doc_id long, text string, source string, n int, mask string").repartition(3)
    got = filter_audit.audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}, len(got)


def test_audit_by_brute_force(spark, texts):
    r = random.Random(8)
    docs = [(i, t, r.choice(["a", "b", "", None])) for i, t in texts]
    long = " ".join(f"word{k}" for k in range(250))
    docs += [(2000 + k, x, "a") for k, x in enumerate([long, long, long + " #", long.upper(), "w " * 300, "W | " * 300, long + "\x1c", long.replace(" ", "\x0b")])]
    docs += [docs[3], docs[3], (None, long, "a"), (None, None, None), (2000, "other text under a used id", "b"), (1990, long, "c"), (5000, "x" * 300_000, "c")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i, *_ in docs if i and i % 2] + [(None, 1, 1), (2001, 0, 1), (2001, 1, 0), (77_777, 1, 1)]
    got, n = audited(spark, docs, labels)
    want = plain_audit(docs, labels)
    assert got == want and n == len(want) == 4 * 600


def test_audit_of_copies_and_nothing(spark):
    """Two thirds of all rows are one text; an empty table has no part."""
    text = " ".join(f"w{k}" for k in range(220))
    docs = [(k, text if k % 3 else f"{text} {k}", f"s{k % 2}") for k in range(300)]
    got, _ = audited(spark, docs, [(k, 1, 0) for k in range(0, 300, 2)])
    assert got == plain_audit(docs, [(k, 1, 0) for k in range(0, 300, 2)])
    assert audited(spark, [], []) == ({}, 0)
