"""Filter interaction audit: what each filter removes in each order of five, from parity sums.

Method.  A document's failures are a mask of five bits.  For every part (source) one aggregation
takes 32 signed parity sums for each label: the sum over documents of (-1)^(number of bits that
mask and s share), s = 0..31.  That is the Walsh-Hadamard transform of the counts by mask, so the
same transform divided by 32 gives the counts exactly.  A filter order needs nothing else: what
is left after some filters are the masks that share no bit with them; a filter's Shapley share is
120 / (number of failures) summed over the documents that fail it.

Which documents are repeats is found without gathering copies: the smallest doc_id of each text
(by 256-bit digest) is an aggregate, and a row is first of its text if its own (digest, doc_id)
is among those, a join whose keys are spread also where a third of all rows are one text.

Cases: a null or empty text has no words and fails A, and E where a smaller doc_id's text is
empty too; a null doc_id has no labels, repeats nothing and is repeated by nothing; rows that
repeat doc_id and text are one place in the order, so none of them repeats the other; of several
labels of one doc_id any 1 counts; a null source is the part '' together with empty ones; an empty
table gives no part, so no row; extra columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, shared_dir, stored

LETTERS = "ABCDE"
MASKS = 1 << len(LETTERS)
ORDERS = ["".join(p) for p in permutations(LETTERS)]
SHORT_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 2
KINDS = ("all", "good", "toxic")


def own_failures(text: Column) -> Column:
    """Bits 0 to 3: the filters A to D, which look at the text alone."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, "[ \\x09-\\x0D]"), "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = [
        F.size(words) < SHORT_WORDS,
        F.size(F.array_distinct(words)) * 100 < F.size(words).cast("long") * DISTINCT_PERCENT,
        capitals.cast("long") * 100 > F.length(text).cast("long") * CAPITAL_PERCENT,
        text.rlike("[#$%&*|]"),
    ]
    return sum((x.cast("int") * (1 << i) for i, x in enumerate(fails)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bits A to E), good, toxic, n: the rows of docs with what each fails."""
    rows = docs.select(
        F.coalesce("source", F.lit("")).alias("part"), F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("digest"), own_failures(F.col("text")).alias("own"),
    )
    # Repeated rows become one with a count before anything is joined; the texts are read once.
    rows = stored(rows.groupBy("part", "doc_id", "digest", "own").agg(F.count("*").alias("n")), shared_dir(docs.sparkSession), "masks")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marked = rows.join(first, ["digest", "doc_id"], "left")
    known = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    repeat = F.when(F.col("first").isNull() & F.col("doc_id").isNotNull(), 1 << 4).otherwise(0)
    out = marked.select("part", "doc_id", (F.col("own") + repeat).alias("mask"), "n").join(known, "doc_id", "left")
    return out.select("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), "n")


def parity_sums(marked: DataFrame) -> DataFrame:
    """part and, for each kind, an array of 32 signed sums of its documents."""
    counted = {"all": F.col("n"), "good": F.when(F.col("good"), F.col("n")), "toxic": F.when(F.col("toxic"), F.col("n"))}

    def signed(kind: str, s: int) -> Column:
        odd = F.bit_count(F.col("mask").bitwiseAND(F.lit(s))).bitwiseAND(F.lit(1)) == 1
        return F.coalesce(F.sum(F.when(odd, -counted[kind]).otherwise(counted[kind])), F.lit(0)).cast("long")

    return marked.groupBy("part").agg(*(F.array(*(signed(kind, s) for s in range(MASKS))).alias(f"sums_{kind}") for kind in KINDS))


def cells(sums: DataFrame) -> DataFrame:
    """The sums turned back: part and, for each kind, the number of documents with each mask, and how many are left by each set of filters."""
    for kind in KINDS:
        back = f"transform(sequence(0, {MASKS - 1}), m -> aggregate(sequence(0, {MASKS - 1}), 0L, (t, s) -> t + sums_{kind}[s] * (1 - 2 * (bit_count(m & s) % 2))) div {MASKS})"
        sums = sums.withColumn(f"cells_{kind}", F.expr(back))
    for kind in KINDS:
        left = f"transform(sequence(0, {MASKS - 1}), u -> aggregate(sequence(0, {MASKS - 1}), 0L, (t, m) -> t + if((m & u) = 0, cells_{kind}[m], 0L)))"
        sums = sums.withColumn(f"left_{kind}", F.expr(left))
    shares = ", ".join(f"aggregate(sequence(0, {MASKS - 1}), 0L, (t, m) -> t + if((m & {1 << b}) = 0, 0L, cells_all[m] * (120 div bit_count(m))))" for b in range(len(LETTERS)))
    return sums.withColumn("shares", F.expr(f"array({shares})"))


def plans() -> Column:
    """An array of every step of every order: filter_order, step, the filter's bit number, the filters before it."""
    steps = []
    for order in ORDERS:
        before = 0
        for k, letter in enumerate(order, 1):
            b = LETTERS.index(letter)
            steps.append(F.struct(F.lit(order).alias("filter_order"), F.lit(k).alias("step"), F.lit(b).alias("b"), F.lit(1 << b).alias("own"), F.lit(before).alias("before")))
            before |= 1 << b
    return F.array(*steps)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, filter order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    found = cells(parity_sums(masks(docs, labels)))
    steps = found.select("part", "cells_all", "left_all", "left_good", "left_toxic", "shares", F.explode(plans()).alias("p")).select("*", "p.*")
    own = F.col("own")
    after = F.col("before").bitwiseOR(own)
    lost = lambda kind: F.col(f"left_{kind}")[F.col("before")] - F.col(f"left_{kind}")[after]
    return steps.select(
        "part", "filter_order", "step", F.col("left_all")[after].alias("kept"), lost("all").alias("removed"),
        (F.col("left_all")[0] - F.col("left_all")[own] - lost("all")).alias("redundant"), F.col("cells_all")[own].alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.col("shares")[F.col("b")].alias("shapley"),
    )


ORACLE = r"""
with words as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') as w from documents
), split as (
  select doc_id, part, t, list_filter(w, lambda x: x <> '') as w from words
), firsts as (
  select coalesce(text, '') as t, min(doc_id) as first from documents group by 1
), failing as (
  select s.doc_id, s.part, f.letter from split s join firsts using (t),
    lateral (select unnest(['A', 'B', 'C', 'D', 'E']) as letter, unnest([
      len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_replace(s.t, '[^A-Z]', '', 'g')) > 2 * len(s.t),
      regexp_matches(s.t, '[#$%&*|]'), s.doc_id > first]) as fails) f
  where f.fails
), known as (
  select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from labels group by 1
), docs as (
  select d.doc_id, coalesce(d.source, '') as part, coalesce(good, false) as good, coalesce(toxic, false) as toxic from documents d left join known using (doc_id)
), orders as (
  select a || b || c || d || e as filter_order
  from (values ('A'), ('B'), ('C'), ('D'), ('E')) t1(a), (values ('A'), ('B'), ('C'), ('D'), ('E')) t2(b), (values ('A'), ('B'), ('C'), ('D'), ('E')) t3(c),
       (values ('A'), ('B'), ('C'), ('D'), ('E')) t4(d), (values ('A'), ('B'), ('C'), ('D'), ('E')) t5(e)
  where len(list_distinct([a, b, c, d, e])) = 5
), fails_of as (
  select doc_id, list(letter) as letters from failing group by doc_id
), placed as (
  select o.filter_order, d.part, d.good, d.toxic, f.letters,
    list_min(list_transform(coalesce(f.letters, []), lambda x: instr(o.filter_order, x))) as gone
  from orders o, docs d left join fails_of f using (doc_id)
), steps as (
  select p.part, o.filter_order, s.step, substr(o.filter_order, s.step, 1) as letter
  from (select distinct part from docs) p, orders o, (select unnest(range(1, 6))::int as step) s
), counted as (
  select s.part, s.filter_order, s.step,
    count(*) filter (where gone is null or gone > s.step) as kept, count(*) filter (where gone = s.step) as removed,
    count(*) filter (where gone < s.step and list_contains(letters, s.letter)) as redundant, count(*) filter (where letters = [s.letter]) as unique_fails,
    count(*) filter (where gone = s.step and good) as good_lost, count(*) filter (where gone = s.step and toxic) as toxic_lost, s.letter
  from steps s join placed a on a.part = s.part and a.filter_order = s.filter_order group by s.part, s.filter_order, s.step, s.letter
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) over (partition by part, letter))::bigint as shapley
from counted
"""


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
