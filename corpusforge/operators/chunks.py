"""Chunk planner: sentence packing with overlap, transcript merging, section lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import split_sentences

TARGET, OVERLAP, HEADING_MIN = 800, 150, 200

STATE = "struct<done:array<struct<text:string,start:int,stop:int>>,held:array<string>,size:int,at:int,cursor:int>"


def pack(text: Column, target: int = TARGET, overlap: int = OVERLAP) -> Column:
    """Chunks array<struct<text, start, stop>> of a text: up to the target as it is, longer ones by one fold over their sentences.

    A chunk closes when its sentences reach the target; its last sentences, up to `overlap`
    characters but never all of them, begin the next one.  A heading opens a new chunk, without
    overlap, once the buffer holds HEADING_MIN characters.  Offsets count from the place where
    a sentence is found after the previous one; after a close they step back by the length of
    the tail without the separators between its sentences.
    """
    empty = F.from_json(F.lit('{"done":[],"held":[],"size":0,"at":0,"cursor":0}'), STATE)

    def tail(held: Column) -> Column:
        step = lambda acc, s: F.when(
            ~acc["full"] & ((F.size(acc["keep"]) == 0) | (acc["n"] + F.length(s) <= overlap)),
            F.struct(F.concat(F.array(s), acc["keep"]).alias("keep"), (acc["n"] + F.length(s)).alias("n"), F.lit(False).alias("full")),
        ).otherwise(F.struct(acc["keep"].alias("keep"), acc["n"].alias("n"), F.lit(True).alias("full")))
        first = F.struct(F.array().cast("array<string>").alias("keep"), F.lit(0).alias("n"), F.lit(False).alias("full"))
        out = F.aggregate(F.reverse(held), first, step)["keep"]
        return F.when(F.size(out) >= F.size(held), F.array().cast("array<string>")).otherwise(out)

    total = lambda a: F.aggregate(a, F.lit(0), lambda n, s: n + F.length(s))

    def close(s: Column, keep_tail: bool) -> Column:
        body = F.trim(F.array_join(s["held"], " "))
        done = F.when(body != "", F.concat(s["done"], F.array(F.struct(body.alias("text"), s["at"].alias("start"), (s["at"] + F.length(F.array_join(s["held"], " "))).alias("stop"))))).otherwise(s["done"])
        held = tail(s["held"]) if keep_tail else F.array().cast("array<string>")
        return F.struct(done.alias("done"), held.alias("held"), total(held).alias("size"), (s["cursor"] - total(held)).alias("at"), s["cursor"].alias("cursor"))

    def step(s: Column, sentence: Column) -> Column:
        found = F.call_function("locate", sentence, text, s["cursor"] + 1)
        start = F.when(found > 0, found - 1).otherwise(s["cursor"])
        opened = F.when(sentence.rlike(r"^#{1,6}[ \t]") & (s["size"] >= HEADING_MIN), close(s, False)).otherwise(s)
        added = F.struct(
            opened["done"].alias("done"),
            F.concat(opened["held"], F.array(sentence)).alias("held"),
            (opened["size"] + F.length(sentence)).alias("size"),
            F.when(F.size(opened["held"]) == 0, start).otherwise(opened["at"]).alias("at"),
            (start + F.length(sentence)).alias("cursor"),
        )
        return F.when(added["size"] >= target, close(added, True)).otherwise(added)

    body = F.regexp_replace(text, r"^(?U:\s)+|(?U:\s)+$", "")
    whole = F.when(body != "", F.array(F.struct(body.alias("text"), F.lit(0).alias("start"), F.length(text).alias("stop")))).otherwise(F.array())
    return F.when(F.length(text) <= target, whole).otherwise(F.aggregate(split_sentences(text), empty, step, lambda s: close(s, False)["done"]))


def chunks(docs: DataFrame, target: int = TARGET, overlap: int = OVERLAP, key: str = "doc_id") -> DataFrame:
    """key, ordinal, text, start, stop: texts up to the target stay whole, longer ones are packed in partitions of documents."""
    from collections.abc import Iterator

    import pandas as pd

    kinds = f"{key} {docs.schema[key].dataType.simpleString()}, ordinal int, text string, start int, stop int"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for doc, text, sentences in zip(p[key], p["text"], p["sentences"], strict=True):
                got = [(text.strip(), 0, len(text))] if len(text) <= target else packed(text, list(sentences), target, overlap)
                rows += [(doc, k, *x) for k, x in enumerate(x for x in got if x[0])]
            yield pd.DataFrame(rows, columns=[key, "ordinal", "text", "start", "stop"])

    long = docs.select(key, "text", F.when(F.length("text") > target, split_sentences(F.col("text"))).otherwise(F.array().cast("array<string>")).alias("sentences")).where("text is not null")
    return long.mapInPandas(run, kinds)


def packed(text: str, sentences: list[str], target: int, overlap: int) -> list[tuple[str, int, int]]:
    """pack() of one text, for partitions that are read in batches."""
    out: list[tuple[str, int, int]] = []
    held: list[str] = []
    at = cursor = 0

    def close(keep: bool) -> list[str]:
        body = " ".join(held)
        if body.strip():
            out.append((body.strip(), at, at + len(body)))
        tail: list[str] = []
        for s in reversed(held) if keep else ():
            if tail and sum(map(len, tail)) + len(s) > overlap:
                break
            tail.insert(0, s)
        return [] if len(tail) >= len(held) else tail

    for s in sentences:
        found = text.find(s, cursor)
        start = found if found >= 0 else cursor
        if held and s.startswith("#") and s.lstrip("#")[:1] in (" ", "\t") and sum(map(len, held)) >= HEADING_MIN:
            held = close(False)
            at = cursor
        if not held:
            at = start
        held.append(s)
        cursor = start + len(s)
        if sum(map(len, held)) >= target:
            held = close(True)
            at = cursor - sum(map(len, held))
    close(False)
    return out


def runs(df: DataFrame, by: str, order: str, mergeable: Column) -> DataFrame:
    """Adds run: number of the stretch of consecutive mergeable rows (each other row is its own)."""
    w = Window.partitionBy(by).orderBy(order)
    same = mergeable & F.coalesce(F.lag(mergeable).over(w), F.lit(False))
    return df.withColumn("run", F.sum(F.when(same, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def merge_runs(df: DataFrame, by: str, order: str, text: str, target: int = TARGET) -> DataFrame:
    """Greedy merge of each run's rows up to `target` characters: by, run, part, first, last, text."""
    items = df.groupBy(by, "run").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("items"))
    empty = F.from_json(F.lit('{"done":[],"a":null,"b":null,"t":null}'), "struct<done:array<struct<first:bigint,last:bigint,text:string>>,a:bigint,b:bigint,t:string>")

    def step(s: Column, x: Column) -> Column:
        fits = s["t"].isNotNull() & (F.length(s["t"]) + F.length(x["t"]) + 1 <= target)
        return F.when(fits, F.struct(s["done"].alias("done"), s["a"].alias("a"), x["o"].alias("b"), F.concat_ws(" ", s["t"], x["t"]).alias("t"))).otherwise(
            F.struct(flush(s).alias("done"), x["o"].alias("a"), x["o"].alias("b"), x["t"].alias("t"))
        )

    def flush(s: Column) -> Column:
        return F.when(s["t"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(F.struct(s["a"].alias("first"), s["b"].alias("last"), s["t"].alias("text")))))

    return items.select(by, "run", F.posexplode(F.aggregate("items", empty, step, flush)).alias("part", "x")).select(by, "run", "part", "x.first", "x.last", "x.text")


def section_at(headings: Column, start: Column, stop: Column, fallback: Column) -> Column:
    """Section of a span: the last heading at or before its start, else the first inside it, else the fallback.  headings: array<struct<at, title>> in order."""
    before = F.filter(headings, lambda h: h["at"] <= start)
    inside = F.filter(headings, lambda h: (h["at"] > start) & (h["at"] < stop))
    return F.coalesce(F.try_element_at(before, F.lit(-1))["title"], F.try_element_at(inside, F.lit(1))["title"], fallback)


HEADING = r"^#{1,6}[ \t]+(.+?)[ \t#]*$"


def headings_of(text: Column) -> Column:
    """array<struct<at, title>>: heading lines with the place where each starts, found by a running position over the lines."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,title:string>>").alias("found"))

    def line(s: Column, x: Column) -> Column:
        title = F.substring(F.trim(F.regexp_extract(x, HEADING, 1)), 1, 200)
        return F.struct((s["at"] + F.length(x) + 1).alias("at"), F.when(x.rlike(HEADING), F.concat(s["found"], F.array(F.struct(s["at"].alias("at"), title.alias("title"))))).otherwise(s["found"]).alias("found"))

    return F.aggregate(F.split(text, "[\n\r\u2028\u2029]", -1), start, line, lambda s: s["found"])


def transcript_parts(items: Column, target: int = TARGET) -> Column:
    """Parts array<struct<first, last, text>> of consecutive pieces (array<struct<o, t>>): a piece opens a new part where it would take a part beyond the target."""
    kind = "struct<done:array<struct<first:bigint,last:bigint,texts:array<string>>>,size:int>"
    empty = F.from_json(F.lit('{"done":[],"size":0}'), kind)

    def step(s: Column, x: Column) -> Column:
        opens = (F.size(s["done"]) == 0) | ((s["size"] > 0) & (s["size"] + F.length(x["t"]) > target))
        last = F.element_at(s["done"], -1)
        own = F.struct(x["o"].cast("bigint").alias("first"), x["o"].cast("bigint").alias("last"), F.array(F.trim(x["t"])).alias("texts"))
        longer = F.struct(last["first"].alias("first"), x["o"].cast("bigint").alias("last"), F.concat(last["texts"], F.array(F.trim(x["t"]))).alias("texts"))
        done = F.when(opens, F.concat(s["done"], F.array(own))).otherwise(F.concat(F.slice(s["done"], F.lit(1), F.size(s["done"]) - 1), F.array(longer)))
        return F.struct(done.alias("done"), F.when(opens, F.length(x["t"])).otherwise(s["size"] + F.length(x["t"])).alias("size"))

    parts = F.aggregate(items, empty, step, lambda s: s["done"])
    return F.filter(F.transform(parts, lambda p: F.struct(p["first"].alias("first"), p["last"].alias("last"), F.trim(F.array_join(p["texts"], " ")).alias("text"))), lambda p: p["text"] != "")


BLOCK = ("kind", "source", "text", "page", "ts_start", "ts_end", "section")
PLANNED = "doc_id, ordinal, route, kind, source, text, page, start, stop, ts_start, ts_end, section"


def plan_chunks(blocks: DataFrame, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """PLANNED: the chunks of documents given as blocks (doc_id, place and BLOCK), each by the route of its kind.

    region and image blocks stay as they are (an empty region is left out), since a citation points
    at them; consecutive pieces of a transcript (source asr) on one page are merged up to the target and
    keep their time span instead of offsets; other texts stay whole up to the target and are
    packed by sentences beyond it, with the section that their place falls into.  Ordinals
    number a document's chunks over all routes.  A null text counts as empty.
    """
    b = blocks.select("doc_id", F.col("place").cast("long").alias("place"), *BLOCK).withColumn("text", F.coalesce("text", F.lit("")))
    w = Window.partitionBy("doc_id").orderBy("place")
    spoken = (F.col("kind") == "text") & (F.col("source") == "asr")
    joins = spoken & F.coalesce(F.lag(spoken).over(w) & F.lag("page").over(w).eqNullSafe(F.col("page")), F.lit(False))
    b = b.withColumn("run", F.sum(F.when(joins, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "run")))
    route = F.when(F.col("kind").isin("region", "image"), F.col("kind")).when(F.col("n") > 1, "transcript").when(F.length("text") > target, "split").otherwise("whole")
    b = b.withColumn("route", route)
    own = ["doc_id", "route", "kind", "source", "page", "ts_start", "ts_end"]
    none = F.lit(None).cast("int")
    trimmed = F.regexp_replace("text", r"^(?U:\s)+|(?U:\s)+$", "")
    alone = b.where(F.col("route").isin("region", "image", "whole")).withColumn("plain", F.col("route") == "whole")
    alone = alone.where((F.col("route") == "image") | (trimmed != "")).select(
        *own, "place", F.lit(0).alias("part"), F.when(F.col("route") == "image", F.col("text")).otherwise(trimmed).alias("text"), F.when(F.col("plain"), 0).alias("start"), F.when(F.col("plain"), F.length("text")).alias("stop"),
        F.when(F.col("plain"), section_at(headings_of(F.col("text")), F.lit(0), F.length("text"), F.col("section"))).otherwise(F.col("section")).alias("section"),
    )
    said = b.where("route = 'transcript'").groupBy("doc_id", "run").agg(F.array_sort(F.collect_list(F.struct(F.col("place").alias("o"), F.col("text").alias("t")))).alias("items"))
    said = said.select("doc_id", F.posexplode(transcript_parts(F.col("items"), target)).alias("part", "p")).select("doc_id", F.col("p.first").alias("place"), F.col("p.last").alias("last"), F.col("p.text").alias("text"))
    ends = b.select("doc_id", F.col("place").alias("last"), F.col("ts_end").alias("until"))
    merged = said.join(b.drop("text"), ["doc_id", "place"]).drop("ts_end").join(ends, ["doc_id", "last"]).withColumnRenamed("until", "ts_end")
    merged = merged.select(*own, "place", F.lit(0).alias("part"), "text", none.alias("start"), none.alias("stop"), "section")
    long = b.where("route = 'split'").withColumn("key", F.struct("doc_id", "place"))
    packed_ = chunks(long.select(F.to_json("key").alias("k"), "text"), target, overlap, "k").withColumnRenamed("ordinal", "part")
    heads = long.select(F.to_json("key").alias("k"), *own, "place", "section", headings_of(F.col("text")).alias("heads"), F.length("text").alias("whole"))
    cut = packed_.join(heads, "k").withColumn("stop", F.least(F.col("start") + F.length("text"), "whole"))
    cut = cut.select(*own, "place", "part", "text", "start", "stop", section_at(F.col("heads"), F.col("start"), F.col("start") + F.length("text"), F.col("section")).alias("section"))
    every = alone.unionByName(merged).unionByName(cut)
    order = Window.partitionBy("doc_id").orderBy("place", "part")
    return every.withColumn("ordinal", (F.row_number().over(order) - 1).cast("int")).select(*PLANNED.split(", "))
