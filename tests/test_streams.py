"""Queue, cursor import, stored chunks and the chunk planner: restarts, crashes, cuts, odd rows."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from corpusforge.operators import chunks as C
from corpusforge.operators import store
from corpusforge.session import shared_folder
from corpusforge.streaming import cursor, jobs
from corpusforge.streaming import queue as Q

EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)


# ---- queue


def plain_queue(rows, p):
    """Rows (job, id, at, failed) in order of time, one job after another."""
    out, jobs_ = [], {}
    for job, id_, at, failed in sorted(rows, key=lambda r: (r[2], r[1])):
        s = jobs_.get(job)
        if s and s["over"] and at >= s["until"]:
            s = None
        if s and at < s["until"]:
            out.append((job, id_, at, s["n"], "duplicate"))
            continue
        n = s["n"] + 1 if s else 1
        if failed and n < p.attempts:
            jobs_[job], said = {"n": n, "over": False, "until": at + p.delay * 2 ** (n - 1)}, "retry"
        else:
            jobs_[job], said = {"n": n, "over": True, "until": at + p.keep}, "failed" if failed else "done"
        out.append((job, id_, at, n, said))
    return sorted(out)


def test_queue_goes_on_after_a_restart(spark, tmp_path):
    """Three runs over files that arrive one by one, each from the checkpoint of the one before, equal one pass over all rows."""
    r, policy = random.Random(3), Q.Policy(3, 60_000, 600_000)
    rows, t = [], 0
    for i in range(300):
        t += r.randrange(1, 60_000)
        rows.append((r.randrange(6), i, t, r.random() < 0.6))
    folder, source, got = str(tmp_path / "out"), str(tmp_path / "in"), None
    for k in range(3):
        part = [(j, i, EPOCH + timedelta(milliseconds=at), f) for j, i, at, f in rows[100 * k : 100 * (k + 1)]]
        spark.createDataFrame(part, "job long, id long, ts timestamp, failed boolean").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("job long, id long, ts timestamp, failed boolean").parquet(source)
        got = jobs.run_once(spark, Q.run_jobs(stream, policy), folder=folder, settings=Q.STATE)
    base = int(EPOCH.timestamp() * 1000)
    assert sorted((x.job, x.id, x.at - base, x.attempt, x.outcome) for x in got.collect()) == plain_queue(rows, policy)
    state = {x.job: (x.attempts, x.outcome) for x in Q.plain_jobs(got).collect()}
    last = {}
    for job, i, at, n, said in sorted(plain_queue(rows, policy), key=lambda x: (x[2], x[1])):
        if said != "duplicate":
            last[job] = (n, said)
    assert state == last
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != Q.ROCKS


# ---- cursor


SCHEMA = "uid long, at timestamp, identity string, subject string"


def mailbox(spark, n, validity=1):
    """Message k has number k * 10 + validity, and an identity that survives a renumbering; every fourth repeats an earlier one."""
    return spark.createDataFrame([(k * 10 + validity, EPOCH + timedelta(days=k), f"m{k // 2 * 2 if k % 4 == 3 else k}", f"s{k}") for k in range(n)], SCHEMA)


def test_import_survives_a_crash_and_a_renumbering(spark, monkeypatch):
    folder, since = shared_folder(spark), EPOCH + timedelta(days=5)
    box = mailbox(spark, 40)
    cursor.sync(box, folder, 1, since, 7, steps=2)
    real = cursor._note

    def dies(df, where, kind, entry):
        if kind == "done":
            raise RuntimeError("lost")
        real(df, where, kind, entry)

    monkeypatch.setattr(cursor, "_note", dies)
    with pytest.raises(RuntimeError):
        cursor.step(box, folder, 1, since, 7)  # rows are written, the end is not noted
    monkeypatch.setattr(cursor, "_note", real)
    planned = cursor.next_plan(box, folder, 1, since, 7)
    assert planned == cursor.next_plan(mailbox(spark, 60), folder, 1, since, 3)  # the batch is replayed as it was planned
    want = {f"m{k // 2 * 2 if k % 4 == 3 else k}" for k in range(5, 40)}
    got = cursor.sync(box, folder, 1, since, 7).collect()
    assert sorted(x.identity for x in got) == sorted(want)
    assert {x.identity: x.uid for x in got}["m6"] == 61
    more = cursor.sync(mailbox(spark, 50, 2), folder, 2, since, 11).collect()  # numbers are void, identities are not
    assert sorted(x.identity for x in more) == sorted(want | {f"m{k // 2 * 2 if k % 4 == 3 else k}" for k in range(40, 50)})
    assert {x.uid % 10 for x in more if int(x.identity[1:]) < 40} == {1}
    assert not cursor.step(mailbox(spark, 50, 2), folder, 2, since, 11)


def test_empty_mailbox(spark):
    assert cursor.sync(mailbox(spark, 0), shared_folder(spark), 1, EPOCH).count() == 0


# ---- stored chunks


def test_store_skips_files_and_sizes_buckets(spark):
    columns, folder = "doc_id long, ordinal int, page int, kb string", shared_folder(spark)
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit(0).alias("ordinal"), (F.col("id") % 50).cast("int").alias("page"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("kb"))
    store.create(rows.repartition(3), folder, 8)
    assert store.buckets_of(spark, folder) == 8 and [store.buckets_for(n) for n in (0, 5_000_000, 10**12)] == [4, 8, 65_536]
    with pytest.raises(ValueError):
        store.create(rows, folder)
    with pytest.raises(ValueError):
        store.buckets_of(spark, folder + "-none")
    every = store.read(spark, folder, columns)
    assert every.count() == 4000
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        def scanned(df):
            df.collect()
            leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
            m = leaves.apply(0).metrics()
            return m.apply("numFiles").value(), m.apply("numOutputRows").value()

        files, out = scanned(every.where("kb = 'a'"))
        assert out == 2000
        assert scanned(every.where("kb = 'a' and bucket = 3"))[0] < files
        assert scanned(every.where("kb = 'a' and doc_id = 10"))[1] < out / 4  # row groups by least and greatest value
        assert scanned(every.where("kb = 'a' and page = 7"))[1] == 0  # odd pages stand in b alone: Bloom filters
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    store.replace_documents(spark, folder, rows.where("doc_id in (10, 11)").withColumn("ordinal", F.lit(5)), columns)
    after = store.read(spark, folder, columns)
    assert after.count() == 4000 and {r.ordinal for r in after.where("doc_id in (10, 11)").collect()} == {5}


# ---- chunk planner


def test_routes_of_chunks(spark):
    long = "# One\n" + " ".join(f"Sentence {i} of the first part runs on." for i in range(20)) + "\n## Two ##\n" + " ".join(f"Sentence {i} of the second part." for i in range(20))
    rows = [
        (1, 0, "text", "asr", " hello ", 1, 0.0, 1.0, "s"), (1, 1, "text", "asr", "there", 1, 1.0, 2.0, "s"), (1, 2, "text", "asr", "other page", 2, 2.0, 3.0, "t"), (1, 3, "region", "layout", " chart ", 2, None, None, "r"),
        (1, 4, "region", "layout", "  ", 2, None, None, "r"), (1, 5, "image", "caption", None, 2, None, None, "i"), (1, 6, "text", "pdf", long, 3, None, None, "p"), (1, 7, "text", "pdf", "", 3, None, None, "p"), (1, 8, "text", "pdf", "intro\n# Late\nrest", 4, None, None, "p"),
        (2, 0, "text", "asr", "x" * 500, 1, 0.0, 1.0, None), (2, 1, "text", "asr", "y" * 500, 1, 1.0, 2.0, None), (2, 2, "text", "asr", "z" * 200, 1, 2.0, 3.0, None), (2, 3, "text", "asr", None, 1, 3.0, 4.0, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, place int, kind string, source string, text string, page int, ts_start double, ts_end double, section string").repartition(3)
    got = {}
    for r in C.plan_chunks(df).orderBy("doc_id", "ordinal").collect():
        got.setdefault(r.doc_id, []).append(r)
    assert [r.ordinal for r in got[1]] == list(range(len(got[1])))
    assert [(r.route, r.text, r.ts_start, r.ts_end, r.start) for r in got[1][:4]] == [("transcript", "hello there", 0.0, 2.0, None), ("whole", "other page", 2.0, 3.0, 0), ("region", "chart", None, None, None), ("image", "", None, None, None)]
    split = [r for r in got[1] if r.route == "split"]
    assert len(split) >= 2 and split[0].section == "One" and split[-1].section == "Two"
    assert all(long[r.start : r.stop].split()[:3] == r.text.split()[:3] or r.start > 0 for r in split)
    assert (got[1][-1].text, got[1][-1].section, got[1][-1].stop) == ("intro\n# Late\nrest", "Late", 17)
    assert [(len(r.text), r.ts_start, r.ts_end) for r in got[2]] == [(500, 0.0, 1.0), (701, 1.0, 4.0)]
    assert C.plan_chunks(df.where("doc_id > 5")).count() == 0


def test_heading_places(spark):
    text = "a\n# One #\n\r\n#no\n###### Six \t\nb # c\n#  Two"
    got = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(C.headings_of(F.col("t")).alias("h")).collect()
    assert [(h.at, h.title) for h in got[0].h] == [(text.index("# One"), "One"), (text.index("######"), "Six"), (text.index("#  Two"), "Two")]
    assert got[1].h == [] and got[2].h is None
