"""The corpus pipeline, stage by stage, against plain versions."""

from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from corpusforge.llm import bpe, decontaminate, minhash, secret_scan, toxicity
from corpusforge.llm.common import BATCH_CONF, STAGE_BYTES

from .test_llm import items_of, labelled, plain_hits, plain_near

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, docs, texts, tmp_path_factory):
    out = tmp_path_factory.mktemp("sf")
    docs.select("doc_id", "text", "lang", F.lit("s").alias("source"), F.length("text").alias("n_chars")).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, int(i % 2 == 0), 0) for i, _ in texts], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(items_of(texts), "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def test_stages(spark, folder, texts):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "decontamination", "secrets", "tokens"]
    ids = lambda df: {r.doc_id for r in df.collect()}
    assert ids(stages["toxicity"](spark, docs, folder)) == {i for i, _ in texts}
    near = stages["near_duplicates"](spark, docs, folder)
    assert near.columns == docs.columns and ids(near) == {i for i, x in plain_near(texts, 5, 80).items() if x[3]}
    clean = stages["decontamination"](spark, docs, folder)
    assert ids(clean) == {x[0] for x in plain_hits(texts, items_of(texts)) if not x[5]}
    assert ids(stages["secrets"](spark, docs, folder)) == {i for i, _ in texts}
    out = stages["tokens"](spark, docs, folder)
    assert out.where("not round_trip").count() == 0 and out.count() == len(texts)


def test_toxic_documents_go_and_secrets_are_masked(spark, tmp_path):
    """Planted cases: documents with insults go, clean ones stay; each secret is replaced and nothing else of a text changes."""
    rows = labelled("toxic")
    key = "Zk3vQ9xLm2Rt8YbN5cWd7HfJ"
    secrets = [(5000 + i, f'before {i} token = "{key}{i}" and after') for i in range(3)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + secrets, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = {r.doc_id for r in stages["toxicity"](spark, docs, str(tmp_path)).collect()}
    wrong = [i for i, _, y in rows if (i in kept) == bool(y)]
    assert len(wrong) <= 0.05 * len(rows) and {i for i, _ in secrets} <= kept
    masked = {r.doc_id: r.text for r in stages["secrets"](spark, docs, str(tmp_path)).collect()}
    assert {i: masked[i] for i, _ in secrets} == {i: t.replace(f"{key}{i - 5000}", secret_scan.MASK.decode()) for i, t in secrets}
    assert all(masked[i] == t for i, t, _ in rows)


def test_fitting_starts_no_workers_of_its_own(spark, folder, monkeypatch):
    """The chosen ids go out as Arrow; a list of rows would be read by a second pool of Python workers in every executor."""
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *_: pytest.fail("rows of a list"))
    docs, labels = (spark.read.parquet(f"{folder}/{x}.parquet") for x in ("documents", "labels"))
    assert toxicity.sample(docs, labels, "quality").texts
    assert toxicity.unlabelled(docs, labels.where("doc_id % 2 = 0"))


def test_stages_take_small_batches_and_chunks(spark, folder, monkeypatch):
    """All stages run in the same workers: each bounds its batches, and works on chunks of STAGE_BYTES without changing a row."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    stages, runs = dict(corpus_pipeline.STAGES), {}
    spark.conf.unset(BATCH_CONF)
    with monkeypatch.context() as m:
        for name in ("toxicity", "decontamination", "secrets", "tokens"):
            spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
            m.setattr(type(docs), "mapInArrow", lambda self, f, schema, *_, name=name: runs.update({name: f}) or self)
            stages[name](spark, docs, folder)
            assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == corpus_pipeline.BATCH_BYTES
        m.setattr(type(docs), "mapInArrow", lambda self, f, schema, *_: runs.update(near_duplicates=f) or self)
        minhash.signatures(docs, corpus_pipeline.NEAR_WORDS, STAGE_BYTES)
    rows = [f"row {i} " + f"token = \"Zk3vQ9xLm2Rt8YbN5cWd7HfJ{i}\" some words of text " * 200 for i in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array(rows)], ["doc_id", "text"])
    assert batch.nbytes > 4 * STAGE_BYTES
    for name, module in (("toxicity", toxicity), ("near_duplicates", minhash), ("decontamination", decontaminate), ("secrets", secret_scan), ("tokens", bpe)):
        sizes, cut = [], module.chunks_of
        with monkeypatch.context() as m:
            m.setattr(module, "chunks_of", lambda *a, **k: (sizes.append(len(c.data)) or c for c in cut(*a, **k)))
            small = pa.Table.from_batches(list(runs[name](iter([batch]))))
            assert sizes and max(sizes) <= STAGE_BYTES + 300
            m.setattr(module, "chunks_of", lambda col, *_: cut(col, 1 << 30))
            assert small.equals(pa.Table.from_batches(list(runs[name](iter([batch])))).combine_chunks())


def test_odd_rows_pass_through_all_stages(spark, folder, tmp_path):
    """Null ids, null and empty texts, repeated rows, a text of 1 MB and columns with the operators' own names: clean rows arrive at the end."""
    long = " ".join(f"w{i}" for i in range(150_000))
    rows = [(None, "a row without an id", 1, "x", 0.5), (11, None, 1, "x", 0.5), (12, "", 1, "x", 0.5), (13, long, 1, "x", 0.5), (14, "twice the same row", 1, "x", 0.5), (14, "twice the same row", 1, "x", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int, component_id string, score double")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    near = corpus_pipeline.STAGES[1][1](spark, docs, str(tmp_path))
    assert near.columns == docs.columns
    out = sorted(((r.doc_id or 0), r.round_trip, r.n_tokens > 0) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert out == [(0, True, True), (11, True, False), (12, True, False), (13, True, True), (14, True, True), (14, True, True)]


def test_empty(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    n = out.count()
    assert 0 < n < 200 and out.where("not round_trip").count() == 0
