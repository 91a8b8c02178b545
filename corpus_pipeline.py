"""Corpus pipeline: toxicity, near duplicates, benchmark decontamination, secrets, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes
each stage's rows to the shared folder and reads them as the next one's documents.  All stages
but the last return the columns of documents.

Cases: null texts count as empty (not toxic, no duplicates, no benchmark words, no secrets, no
tokens); rows that share a doc_id go or stay together in the near-duplicate stage; a null doc_id
is kept; an empty table passes through; extra columns are carried to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.llm import bpe, decontaminate, minhash, secret_scan, toxicity
from corpusforge.llm.common import BATCH_CONF, STAGE_BYTES, read, shared_dir, stored

NEAR_WORDS, NEAR_PERCENT = 5, 80
#: Bytes of an Arrow batch in the stages: JVM and workers keep much of what their largest batch took, for all stages after.
BATCH_BYTES = 2 << 20


def bounded(spark: SparkSession) -> None:
    """Bound the batches of what the session plans from now on, unless it names a bound itself."""
    spark.conf.set(BATCH_CONF, spark.conf.get(BATCH_CONF, str(BATCH_BYTES)))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier rejects.  It is fitted on the labelled rows of the table itself."""
    bounded(spark)
    model = toxicity.fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return toxicity.reject(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of every group of near duplicates."""
    bounded(spark)
    found = minhash.near_duplicates(docs.select("doc_id", "text"), NEAR_WORDS, NEAR_PERCENT, STAGE_BYTES)
    return minhash.without(docs, found.where(~F.col("kept")).select("doc_id"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a window of a benchmark item."""
    bounded(spark)
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret in the texts by a mask."""
    bounded(spark)
    return secret_scan.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and whether decoding the ids gives the text again."""
    import public_tokenizers

    bounded(spark)
    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("secrets", redacted),
    ("tokens", tokens),
]

#: No SQL expresses the trained classifiers or the tokenizer; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), folder, name)
    return STAGES[-1][1](spark, docs, sf_dir)
