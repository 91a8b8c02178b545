"""Sources: driver tables, MIME routing, delimited files, JSONL datasets, whole text files."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

DATASET_SCHEMA = "id string, question string, relevantDocuments array<string>, relevantPages array<int>, expectAnswerContains array<string>, unanswerable boolean, modality string, note string"
#: Tables with long texts.
TEXTS = ("documents", "pages")
MODALITIES = ("text", "pdf", "image", "audio", "video")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table.  One of few splits is dealt to all cores where its rows are costly to work on."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in TEXTS and df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def modality_of(mime: Column) -> Column:
    """Modality of a MIME type, null if unknown; the first rule that fits wins."""
    m = F.lower(F.trim(F.substring_index(mime, ";", 1)))
    return (
        F.when(m == "application/pdf", "pdf")
        .when(m.startswith("image/"), "image")
        .when(m.startswith("audio/"), "audio")
        .when(m.startswith("video/"), "video")
        .when(m.startswith("text/") | m.isin("application/json", "application/xml", "application/x-ndjson", "message/rfc822") | m.contains("officedocument") | m.isin("application/msword", "application/vnd.ms-excel", "application/vnd.ms-powerpoint"), "text")
    )


def extractor_of(mime: Column) -> Column:
    """Route of the extraction dispatcher."""
    m = F.lower(mime)
    return (
        F.when(m.contains("pdf"), "pdf").when(m.startswith("image/"), "image").when(m.startswith("audio/"), "audio").when(m.startswith("video/"), "video")
        .when(m.isin("text/csv", "text/tab-separated-values"), "table").when(m.contains("wordprocessingml"), "docx").when(m.contains("presentationml"), "pptx").when(m.contains("spreadsheetml"), "xlsx")
        .when(m.startswith("text/") | m.contains("json") | m.contains("xml"), "text").otherwise("unresolved")
    )


def sniff_delimiter(sample: str) -> str:
    """Delimiter of a table's first characters, comma if none is clear."""
    try:
        return csv.Sniffer().sniff(sample[:4096], delimiters=",;\t|").delimiter
    except csv.Error:
        return ","


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: path, text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """A delimited file with a header; the delimiter is taken from its beginning."""
    head = "\n".join(r.value for r in spark.read.text(path).limit(20).collect())
    return spark.read.option("header", True).option("sep", sniff_delimiter(head)).option("multiLine", True).csv(path)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Labelled questions, one JSON object a line; blank lines and // comments are skipped.

    Raises on malformed lines, missing fields, repeated ids, labels that contradict
    `unanswerable`, and an empty file.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' and not startswith(line, '//')")
    rows = lines.select("line", F.from_json("line", DATASET_SCHEMA + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r")).select("line", "r.*")
    empty = F.array().cast("array<string>")
    rows = rows.withColumns({"relevantDocuments": F.coalesce("relevantDocuments", empty), "relevantPages": F.coalesce("relevantPages", F.array().cast("array<int>")), "expectAnswerContains": F.coalesce("expectAnswerContains", empty), "unanswerable": F.coalesce("unanswerable", F.lit(False))})
    wrong = F.col("_bad").isNotNull() | F.coalesce(F.col("id") == "", F.lit(True)) | F.coalesce(F.col("question") == "", F.lit(True)) | ((F.size("relevantDocuments") == 0) != F.col("unanswerable")) | F.coalesce(~F.col("modality").isin(*MODALITIES), F.lit(False)) | F.exists("relevantPages", lambda p: p <= 0)
    facts = rows.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count_if(wrong).alias("wrong")).first()
    if not facts.n:
        raise ValueError("the dataset is empty")
    if facts.wrong or facts.ids != facts.n:
        raise ValueError(f"the dataset has {facts.wrong} invalid lines and {facts.n - facts.ids} repeated ids")
    return rows.drop("line", "_bad")


def mail_text(sender: Column, to: Column, cc: Column, date: Column, subject: Column, text: Column, html_text: Column) -> Column:
    """Header lines, a blank line, then the body (plain text, else the text of the HTML)."""
    line = lambda name, x: F.when(F.trim(x) != "", F.concat(F.lit(f"{name}: "), x))
    head = F.concat_ws("\n", line("From", sender), line("To", to), line("Cc", cc), line("Date", date), line("Subject", subject))
    body = F.coalesce(F.when(F.trim(text) != "", F.trim(text)), F.trim(html_text), F.lit(""))
    return F.concat(head, F.lit("\n\n"), body)


def keyframes(media: DataFrame, every: int = 30, most: int = 200) -> DataFrame:
    """media (id, duration) -> id, start, end of each frame; frames at or past the end are left out."""
    times = media.select("id", "duration", F.explode(F.sequence(F.lit(0), F.floor("duration").cast("int"), F.lit(every))).alias("start"))
    return times.where(f"start < duration and start < {every * most}").select("id", "start", F.least(F.col("start") + every, F.col("duration")).alias("end"))


def audio_pieces(media: DataFrame, piece: int = 1200) -> DataFrame:
    """media (id, duration) -> id, piece, offset, length: pieces of at most `piece` seconds."""
    parts = media.select("id", "duration", F.posexplode(F.sequence(F.lit(0), F.floor("duration").cast("int"), F.lit(piece))).alias("piece", "offset"))
    return parts.where("offset < duration").select("id", "piece", "offset", F.least(F.lit(piece), F.col("duration") - F.col("offset")).alias("length"))


def segment_blocks(segments: DataFrame) -> DataFrame:
    """segments (path, start, end, text) of recognised speech -> path, ordinal, kind, source, text, ts_start, ts_end: a block each, never merged, since citations seek to its span; blank ones are left out."""
    from pyspark.sql import Window

    said = segments.withColumn("text", F.trim("text")).where("text <> ''")
    n = F.row_number().over(Window.partitionBy("path").orderBy("start", "end"))
    return said.select("path", (n - 1).cast("int").alias("ordinal"), F.lit("text").alias("kind"), F.lit("asr").alias("source"), "text", F.col("start").alias("ts_start"), F.col("end").alias("ts_end"))
