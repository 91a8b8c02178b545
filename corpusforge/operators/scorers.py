"""Model stages behind small interfaces, with deterministic defaults.

A scorer rates (question, passage) pairs, an encoder turns texts into vectors, an extractor
turns a file's bytes into blocks.  Each is called on Arrow batches inside the executors; what is
loaded is kept for the life of a Python worker.  A scorer that is out of service returns null,
and the callers fall back (fused order, reranker's verdict).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .search import token_overlap

BLOCKS = "ordinal int, kind string, source string, text string, page int, ts_start double, ts_end double, section string"
BATCH = {"text": 64, "image": 8, "rerank": 100, "grade": 12}  # rows of one model call


class Scorer(Protocol):
    def score(self, questions: list[str], passages: list[str]) -> list[float | None]: ...


class Encoder(Protocol):
    dim: int

    def encode(self, texts: list[str]) -> list[list[float]]: ...


_loaded: dict[str, object] = {}


def loaded(name: str, make: Callable[[], object]) -> object:
    """The model of this name, made once a worker."""
    if name not in _loaded:
        _loaded[name] = make()
    return _loaded[name]


class HashEncoder:
    """Default encoder: signed hashed words, unit length."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def encode(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dim
            for w in (t or "").lower().split():
                h = hashlib.md5(w.encode(), usedforsecurity=False).digest()
                v[int.from_bytes(h[:4]) % self.dim] += 1.0 if h[4] >> 7 else -1.0
            n = sum(x * x for x in v) ** 0.5
            out.append([x / n for x in v] if n else v)
        return out


def encode(df: DataFrame, id_col: str, text_col: str, make: Callable[[], Encoder] = HashEncoder, name: str = "hash", batch: int = BATCH["text"]) -> DataFrame:
    """id, embedding of every row, `batch` texts a call."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = loaded(name, make)
        for p in parts:
            vectors = [v for k in range(0, len(p), batch) for v in model.encode(p["t"].iloc[k : k + batch].tolist())]
            yield pd.DataFrame({"k": p["k"], "embedding": vectors})

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).mapInPandas(run, f"k {kind}, embedding array<double>").withColumnRenamed("k", id_col)


def scored(pairs: DataFrame, question: str, passage: str, make: Callable[[], Scorer] | None = None, name: str = "scorer", cut: int = 2000) -> DataFrame:
    """pairs with rerank_score: token overlap by default (JVM side), else the scorer's answer on passages of at most `cut` characters; a blank passage counts as one space."""
    text = F.coalesce(F.nullif(F.substring(passage, 1, cut), F.lit("")), F.lit(" "))
    if make is None:
        return pairs.withColumn("rerank_score", F.round(token_overlap(F.col(question), text), 6))

    @F.pandas_udf("double")
    def rate(q: pd.Series, t: pd.Series) -> pd.Series:
        model, out = loaded(name, make), []
        for k in range(0, len(q), BATCH["rerank"]):
            try:
                out += model.score(q.iloc[k : k + BATCH["rerank"]].tolist(), t.iloc[k : k + BATCH["rerank"]].tolist())
            except (ConnectionError, TimeoutError):  # out of service: no verdict
                out += [None] * len(q.iloc[k : k + BATCH["rerank"]])
        return pd.Series(out, dtype="float64")

    return pairs.withColumn("rerank_score", rate(F.col(question), text))


def extracted(files: DataFrame, extractors: dict[str, Callable[[bytes], list[tuple]]]) -> DataFrame:
    """path and BLOCKS of files (path, content, extractor): each by the extractor that its route names; routes without one give no blocks."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", *[x.split()[0] for x in BLOCKS.split(", ")]]
        for p in parts:
            rows = [(path, *block) for path, content, route in zip(p["path"], p["content"], p["extractor"], strict=True) if route in extractors for block in extractors[route](bytes(content))]
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content", "extractor").mapInPandas(run, f"path string, {BLOCKS}")


def text_blocks(content: bytes) -> list[tuple]:
    """Default text extractor: one block, undecodable bytes replaced."""
    return [(0, "text", "text", content.decode("utf-8", "replace"), None, None, None, None)]


def supported_by(claim: Column, passage: Column) -> Column:
    return token_overlap(claim, passage)
