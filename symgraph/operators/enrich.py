"""Summaries and embeddings of symbols, by exchangeable models that run on the executors."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType

from symgraph.functions.text import chunk_id, embed_chunks, embed_header, normalize_content, parse_reply


class Enricher(Protocol):
    def reply(self, symbol: str, language: str, code: str) -> str:
        """A JSON object with summary, tags, responsibilities and business_context, or plain text."""


class Embedder(Protocol):
    def embed(self, texts: Sequence[str]) -> Sequence[Sequence[float]]:
        """One vector for each text, in order."""


class RateLimited(RuntimeError):
    """A model refuses for now."""


class Fallback:
    """Tries models in turn; a rate limit of all is told apart from other failures."""

    def __init__(self, *models: Enricher):
        self.models = models

    def reply(self, symbol: str, language: str, code: str) -> str:
        limited, last = 0, None
        for model in self.models:
            try:
                return model.reply(symbol, language, code)
            except RateLimited:
                limited += 1
            except Exception as error:  # the next model may do
                last = error
        if limited == len(self.models):
            raise RateLimited("all models are rate-limited")
        raise RuntimeError("no model replied") from last


class FirstLine:
    """Offline enricher: the first comment or line of the code is the summary."""

    def reply(self, symbol: str, language: str, code: str) -> str:
        line = next((x.strip(" \t#/*\"'") for x in code.splitlines() if x.strip(" \t#/*\"'")), "")
        return line or symbol


class HashedWords:
    """Offline embedder: signed hashed counts of identifier parts, of unit length."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.size))
        for row, text in enumerate(texts):
            for word in re.findall(r"[A-Z]?[a-z]+|[A-Z]+|\d+", text):
                h = int.from_bytes(hashlib.blake2b(word.lower().encode(), digest_size=8).digest(), "little")
                out[row, h % self.size] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm > 0, norm, 1)).tolist()


def summarise(symbols: DataFrame, enricher: Enricher) -> DataFrame:
    """``symbols`` with summary, tags, responsibilities and business_context; a failure leaves them empty and says why in ``error``."""
    names = symbols.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            replies, errors = [], []
            for symbol, language, code in zip(*(batch.column(names.index(c)).to_pylist() for c in ("symbol", "language", "content")), strict=True):
                try:
                    replies.append(enricher.reply(symbol or "", language or "", code or ""))
                    errors.append(None)
                except Exception as error:  # a symbol without a summary is still indexed
                    replies.append("")
                    errors.append(f"{type(error).__name__}: {error}")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(replies, pa.string()), pa.array(errors, pa.string())], names=[*names, "_reply", "error"])

    schema = StructType([*symbols.schema.fields, StructField("_reply", StringType()), StructField("error", StringType())])
    parsed = symbols.mapInArrow(run, schema).withColumn("_reply", parse_reply(F.col("_reply")))
    return parsed.select(*names, "_reply.*", "error")


def embed(chunks: DataFrame, embedder: Embedder, text: str = "text", batch_size: int = 20) -> DataFrame:
    """``chunks`` with ``embedding``; the first failure fails the task, which Spark retries."""
    names = chunks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(names.index(text)).to_pylist()
            vectors = [v for i in range(0, len(texts), batch_size) for v in embedder.embed(texts[i : i + batch_size])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*names, "embedding"])

    return chunks.mapInArrow(run, StructType([*chunks.schema.fields, StructField("embedding", ArrayType(FloatType()))]))


def points_of(symbols: DataFrame, enricher: Enricher, embedder: Embedder, budget: int) -> DataFrame:
    """Points of ``symbols``: summarised, cut into chunks, embedded."""
    told = summarise(symbols, enricher)
    header = embed_header(*(F.col(c) for c in ("symbol", "type", "language", "summary", "business_context", "responsibilities", "calls", "tags")))
    cut = told.withColumn("_chunks", embed_chunks(header, normalize_content(F.col("content")), budget))
    rows = cut.select("*", F.size("_chunks").alias("chunk_count"), F.posexplode("_chunks").alias("chunk_number", "_chunk"))
    rows = rows.withColumn("content", F.col("_chunk.content")).withColumn("text", F.col("_chunk.text")).drop("_chunks", "_chunk")
    rows = rows.withColumn("chunk_id", chunk_id(F.col("branch"), F.col("symbol"), F.col("chunk_number")))
    return embed(rows, embedder).drop("text").withColumnRenamed("file", "file_path")
