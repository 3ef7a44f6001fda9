"""Overlapping windows of a text: by characters and by sentences.

A window starts every max(1, size - overlap) and the last one is the first that reaches the end.  Everything is a column
expression over one row, so no shuffle is involved.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoweave.errors import ChunkingError
from ontoweave.functions.text import sentences


@dataclass(frozen=True)
class Chunking:
    """kind 'character' or 'semantic' (sentences)."""

    kind: str
    window: int
    overlap: int

    def __post_init__(self):
        if self.kind not in ("character", "semantic"):
            raise ChunkingError(f"unknown kind of chunking: {self.kind}")
        if self.window <= 0 or self.overlap < 0 or self.overlap >= self.window:
            raise ChunkingError("a window must be positive and larger than its overlap, which can't be negative")

    @property
    def step(self) -> int:
        return max(1, self.window - self.overlap)


def semantic(window: int = 5, overlap: int = 2) -> Chunking:
    return Chunking("semantic", window, overlap)


def character(window: int = 1000, overlap: int = 200) -> Chunking:
    return Chunking("character", window, overlap)


#: What the pipeline uses.
PIPELINE = semantic(3, 1)


def starts(n: Column, how: Chunking) -> Column:
    """First places (from 0) of the windows over n units; none for no units."""
    last = F.ceil(F.greatest(n - how.window, F.lit(0)) / how.step).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda k: k * how.step)).otherwise(F.array().cast("array<int>"))


def chunk_characters(docs: DataFrame, how: Chunking = character(), id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, idx, text, start_pos, end_pos (not included)."""
    n = F.length(text)
    rows = docs.select(id_column, F.col(text).alias("_text"), n.alias("_n"), F.posexplode(starts(n, how)).alias("idx", "start_pos"))
    return rows.select(id_column, "idx", F.substr("_text", F.col("start_pos") + 1, F.lit(how.window)).alias("text"), "start_pos", F.least(F.col("start_pos") + how.window, F.col("_n")).alias("end_pos"))


def chunk_sentences(docs: DataFrame, how: Chunking = semantic(), id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, idx, text, sent_start, sent_end (included)."""
    parted = docs.select(id_column, sentences(F.col(text)).alias("_s"))
    rows = parted.select(id_column, "_s", F.posexplode(starts(F.size("_s"), how)).alias("idx", "sent_start"))
    end = F.least(F.col("sent_start") + how.window, F.size("_s"))
    return rows.select(id_column, "idx", F.array_join(F.slice("_s", F.col("sent_start") + 1, end - F.col("sent_start")), " ").alias("text"), "sent_start", (end - 1).alias("sent_end"))


def chunk(docs: DataFrame, how: Chunking, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    return (chunk_characters if how.kind == "character" else chunk_sentences)(docs, how, id_column, text)


def batches(chunks: DataFrame, size: int) -> DataFrame:
    """chunks with batch_index: tumbling groups of size."""
    return chunks.withColumn("batch_index", F.floor(F.col("idx") / size).cast("int"))


def estimate_chunks(length: Column, how: Chunking) -> Column:
    """Estimated number of windows from the length in characters; a sentence counts as a hundred of them."""
    n = length if how.kind == "character" else F.greatest(F.lit(1), F.floor(length / 100))
    return F.when(n <= how.window, 1).otherwise(F.ceil((n - how.overlap) / how.step)).cast("long")


def coverage(chunks: DataFrame, *by: str) -> DataFrame:
    """total_chunks, avg_length (rounded), total_length."""
    n = F.length("text")
    return chunks.groupBy(*by).agg(F.count("*").alias("total_chunks"), F.round(F.avg(n)).cast("long").alias("avg_length"), F.sum(n).cast("long").alias("total_length"))
