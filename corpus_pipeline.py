"""A corpus pipeline: toxicity, line dedup, near-dedup, benchmark decontamination, packing.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession

from ontoweave.llm import common
from ontoweave.llm.decontaminate import decontaminate
from ontoweave.llm.line_dedup import without_repeats
from ontoweave.llm.near_duplicates import keep_one
from ontoweave.llm.packing import pack
from ontoweave.llm.queries import tokenizer_path
from ontoweave.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeats of line runs; one that consists of repeats is gone."""
    return without_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of documents that share 0.8 of their five-word shingles: the SimHash index, then verification."""
    return keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    return pack(docs, tokenizer_path())


def _stage(function):
    """Deletes what the stage before wrote on its way, whose result is stored by now."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = _left.__dict__.setdefault("paths", [])
        common.release(spark, left)
        before = common.mark()
        out = function(spark, docs, sf_dir)
        left.extend(common.since(before))
        return out

    return run


#: What the last stage of a thread wrote on its way.
_left = threading.local()
STAGES = [(f.__name__, _stage(f)) for f in (toxicity, lines, near_duplicates, benchmark, packing)]

#: The classifier and the tokenizer have no SQL; tests hold run() against a version in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is stored, and those of earlier stages are deleted at the end."""
    docs, stored = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        result = stage(spark, docs, sf_dir)
        before = common.mark()
        docs = common.written(result, f"stage-{name}")
        stored += common.since(before)
    common.release(spark, [*stored[:-1], *_left.paths])
    _left.paths.clear()
    return docs
