"""Stateful streams: the entity registry of a run, and event-time windows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ontoweave.operators.closure import shared_folder


def _drain(stream: DataFrame, mode: str) -> DataFrame:
    """What a finite stream ends with: the tables of its micro-batches (in complete mode the last one), in the shared folder."""
    spark = stream.sparkSession
    where = f"{shared_folder(spark)}/drained-{uuid.uuid4().hex}"

    def store(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/rows/epoch={epoch}")

    query = stream.writeStream.outputMode(mode).foreachBatch(store).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.lastProgress is None:
        return spark.createDataFrame([], stream.schema)
    last = query.lastProgress["batchId"]
    rows = f"{where}/rows/epoch={last}" if mode == "complete" else f"{where}/rows"
    return spark.read.schema(stream.schema).parquet(rows).select(*stream.columns)


def source(spark: SparkSession, path: str) -> DataFrame:
    """A stream of a Parquet file or folder."""
    folder, _, name = path.rpartition("/")
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name if name.endswith(".parquet") else "*").parquet(folder if name.endswith(".parquet") else path)


def windowed_events(spark: SparkSession, path: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, event_type, n, total of tumbling event-time windows; later rows than the watermark allows are not counted in a closed
    window."""
    events = source(spark, path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = events.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return _drain(out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total"), "complete")


def _remember(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, n = state.get if state.exists else (-1, 0)
    for batch in batches:
        last, n = max(last, int(batch["seq"].max())), n + len(batch)
    state.update((last, n))
    yield pd.DataFrame([(*key, last, n)], columns=["run_id", "norm_label", "last_seq", "n"])


def registry_of_stream(spark: SparkSession, path: str) -> DataFrame:
    """run_id, norm_label, last_seq, n: the registry after a stream of mentions, with state kept for each run and label."""
    rows = source(spark, path).select(F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("norm_label"), F.col("event_id").alias("seq"))
    out = rows.groupBy("run_id", "norm_label").applyInPandasWithState(_remember, "run_id string, norm_label string, last_seq long, n long", "last long, n long", "update", GroupStateTimeout.NoTimeout)
    drained = _drain(out, "update")
    return drained.groupBy("run_id", "norm_label").agg(F.max("last_seq").alias("last_seq"), F.max("n").alias("n"))
