"""Runs, checkpoints and artifacts as append-only tables, and a resumable batch workflow on Structured Streaming.

A run's state is the event of the highest version; a batch is a partition (run_id, batch_index) that a retry overwrites, so a
restart repeats nothing and doubles nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoweave.errors import CheckpointError, RunError

MOST_TEXT = 10 << 20
EVENT = "run_id string, status string, status_version int, ontology_hash string, total_batches int, batches_completed int, window_size int, overlap int, batch_size int, final_hash string, error_message string, at timestamp"
STATES = ("queued", "running", "completed", "failed")


def latest(log: DataFrame) -> DataFrame:
    """The current state of each run."""
    rest = [c for c in log.columns if c not in ("run_id", "status_version")]
    return log.groupBy("run_id").agg(F.max(F.struct("status_version", *rest)).alias("e")).select("run_id", "e.*").select(*log.columns)


def last_checkpoints(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.groupBy("run_id").agg(F.max("batch_index").alias("batch_index"))


def dedupe_batches(batches: DataFrame) -> DataFrame:
    """hash, batch_index, content: equal contents once, at their first batch."""
    return batches.groupBy(F.sha2(F.col("content").cast("binary"), 256).alias("hash")).agg(F.min_by(F.struct("batch_index", "content"), "batch_index").alias("b")).select("hash", "b.batch_index", "b.content")


def content_hash(df: DataFrame) -> str:
    """A hash of a table's rows, whatever their order: sums of the parts of the rows' hashes, so that no task holds them all."""
    import hashlib

    row = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    parts = [F.sum(F.conv(F.substring("h", 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")).alias(f"p{k}") for k in range(8)]
    sums = df.select(row.alias("h")).agg(F.count("*").alias("n"), *parts).first()
    return hashlib.sha256("|".join(str(x or 0) for x in sums).encode()).hexdigest()


def ontology_hash(ontology) -> str:
    """A hash over all of an ontology's tables."""
    import hashlib

    parts = (ontology.classes, ontology.class_edges, ontology.class_props, ontology.universal_props, ontology.disjoint, ontology.prop_edges)
    return hashlib.sha256("".join(content_hash(p) for p in parts).encode()).hexdigest()


@dataclass
class Runs:
    """A run log in a folder that all executors share."""

    spark: SparkSession
    folder: str

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def log(self) -> DataFrame:
        try:
            return self.spark.read.schema(EVENT).parquet(self._path("runs"))
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], EVENT)
            raise

    def state(self, run_id: str):
        return latest(self.log().where(F.col("run_id") == run_id)).first()

    def _append(self, **event) -> None:
        row = self.spark.createDataFrame([(event.get("run_id"), event.get("status"), event.get("status_version"), *(event.get(k) for k in ("ontology_hash", "total_batches", "batches_completed", "window_size", "overlap", "batch_size", "final_hash", "error_message")))], EVENT.rpartition(",")[0])
        row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(self._path("runs"))

    def create(self, text: str, ontology_hash: str, run_id: str | None = None, **params) -> str:
        if len(text) > MOST_TEXT:
            raise RunError(f"the text has more than {MOST_TEXT} characters")
        run_id = run_id or uuid.uuid4().hex
        if self.state(run_id):
            raise RunError(f"run {run_id} is there already")
        self.save_artifact(run_id, "input_text", text)
        self._append(run_id=run_id, status="queued", status_version=0, ontology_hash=ontology_hash, batches_completed=0, **params)
        return run_id

    def update(self, run_id: str, expected_version: int | None = None, **change):
        """Append a changed state; with an expected version only if that is the current one."""
        now = self.state(run_id)
        if now is None:
            raise RunError(f"no run {run_id}")
        if expected_version is not None and now.status_version != expected_version:
            raise RunError(f"run {run_id} is at version {now.status_version}, not {expected_version}")
        if change.get("status", now.status) not in STATES:
            raise RunError(f"unknown state {change['status']}")
        if not self._claim(run_id, now.status_version + 1):
            raise RunError(f"run {run_id} was changed by another writer")
        event = {k: v for k, v in now.asDict().items() if k != "at"} | change | {"status_version": now.status_version + 1}
        self._append(**event)
        return event["status_version"]

    def _claim(self, run_id: str, version: int) -> bool:
        """Whether this writer is the first for a version: its file is created only if it is not there."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self._path('versions')}/{run_id}/{version}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).createNewFile(path)

    def save_artifact(self, run_id: str, key: str, content: str) -> str:
        row = self.spark.createDataFrame([(run_id, key, content)], "run_id string, key string, content string").withColumn("hash", F.sha2(F.col("content").cast("binary"), 256))
        _overwrite(row, self._path("artifacts"), "run_id", "key")
        return row.first().hash

    def artifact(self, run_id: str, key: str) -> str | None:
        row = self.spark.read.parquet(self._path("artifacts")).where((F.col("run_id") == run_id) & (F.col("key") == key)).select("content").first()
        return row and row.content

    def delete_artifacts(self, run_id: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self._path('artifacts')}/run_id={run_id}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def save_batch(self, run_id: str, batch_index: int, quads: DataFrame) -> None:
        rows = quads.drop("run_id", "batch_index").withColumns({"run_id": F.lit(run_id), "batch_index": F.lit(batch_index)})
        _overwrite(rows, self._path("batches"), "run_id", "batch_index")

    def batch(self, run_id: str, batch_index: int) -> DataFrame:
        """A stored batch: the partition is its checkpoint, there in whole or not at all for completed_batches."""
        return self.batches(run_id).where(F.col("batch_index") == batch_index)

    def batches(self, run_id: str) -> DataFrame:
        return self.spark.read.parquet(self._path("batches")).where(F.col("run_id") == run_id)

    def completed_batches(self, run_id: str) -> list[int]:
        try:
            return [r.batch_index for r in self.batches(run_id).select("batch_index").distinct().orderBy("batch_index").collect()]
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise

    def merge(self, run_id: str, expected: int) -> DataFrame:
        """All batches' quads resolved as one graph; an error unless all are there."""
        from ontoweave.operators.resolve import merge_graphs

        found = self.completed_batches(run_id)
        if not found or found != list(range(expected)):
            raise CheckpointError(f"run {run_id} has batches {found} of {expected}")
        rows = self.batches(run_id).drop("run_id")
        # blank nodes are named by batch and graph, so equal graph names of two batches stay apart
        graph = F.concat_ws("_", F.col("batch_index").cast("string"), F.col("graph_id").cast("string"))
        return merge_graphs(rows.withColumn("graph_id", graph).drop("batch_index"))

    def run(self, run_id: str, chunks: DataFrame, process: Callable[[DataFrame], DataFrame], batch_size: int = 10) -> DataFrame:
        """Process chunks (idx, text) batch by batch, from where an earlier attempt ended; the resolved graph.

        process takes the chunks of a batch and returns quads.
        """
        state = self.state(run_id)
        if state.status == "failed":
            raise RunError(f"run {run_id} has failed: {state.error_message}")
        total = (chunks.count() + batch_size - 1) // batch_size
        done = set(self.completed_batches(run_id))
        if state.status != "completed":
            self.update(run_id, status="running", total_batches=total, batch_size=batch_size)
        try:
            for k in range(total):
                if k not in done:
                    mine = chunks.where((F.col("idx") >= k * batch_size) & (F.col("idx") < (k + 1) * batch_size))
                    self.save_batch(run_id, k, process(mine))
                    self.update(run_id, batches_completed=k + 1)
            merged = self.merge(run_id, total) if total else None
        except Exception as e:
            self.update(run_id, status="failed", error_message=str(e)[:500])
            raise
        if state.status != "completed":
            self.update(run_id, status="completed", final_hash=content_hash(merged) if merged is not None else None)
        return merged


def _overwrite(rows: DataFrame, path: str, *by: str) -> None:
    """Only the partitions that rows hold are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def stream_batches(chunks: DataFrame, run_id: str, runs: Runs, process: Callable[[DataFrame], DataFrame], checkpoint: str):
    """A streaming query over a streaming DataFrame of chunks: each micro-batch is one batch of the run.  A restart goes on at the
    batch that was not committed, which overwrites its partition."""
    def one(batch: DataFrame, epoch: int) -> None:
        runs.save_batch(run_id, epoch, process(batch))

    return chunks.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
