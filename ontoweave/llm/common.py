"""Shared pieces of the training-data operators: the shared folder, written tables, and byte-level word access."""

from __future__ import annotations

import tempfile
import threading
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id inside an operator: after every real id.
NO_ID = (1 << 63) - 1
#: Text bytes that one step of a numpy kernel looks at; a single longer text is one step.
STEP_BYTES = 1 << 20

#: Paths that a thread has handed out, so that concurrent runs keep theirs apart.
_state = threading.local()


def _written() -> list[str]:
    if not hasattr(_state, "written"):
        _state.written = []
    return _state.written


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset (tests, local mode only) a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ontoweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written().append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, lineage cut, readable after any executor is lost."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """How many paths were handed out so far, for since()."""
    return len(_written())


def since(before: int) -> list[str]:
    return _written()[before:]


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables (and empty the list); only for callers whose own output is already stored."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)


#: What a worker remembers for one operator, and lets go when it goes on to another.
remembered: list[dict] = []


def forget() -> None:
    for x in remembered:
        x.clear()


def text_bytes(df: DataFrame, column: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def in_batches(df: DataFrame, least: int = 2 << 20, most: int = 64 << 20, column: str = "text") -> DataFrame:
    """Adds int column b: an even deal of rows by id into batches of 2 to 64 MB of text, growing with the table."""
    total = text_bytes(df, column)
    n = max(1, -(-total // min(most, max(least, total // 1024))))
    return df.withColumn("b", F.pmod(F.xxhash64("doc_id", column), F.lit(n)).cast("int"))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, one more than rows) and bytes of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column, "") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    bufs = column.buffers()
    offsets = np.frombuffer(bufs[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def steps(offsets: np.ndarray, size: int = STEP_BYTES):
    """Row ranges of about size bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes outside a word of letters, digits and anything beyond ASCII.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
LOWER_BYTES = LOWER.tobytes()


def word_spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE):
    """(first word of each row, starts, ends) of the words in the rows of data; offsets start at 0."""
    inside = ~gap[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = inside[ends]
    starts = np.flatnonzero(first)
    return np.searchsorted(starts, offsets), starts, np.flatnonzero(last) + 1


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word of data: its bytes by eights, each mixed into the hash so far."""
    size = ends - starts
    h = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (seed + 1) % (1 << 64)))
    if not len(starts):
        return h
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))  # the eight bytes at every place
    active, done = np.arange(len(starts)), 0
    while len(active):
        left = size[active] - done
        chunk = eights[starts[active] + done]
        short = left < 8
        if short.any():
            chunk = np.where(short, chunk & ((np.uint64(1) << (np.uint64(8) * np.minimum(left, 7).astype(np.uint64))) - np.uint64(1)), chunk)
        h[active] = mix(h[active] * np.uint64(0xD6E8FEB86659FD93) + chunk)
        done += 8
        active = active[left > 8]
    return h


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of size words (hashes), by doubling."""

    def joined(a, b):
        return mix(a * np.uint64(0xA0761D6478BD642F) + (b ^ (b >> np.uint64(31))) * np.uint64(0xE7037ED1A0B428DB))

    if len(words) < size:
        return np.zeros(0, np.uint64)
    out, have, power, n = None, 0, words, 1
    while True:
        if size & n:
            if out is None:
                out = power
            else:
                k = len(words) - have - n + 1
                out = joined(out[:k], power[have : have + k])
            have += n
        if have == size:
            return out[: len(words) - size + 1]
        power, n = joined(power[:-n], power[n:]), 2 * n


def whole_runs(batches, key: str):
    """Tables that end with whole runs of equal keys; the rest is carried on."""
    rest: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        x, table = batch.column(key).to_numpy(), pa.Table.from_batches([batch])
        other = np.flatnonzero(x != x[-1])
        if len(other):
            cut = int(other[-1]) + 1
            yield pa.concat_tables([*rest, table.slice(0, cut)])
            rest, table = [], table.slice(cut)
        elif rest and rest[-1].column(key)[-1].as_py() != x[-1]:
            yield pa.concat_tables(rest)
            rest = []
        rest.append(table)
    if rest:
        yield pa.concat_tables(rest)


def crc32_column(name: str):
    return F.crc32(F.col(name).cast("string").cast("binary"))
