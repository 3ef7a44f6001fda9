"""Token-id shards with a minimal perfect hash index.

A shard is one file: raw ids in ascending order of documents, then the index, then a footer with the places of both.  The
index maps a document id to its slot by levels of bitmaps (a key is placed on the first level where it is alone on its bit, and
its slot is the number of set bits before, so that n keys fill n slots); a slot holds a fingerprint of its key, the payload offset and the length.  A lookup hashes the key, reads one
slot and compares the fingerprint: constant time, over payload that is never parsed.

Shards are written by tasks to the shared folder (any file system pyarrow opens by URI) under names of their own attempt; the
manifest, a written table, names the files of the attempts that succeeded, so a lost executor's half-written file is never
read.  Rows are dealt by ranges of ids, then of a hash of the text and of the row's place, so that a null or repeated id of a third
of all rows is many shards.

Nulls: a null text is empty; null ids come after all others, are kept in the shard's order but have no key.  Of rows that
repeat an id the first shard's index finds the first; the shards' order has them all.  An empty table has no shards; other columns
are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, mix, new_path, text_bytes, written
from .tokens import encoded_steps

MAGIC = b"TOKSHRD1"
#: Bits of a level for each key left.
GAMMA = 2
#: Shards of a block of the manifest.
BLOCK = 1024


def _hash(keys: np.ndarray, seed) -> np.ndarray:
    return mix(keys.astype(np.int64).view(np.uint64) ^ mix(np.atleast_1d(np.asarray(seed, np.uint64)) + np.uint64(0x9E3779B97F4A7C15)))


def build_mph(keys: np.ndarray) -> dict[str, np.ndarray]:
    """A minimal perfect hash of distinct keys as levels of bitmaps.

    A level has about two bits for each key that is left; keys alone on a bit are placed there, the others go on to the next
    level.  A key's slot is the number of set bits before its own.
    """
    left, sizes, maps, level = keys, [], [], 0
    while len(left):
        m = -(-max(64, GAMMA * len(left)) // 8) * 8
        at = (_hash(left, level) % np.uint64(m)).astype(np.int64)
        alone = np.bincount(at, minlength=m) == 1
        sizes.append(m)
        maps.append(np.packbits(alone, bitorder="little"))
        left, level = left[~alone[at]], level + 1
    bits = np.concatenate([*maps, np.zeros(0, np.uint8)])
    ranks = np.cumsum(np.bitwise_count(bits), dtype=np.int64) - np.bitwise_count(bits)
    return {"sizes": np.array(sizes, "<i8"), "bits": bits, "ranks": ranks.astype("<i4")}


def mph_slots(keys: np.ndarray, mph: dict[str, np.ndarray]) -> np.ndarray:
    """The slot of each key; some slot, or 0, for keys that are not in the hash."""
    slots, left, first = np.zeros(len(keys), np.int64), np.arange(len(keys)), 0
    for level, m in enumerate(mph["sizes"].tolist()):
        at = (_hash(keys[left], level) % np.uint64(m)).astype(np.int64)
        byte, bit = first + at // 8, (at % 8).astype(np.uint8)
        there = (mph["bits"][byte] >> bit) & 1 == 1
        below = np.bitwise_count(mph["bits"][byte] & ((np.uint8(1) << bit) - np.uint8(1)))
        slots[left[there]] = (mph["ranks"][byte] + below)[there]
        left, first = left[~there], first + m // 8
        if not len(left):
            break
    return slots


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_hash(keys, 1 << 40) >> np.uint64(32)).astype(np.uint32)


class Shard:
    """A shard opened for reading: the index is in memory, payload is read as asked for."""

    def __init__(self, path: str):
        system, where = fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(where)
        size = self.file.size()
        at, n = struct.unpack("<QI", self.file.read_at(12, size - 20))
        if self.file.read_at(8, size - 8) != MAGIC:
            raise ValueError(f"{path} is no shard")
        head, body = (x := self.file.read_at(size - 20 - at, at))[:n], x[n:]
        self.meta = json.loads(head)
        self.width, self.n, k = np.dtype(self.meta["dtype"]), self.meta["keys"], 0
        self.index = {}
        for name, kind, length in self.meta["arrays"]:
            kind = np.dtype(kind)
            self.index[name] = np.frombuffer(body, kind, length, k)
            k += kind.itemsize * length

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, offset, length) in ids of each key; a key that is not in the shard is not found but for a chance of 2**-32."""
        slots = mph_slots(keys, self.index)
        if not self.n:
            return np.zeros(len(keys), bool), slots, slots
        return self.index["print"][slots] == fingerprints(keys), self.index["offset"][slots], self.index["length"][slots]

    def read(self, offset: int, length: int) -> np.ndarray:
        w = self.width.itemsize
        return np.frombuffer(self.file.read_at(int(length) * w, int(offset) * w), self.width)

    def get(self, key: int) -> np.ndarray | None:
        found, offset, length = self.find(np.array([key], np.int64))
        return self.read(offset[0], length[0]) if found[0] else None


MANIFEST = "shard int, path string, n_docs long, n_tokens long, first_id long, last_id long"


def _write(folder: str, tokenizer: str, end: int, wide: bool):
    def run(batches):
        from pyspark import TaskContext

        shard, width = TaskContext.get().partitionId(), np.dtype("<u4" if wide else "<u2")
        path = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.tok"
        system, where = fs.FileSystem.from_uri(path)
        ids_of, lengths, out = [], [], None
        for batch in batches:
            if out is None and batch.num_rows:
                system.create_dir(where.rpartition("/")[0], recursive=True)
                out = system.open_output_stream(where)
            ids_of.append(batch.column("id").to_numpy())
            for _, _, ends, ids in encoded_steps(batch, tokenizer, end):
                if not wide and len(ids) and int(ids.max()) >= 1 << 16:
                    raise ValueError(f"id {int(ids.max())} takes over 16 bits: write wide shards")
                out.write(ids.astype(width).tobytes())
                lengths.append(np.diff(ends))
        if out is None:
            return
        ids, lengths = np.concatenate(ids_of), np.concatenate(lengths).astype(np.int64)
        offsets = np.cumsum(lengths) - lengths
        keys, first = np.unique(ids[ids != NO_ID], return_index=True)
        mph = build_mph(keys)
        slots = mph_slots(keys, mph)
        n = len(keys)
        order = np.empty(n, np.int64)
        order[slots] = first
        arrays = {**mph, "print": fingerprints(ids[order]).astype("<u4"), "offset": offsets[order].astype("<i8"), "length": lengths[order].astype("<i8"), "ids": ids.astype("<i8"), "lengths": lengths.astype("<i8")}
        head = json.dumps({"dtype": width.str, "keys": n, "arrays": [(k, v.dtype.str, len(v)) for k, v in arrays.items()]}).encode()
        out.write(head)
        for x in arrays.values():
            out.write(x.tobytes())
        total = int(lengths.sum())
        out.write(struct.pack("<QI", total * width.itemsize, len(head)) + MAGIC)
        out.close()
        yield pa.record_batch({"shard": pa.array([shard], pa.int32()), "path": [path], "n_docs": [len(ids)], "n_tokens": [total], "first_id": [int(ids.min())], "last_id": [int(ids.max())]})

    return run


def write_token_shards(docs: DataFrame, tokenizer: str, end: int = 0, shard_bytes: int = 64 << 20, folder: str | None = None, wide: bool = False) -> DataFrame:
    """Writes shards in ascending order of doc_id; returns the manifest (a written table).

    ids are 16 bits each unless ``wide`` (vocabularies of more than 65,536 ids; without it such an id is an error).
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.col("text").cast("string").alias("text"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes(docs) // shard_bytes))
    folder = folder or new_path(spark, "token-shards")
    order = ["id", "__h", "__row"]
    docs = docs.withColumns({"__h": F.xxhash64("text"), "__row": F.monotonically_increasing_id()})
    dealt = docs.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("__h", "__row")
    return written(dealt.mapInArrow(_write(folder, tokenizer, end, wide), MANIFEST), "token-manifest")


def _read(batches):
    for batch in batches:
        for row in batch.to_pylist():
            shard = Shard(row["path"])
            ids, lengths = shard.index["ids"], shard.index["lengths"]
            offset = np.cumsum(lengths) - lengths
            found, at, size = shard.find(ids)
            first = np.append(True, ids[1:] != ids[:-1]) & (ids != NO_ID)
            if not (found[first].all() and np.array_equal(at[first], offset[first]) and np.array_equal(size[first], lengths[first])):
                raise ValueError(f"{row['path']}: the index does not lead to its documents")
            for i in range(0, len(ids), 1024):
                j = min(len(ids), i + 1024)
                n = lengths[i:j]
                # documents that the index finds one after the other are one read
                raw = memoryview(shard.read(offset[i], int(n.sum())).astype("<u4").tobytes())
                ends = 4 * np.cumsum(n)
                yield pa.record_batch({
                    "doc_id": pa.array(ids[i:j], mask=ids[i:j] == NO_ID),
                    "start": pa.array(offset[i:j] + row["start"]),
                    "n_tokens": pa.array(n.astype(np.int64)),
                    "ids_crc32": pa.array([zlib.crc32(raw[a:z]) for a, z in zip((ends - 4 * n).tolist(), ends.tolist(), strict=True)], pa.int64()),
                })


def read_token_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32, read back from the files through their index."""
    n = manifest.count()
    rows = manifest.select("shard", "path", "n_tokens", F.floor(F.col("shard") / BLOCK).alias("block"))
    # a running sum within blocks of shards, and one over the blocks, a row for each 64 GB of text
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = rows.groupBy("block").agg(F.sum("n_tokens").alias("n_tokens")).select("block", before(Window.orderBy("block")).alias("first"))
    starts = rows.withColumn("inside", before(Window.partitionBy("block").orderBy("shard"))).join(blocks, "block")
    shards = starts.select("path", (F.col("first") + F.col("inside")).alias("start"))
    return shards.repartition(max(1, n)).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
