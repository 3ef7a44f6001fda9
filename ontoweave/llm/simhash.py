"""SimHash near-duplicate classes with a byte-position inverted index and count filtering.

A fingerprint has eight bytes.  Two fingerprints at three or fewer differing bits agree in at least five of the eight
byte positions, so a pair that shares fewer positional bytes cannot link.  The index is an inverted index of positional
bytes: each posting is keyed by four positions and their bytes, with the fourteen quadruples of a Steiner system, one of
which lies inside any five positions.  So every pair that reaches the minimum of five shared bytes meets in a posting
list; there its shared positional bytes are tallied, pairs under five go, and the rest are verified by their bits.

Only distinct fingerprints are indexed (a group of copies is one).  A posting list gives the edges of a spanning forest,
not its pairs; a long list is first split by one further byte (any linked pair of the list shares one of the other four), and what
is still very long is searched by flipping bits, in time proportional to its length; so no list is capped.  Components come from label propagation with pointer jumping over the edges, each round written to
the shared folder.

Nulls and empty texts: fingerprint zero, linked like any other.  Null ids: kept, and never a class id unless all ids of the
class are null.  Repeated rows each get a result row.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, utf8, whole_runs, written

BYTE_POSITIONS, RADIUS = 8, 3
LEAST_SHARED = BYTE_POSITIONS - RADIUS
#: Quadruples of positions of which any five positions contain one: a and b are in one if a ^ b ^ c ^ d is zero.
QUADRUPLES = [q for q in combinations(range(BYTE_POSITIONS), 4) if q[0] ^ q[1] ^ q[2] ^ q[3] == 0]
#: A list over the first length is split by one more byte; one over the second is searched by flipped bits, in linear time.
LONG_LIST, VERY_LONG_LIST = 1024, 50_000


def fingerprint(raw: bytes, size: int = 3) -> int:
    """64 bits: bit k is set if over half of the shingles' XXH64 values (seed 42) have it."""
    words = raw.translate(LOWER_BYTES).split()
    if not words:
        return 0
    if len(words) <= size:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    join, digest, n = b" ".join, xxhash.xxh64_digest, len(words) - size + 1
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 8192):
        j = min(n, i + 8192)
        hashes = b"".join([digest(join(x), 42) for x in zip(*(words[i + k : j + k] for k in range(size)), strict=True)])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _fingerprints(size: int):
    def run(batches):
        for batch in batches:
            offsets, data = utf8(batch.column("text"))
            raw, bits = memoryview(data), np.zeros(batch.num_rows, np.uint64)
            for i in range(batch.num_rows):
                bits[i] = fingerprint(bytes(raw[offsets[i] : offsets[i + 1]]), size)
            yield pa.record_batch([batch.column("doc_id"), batch.column("t"), pa.array(bits.view(np.int64))], ["doc_id", "t", "bits"])

    return run


def _near(fps: np.ndarray, at: np.uint64) -> np.ndarray:
    """Whether each fingerprint shares enough bytes with at and, verified, lies within the radius."""
    differ = fps ^ at
    shared = (differ[:, None].view(np.uint8).reshape(-1, BYTE_POSITIONS) == 0).sum(1)
    return (shared >= LEAST_SHARED) & (np.bitwise_count(differ) <= RADIUS)


def _links_by_flips(fps: np.ndarray, free: tuple[int, ...], out: list) -> None:
    """Links of many sorted fingerprints that agree outside the free bytes: each is looked for with up to RADIUS bits flipped."""
    bits = [8 * p + k for p in free for k in range(8)]
    for n in range(1, RADIUS + 1):
        for chosen in combinations(bits, n):
            flipped = fps ^ np.uint64(sum(1 << b for b in chosen))
            at = np.minimum(np.searchsorted(fps, flipped), len(fps) - 1)
            hit = (fps[at] == flipped) & (flipped > fps)
            if hit.any():
                out.append((fps[hit], flipped[hit]))


def _links(fps: np.ndarray, free: tuple[int, ...], out: list) -> None:
    """Edges that connect what is linked within a posting list, whose fingerprints agree outside the free bytes."""
    n = len(fps)
    if n < 2:
        return
    if n > LONG_LIST and len(free) > RADIUS:
        for position in free:
            byte = (fps >> np.uint64(8 * position)) & np.uint64(255)
            order = np.argsort(byte, kind="stable")
            cut = np.flatnonzero(np.diff(byte[order])) + 1
            for part in np.split(fps[order], cut):
                _links(part, tuple(p for p in free if p != position), out)
        return
    if n > VERY_LONG_LIST:
        _links_by_flips(np.sort(fps), free, out)
        return
    left = np.arange(n)  # not yet reached
    while len(left) > 1:
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            here, frontier = frontier, []
            for at in here:
                if not len(left):
                    break
                hit = _near(fps[left], fps[at])
                if hit.any():
                    out.append((np.full(hit.sum(), fps[at]), fps[left[hit]]))
                    frontier.extend(left[hit])
                    left = left[~hit]


def _postings(batches):
    """Edges of every posting list; rows come sorted by list."""
    for table in whole_runs(batches, "posting"):
        lists, fps = table.column("posting").to_numpy(), table.column("bits").to_numpy().view(np.uint64)
        first = np.flatnonzero(np.append(True, lists[1:] != lists[:-1]))
        size = np.diff(np.append(first, len(lists)))
        out: list = []
        pairs = first[size == 2]
        if len(pairs):
            hit = _near(fps[pairs], fps[pairs + 1])
            out.append((fps[pairs[hit]], fps[pairs[hit] + 1]))
        for i, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            _links(fps[i : i + n], tuple(p for p in range(BYTE_POSITIONS) if p not in QUADRUPLES[int(lists[i]) >> 32]), out)
        if out:
            u, v = (np.concatenate(x).view(np.int64) for x in zip(*out, strict=True))
            yield pa.record_batch([pa.array(u), pa.array(v)], ["u", "v"])


def links(distinct: DataFrame, n: int) -> DataFrame:
    """u, v: edges that connect the distinct fingerprints (long bits) within the radius, by the byte-position index; written."""
    byte = [F.shiftrightunsigned("bits", 8 * p).bitwiseAND(255) for p in range(BYTE_POSITIONS)]
    keys = [sum((F.call_function("shiftleft", byte[p].cast("long"), F.lit(8 * k)) for k, p in enumerate(q)), F.lit(i << 32).cast("long")) for i, q in enumerate(QUADRUPLES)]
    postings = distinct.select("bits", F.explode(F.array(*keys)).alias("posting")).repartition(n, "posting").sortWithinPartitions("posting")
    return written(postings.mapInArrow(_postings, "u long, v long").distinct(), "links")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, root of the connected components of edges u, v (longs): root is the least node.

    Each round takes the least label among neighbours and then that label's label; both steps are joins and partial
    minima, so a hub is no hot task.  Rounds are written; the only thing that reaches the driver is a count.
    """
    both = written(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct(), name)
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("root")), name)
    while True:
        seen = both.join(labels.select(F.col("node").alias("v"), "root"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near"))
        hooked = labels.join(seen, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("near"))
        # pointer jump: the label of the label
        jump = labels.select(F.col("node").alias("near"), F.col("root").alias("far"))
        after = written(hooked.join(jump, "near").select("node", "was", F.least("near", "far").alias("root")), name)
        if not after.where("root <> was").limit(1).count():
            return after.select("node", "root")
        labels = after.select("node", "root")


def simhash_classes(docs: DataFrame, size: int = 3, more: bool = False) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id (smallest id of the class) of each document.

    With ``more`` also root (a fingerprint that names the class) and t (hash of the text).
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("t", F.xxhash64("text"))
    prints = written(docs.mapInArrow(_fingerprints(size), "doc_id long, t long, bits long"), "fingerprints")
    distinct = written(prints.groupBy("bits").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "distinct-fingerprints")
    edges = links(distinct, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    roots = components(edges, "fingerprint-components")
    labelled = distinct.join(roots.withColumnRenamed("node", "bits"), "bits", "left").select("bits", F.coalesce("root", "bits").alias("root"), "least")
    owner = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    of_bits = labelled.join(owner, "root").select("bits", "root", "component_id")
    return prints.join(of_bits, "bits").select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id", *["root", "t"] * more)


def keep_one(docs: DataFrame, size: int = 3) -> DataFrame:
    """One document of each class, with the columns of docs: that of the smallest id, of these the one of the least fingerprint and text.

    Rows without an id cannot be named as the kept one, so all of them stay.  Rows of one id and one text are one document; other
    texts of an id are documents of their own, and stay if their class has no smaller id.
    """
    key, t = F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))
    named = docs.where(key.isNotNull())
    rows = simhash_classes(named, size, True).select("doc_id", "fingerprint", "root", "t")
    kept = rows.groupBy("root").agg(F.min(F.struct("doc_id", "fingerprint", "t")).alias("kept")).select(F.col("kept.doc_id").alias("__ow_kept"), F.col("kept.t").alias("__ow_t")).distinct()
    named = named.join(kept, (key == F.col("__ow_kept")) & t.eqNullSafe(F.col("__ow_t"))).dropDuplicates(["__ow_kept", "__ow_t"])
    return named.select(*docs.columns).unionByName(docs.where(key.isNull()))
