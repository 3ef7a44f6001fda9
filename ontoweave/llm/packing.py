"""Packing by cutting-stock column generation.

Documents are cut into full sequences and a rest shorter than one.  A rest r over half a sequence fits nothing of its kind and
leaves a gap g beside it, so of these a share g / size is cut further, into pieces of g, which fill the gaps of the others even if
all documents are equally long.  That makes less than one piece more for each document.

The histogram of lengths (at most ``size`` bins, whatever the corpus) is a cutting-stock problem: a linear program over patterns
(multisets of lengths that fit one sequence), whose columns are priced by a knapsack dynamic program.  It starts from a greedy
basis, since the columns that pricing adds one at a time would take thousands of rounds from patterns of one length.
Rounded-down patterns take ranked documents of each length; the few left over are packed longest first.  Only the histogram reaches
the driver, and the tasks get the pattern table, which the number of lengths bounds.  Every piece is placed by a pattern.

All pieces are hashed in the one pass that encodes the text.  Ranks within a length are ranks within an input partition plus
the counts of the partitions before, so a length that a third of all documents share is not one task; these counts are
joined by shuffle, as they grow with the partitions.

Nulls: a null text is empty, which is the end id alone.  Null ids and repeated rows are packed like any others; other columns are
ignored, and an empty table has no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .tokens import encoded_steps

PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int32()), ("rank", pa.int64()), ("ids", pa.binary())])
PIECE_COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, rank long, ids binary"


def _ranks(lengths: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The rank of each piece among those of its length, after those seen before, which it counts up."""
    order = np.argsort(lengths, kind="stable")
    ordered = lengths[order]
    first = np.searchsorted(ordered, ordered)
    out = np.empty(len(lengths), np.int64)
    out[order] = np.arange(len(lengths)) - first + seen[ordered]
    seen += np.bincount(lengths, minlength=len(seen))
    return out


def cut(n: np.ndarray, size: int, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length) of the pieces of texts of n ids, in order; seen counts rests by length across calls."""
    full, rest = n // size, n % size
    gap = size - rest
    rank = _ranks(rest, seen)
    halve = (rest > size // 2) & (rank * gap // size != (rank + 1) * gap // size)
    step = np.where(halve, gap, np.maximum(rest, 1))
    extra = -(-rest // step)
    pieces = full + extra
    row = np.repeat(np.arange(len(n)), pieces)
    k = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    tail = k - full[row]  # place among the pieces of the rest
    start = np.where(tail < 0, k * size, full[row] * size + tail * step[row])
    return row, start, np.where(tail < 0, size, np.minimum(step[row], n[row] - start))


def _pieces(path: str, size: int, end: int, with_ids: bool):
    def run(batches):
        part, seen, rests = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for i, _, ends, ids in encoded_steps(batch, path, end):
                n = np.diff(ends)
                row, start, length = cut(n, size, rests)
                raw, at = memoryview(ids.astype("<u4").tobytes()), 4 * (ends[row] + start)
                spans = list(zip(at.tolist(), (at + 4 * length).tolist(), strict=True))
                crc = [zlib.crc32(raw[a:z]) for a, z in spans]
                kept = [bytes(raw[a:z]) for a, z in spans] if with_ids else [None] * len(spans)
                arrays = [doc_ids.take(pa.array(row + i)), start, length, crc, n[row], np.full(len(row), part, np.int32), _ranks(length, seen), kept]
                yield pa.record_batch([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(arrays, PIECE, strict=True)], schema=PIECE)

    return run


def _best_pattern(lengths: np.ndarray, values: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the multiset of lengths within size of most value."""
    worth = values > 1e-12
    ls, vs = lengths[worth], values[worth]
    best, last = np.zeros(size + 1), np.full(size + 1, -1)
    upto = np.searchsorted(ls, np.arange(size + 1), "right")
    for c in range(1, size + 1):
        best[c] = best[c - 1]
        k = upto[c]
        if k:
            got = best[c - ls[:k]] + vs[:k]
            i = int(got.argmax())
            if got[i] > best[c] + 1e-12:
                best[c], last[c] = got[i], i
    pattern, c = np.zeros(len(lengths)), size
    back = np.flatnonzero(worth)
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            pattern[back[last[c]]] += 1
            c -= ls[last[c]]
    return best[size], pattern


def _greedy(lengths: np.ndarray, demand: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(columns, amounts) of a feasible basis: the longest lengths left that fit, as often as the scarcest of them allows.

    Every pattern uses up a length that no later pattern has, so the columns are independent.
    """
    n = len(lengths)
    left, basis, x, done = demand.astype(float).copy(), np.zeros((n, n)), np.zeros(n), 0
    open_ = np.ones(n, bool)
    while open_.any():
        pattern, room = np.zeros(n), size
        for i in np.flatnonzero(open_)[::-1]:
            if lengths[i] <= room:
                pattern[i] = room // lengths[i]
                # not more of a length than there are, so that scarce lengths are not spent on patterns of their own
                pattern[i] = max(1, min(pattern[i], np.floor(left[i])))
                room -= int(pattern[i] * lengths[i])
        used = pattern > 0
        amount = float((left[used] / pattern[used]).min())
        left[used] -= pattern[used] * amount
        gone = np.flatnonzero(used & (left <= 1e-7 * np.maximum(1, demand)))
        for k, i in enumerate(gone):  # lengths that end together: the others get columns of their own, unused
            basis[:, done] = pattern if not k else 0
            basis[i, done] = pattern[i] if not k else 1
            x[done] = amount if not k else 0
            done += 1
        left[gone] = 0
        open_[gone] = False
    return basis, x


def column_generation(lengths: np.ndarray, demand: np.ndarray, size: int, gap: float = 2e-4, rounds: int = 300):
    """(patterns, amounts) of a linear program min sum(x), A x = demand; ends within gap of its bound or after rounds."""
    n = len(lengths)
    basis, x = _greedy(lengths, demand, size)
    inverse = np.linalg.inv(basis)
    least = (lengths * demand).sum() / size
    for turn in range(rounds):
        if turn % 100 == 99:  # against rounding errors
            inverse = np.linalg.inv(basis)
            x = np.maximum(inverse @ demand, 0)
        if x.sum() <= least * (1 + gap) + 0.25:
            break
        value, pattern = _best_pattern(lengths, inverse.sum(0), size)
        if value <= 1 + 1e-9 or x.sum() / value >= x.sum() / (1 + gap):
            break
        step = inverse @ pattern
        rise = step > 1e-9
        if not rise.any():
            break
        ratio = np.full(n, np.inf)
        ratio[rise] = x[rise] / step[rise]
        out = int(ratio.argmin())
        amount = ratio[out]
        x = np.maximum(x - amount * step, 0)
        x[out] = amount
        basis[:, out] = pattern
        pivot = inverse[out] / step[out]
        inverse -= np.outer(step, pivot)
        inverse[out] = pivot
    return basis.T.astype(np.int64), x


def plan(histogram: dict[int, int], size: int) -> list[tuple]:
    """Places for all pieces: rows (length, first rank, pieces a sequence, offset, first sequence, sequences)."""
    total = {int(k): int(v) for k, v in histogram.items()}
    slots, sequence = [], 0
    if size in total:
        slots.append((size, 0, 1, 0, 0, total[size]))
        sequence = total.pop(size)
    lengths = np.array(sorted(total), np.int64)
    if not len(lengths):
        return slots
    demand = np.array([total[k] for k in lengths], np.int64)
    patterns, amounts = column_generation(lengths, demand.astype(float), size)
    left, taken, chosen = demand.copy(), np.zeros(len(lengths), np.int64), []
    for pattern, amount in sorted(zip(patterns, np.floor(amounts + 1e-7).astype(np.int64), strict=True), key=lambda p: -p[1]):
        used = pattern > 0
        amount = min([int(amount), *(left[used] // pattern[used])])
        if amount > 0 and used.any():
            chosen.append((pattern, amount))
            left -= pattern * amount
    while left.any():  # what rounding left: the longest that fits, again and again
        pattern, room = np.zeros(len(lengths), np.int64), size
        for i in range(len(lengths) - 1, -1, -1):
            k = min(int(left[i]), room // int(lengths[i]))
            pattern[i], room = k, room - k * int(lengths[i])
        times = int(min(left[pattern > 0] // pattern[pattern > 0]))
        chosen.append((pattern, times))
        left -= pattern * times
    for pattern, amount in chosen:
        offset = 0
        for i in np.flatnonzero(pattern)[::-1]:
            each = int(pattern[i])
            slots.append((int(lengths[i]), int(taken[i]), each, offset, sequence, int(amount)))
            taken[i] += each * amount
            offset += each * int(lengths[i])
        sequence += int(amount)
    return slots


def _place(slots: list[tuple], names: list[str]):
    """Pieces with sequence_id and offset, from their length and rank."""
    table = np.array(sorted(slots), np.int64).reshape(-1, 6)
    span = int((table[:, 1] + table[:, 2] * table[:, 5]).max()) + 1 if len(table) else 1
    keys = table[:, 0] * span + table[:, 1]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
                slot = table[np.searchsorted(keys, length * span + rank, "right") - 1]
                k = rank - slot[:, 1]
                yield pa.record_batch({c: batch.column(c) for c in names} | {"sequence_id": pa.array(slot[:, 4] + k // slot[:, 2]), "offset": pa.array(slot[:, 3] + k % slot[:, 2] * length)})

    return run


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, end: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece; with_ids adds ids (binary, 32 bits each)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = written(docs.mapInArrow(_pieces(tokenizer, size, end, with_ids), PIECE_COLUMNS), "pieces")
    counts = written(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(counts.hint("merge"), ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before", "part")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids + ", sequence_id long, offset long"
    return ranked.mapInArrow(_place(plan(histogram, size), names), out)


def sequences(docs: DataFrame, tokenizer: str, size: int = 1024, end: int = 0) -> DataFrame:
    """sequence_id, n_tokens and input_ids: the packed rows, padded with the end id unless their length is a power of two."""

    def joined(batches):
        for batch in batches:
            out = []
            for s, parts in zip(batch.column("sequence_id").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                ids = np.frombuffer(b"".join(p["ids"] for p in parts), "<u4").tolist()
                n = len(ids)
                out.append((s, n, ids + [end] * (size - n if n & (n - 1) else 0)))
            yield pa.record_batch([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.list_(pa.int32()))], ["sequence_id", "n_tokens", "input_ids"])

    # a sequence holds at most size ids, so its pieces are few and small
    grouped = pack(docs, tokenizer, size, end, True).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return grouped.mapInArrow(joined, "sequence_id long, n_tokens int, input_ids array<int>")
