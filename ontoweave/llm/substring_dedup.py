"""Substring dedup with prefix-partitioned suffix trees.

Every run of ``window`` words that also starts in a document with a smaller id is a repeat.

1. Each window is charged to its anchor, the leftmost least of its runs of ``GRAM`` words (by a hash), so a window and its copy have
   the anchor at the same place.  One record stands for an anchor and the consecutive windows charged to it; about one
   word in eighteen is an anchor.  Anchors of a run that only one document holds are dropped before any text is shuffled.
2. The others are suffixes to be sorted.  They are dealt by a prefix of variable length: the ``GRAM`` words of the anchor where these
   have at most ``LIMIT`` suffixes, which fit a task, and the whole window where they have more.
3. In a group of the first kind two trees are built, as sorted suffixes with the common prefixes of neighbours: one of the words from
   the anchor on and one of the words before it, backwards.  A node of depth d in the first and a node of depth
   ``window`` - d in the second make a repeat of the window around their leaves; windows one word on that are repeats too make the
   repeat longer, and the spans that come out are maximal.  Words are compared as they are, not by hashes.
   A group of the second kind is one window, so its owner is a partial minimum and a join, keyed by 128 bits of word hashes.
4. The owners (smallest ids) go back to the batches of documents, which mark covered words.

Records of equal words in a batch are one leaf (smallest and largest id), so a passage in a third of all rows gives few leaves for
each batch, not one for each row.  Nothing is collected; one batch of text (2 to 64 MB) is held by a task.

Nulls: a null text has no words; a null id counts as larger than all ids.  Rows with one id are one document for the
comparison (they own nothing from each other), and each gets its own result row.  Texts under ``window`` words lose nothing.  Other
columns are ignored, and an empty table has no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, in_batches, run_hashes, steps, utf8, whole_runs, word_hashes, word_spans, written

GRAM = 16
#: Suffixes of one prefix that a task sorts together; more are told apart by whole windows.
LIMIT = 20_000


def _sliding_argmin(x: np.ndarray, w: int) -> np.ndarray:
    """Leftmost place of the least value in each run of w values, by doubling."""
    place, have = np.arange(len(x)), 1
    while have < w:
        by = min(have, w - have)
        a, b = place[:-by], place[by:]
        place, have = np.where(x[b] < x[a], b, a), have + by
    return place


def _sorted(table: pa.Table) -> pa.Table:
    """Rows in an order of their own, so that a row's place in its batch is the same each time."""
    return table.take(pa.compute.sort_indices(table, sort_keys=[("id", "ascending"), ("text", "ascending")]))


class Step:
    """Some documents of a batch: their words, windows and records (anchors with the windows charged to them)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int):
        self.data, self.window = data, window
        self.rows, self.starts, self.ends = word_spans(data, offsets)
        self.words = word_hashes(data, self.starts, self.ends)
        n = np.maximum(np.diff(self.rows) - window + 1, 0)
        row = np.repeat(np.arange(len(n)), n)
        self.at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + self.rows[:-1][row]
        gram = run_hashes(self.words, GRAM)
        anchor = _sliding_argmin(gram, window - GRAM + 1)[self.at] if len(row) else self.at
        first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]))) if len(row) else self.at
        self.row, self.anchor, self.first = row[first], anchor[first], self.at[first]
        self.count = np.diff(np.append(first, len(row)))
        self.key = gram[self.anchor] if len(row) else np.zeros(0, np.uint64)
        self._texts = None

    def contexts(self, chosen: np.ndarray) -> list[bytes]:
        """The words of all windows of the chosen records, one blank between them."""
        if self._texts is None:
            size = self.ends - self.starts + 1
            self._places = np.concatenate([[0], np.cumsum(size)])
            out = np.full(self._places[-1], 0x20, np.uint8)
            n = size - 1
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(self._places[:-1], n) + inside] = self.data[np.repeat(self.starts, n) + inside]
            self._texts = out.tobytes()
        a = self._places[self.first[chosen]]
        z = self._places[self.first[chosen] + self.count[chosen] + self.window - 1] - 1
        return [self._texts[i:j] for i, j in zip(a.tolist(), z.tolist(), strict=True)]

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(record, first word, hash, second hash) of each window of the chosen records."""
        n = self.count[chosen] + self.window - 1
        ends = np.cumsum(n)
        if not len(n):
            return chosen, chosen, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        word = np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(self.first[chosen], n)
        one = run_hashes(self.words[word], self.window)
        two = run_hashes(word_hashes(self.data, self.starts[word], self.ends[word], 1), self.window)
        n = self.count[chosen]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = k + np.repeat(ends - (n + self.window - 1), n)
        return np.repeat(chosen, n), k + np.repeat(self.first[chosen], n), one[at], two[at]


def _steps(table: pa.Table, window: int):
    offsets, data = utf8(table.column("text"))
    for i, j in steps(offsets):
        yield i, j, Step(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], window)


def _signed(x: np.ndarray):
    return pa.array(x.view(np.int64))


def _least_and_most(keys: list[np.ndarray], values: np.ndarray):
    """(order of the first of each distinct key, smallest and largest value of each, key of each row)."""
    order = np.lexsort((values, *keys[::-1]))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(order)) - 1 if len(order) else first
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return order[first], values[order[first]], values[order[last]], of


ANCHORS = "b int, key long, lo long, hi long, n long"


def _anchors(window: int):
    def run(table):
        table = _sorted(table)
        ids, b = table.column("id").to_numpy(), table.column("b")[0].as_py()
        parts = [(s.key, ids[i + s.row]) for i, _, s in _steps(table, window)]
        key, of_id = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        first, lo, hi, of = _least_and_most([key], of_id)
        return pa.table({"b": pa.array(np.full(len(first), b, np.int32)), "key": _signed(key[first]), "lo": pa.array(lo), "hi": pa.array(hi), "n": pa.array(np.bincount(of, minlength=len(first)))})

    return run


def _shared_keys(limit: int):
    """Keys that documents of different ids hold, for each batch that has them; many if they have over limit suffixes."""

    def run(batches):
        for t in whole_runs(batches, "key"):
            key, lo, hi, n = (t.column(c).to_numpy() for c in ("key", "lo", "hi", "n"))
            new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(new, len(key)))
            keep = np.repeat(np.minimum.reduceat(lo, new) < np.maximum.reduceat(hi, new), size)
            many = np.repeat(np.add.reduceat(n, new) > limit, size)
            yield from t.select(["b", "key"]).append_column("many", pa.array(many)).filter(pa.array(keep)).to_batches()

    return run


#: A leaf: a record (words of its windows, place of the anchor, windows; row and first word of one that has it), or a window of a
#: frequent prefix (its hashes key2 and key3); and the smallest and largest id that have it.  key is the prefix's hash.
LEAF = pa.schema([("b", pa.int32()), ("key", pa.int64()), ("key2", pa.int64()), ("key3", pa.int64()), ("words", pa.binary()), ("anchor", pa.int32()), ("n", pa.int32()), ("row", pa.int32()), ("at", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64())])
LEAVES = "b int, key long, key2 long, key3 long, words binary, anchor int, n int, row int, at int, lo long, hi long"


def _known(keys: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    """Whether each key is one of sorted_keys."""
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)] == keys if len(sorted_keys) else np.zeros(len(keys), bool)


def _chosen(table: pa.Table, window: int, keys: np.ndarray, frequent: np.ndarray):
    """A batch's records of these sorted keys: (row, place of the anchor, windows, first word, key), and their words as codes of equal
    ones; and the windows of records of frequent keys: (row, first word, key, two hashes)."""
    parts, texts, more = [], [], []
    for i, _, s in _steps(table, window):
        hit = np.flatnonzero(_known(s.key, keys))
        texts += s.contexts(hit)
        parts.append((s.row[hit] + i, s.anchor[hit] - s.first[hit], s.count[hit], s.first[hit] - s.rows[s.row[hit]], s.key[hit]))
        record, at, one, two = s.windows(np.flatnonzero(_known(s.key, frequent)))
        more.append((s.row[record] + i, at - s.rows[s.row[record]], s.key[record], one, two))
    found, hot = ([np.concatenate(x) for x in zip(*p, strict=True)] for p in (parts, more))
    return found, pa.array(texts, pa.large_binary()).dictionary_encode(), hot


def _leaves(window: int):
    def run(table, wanted):
        if not table.num_rows or not wanted.num_rows:
            return LEAF.empty_table()
        table = _sorted(table)
        ids, b, many = table.column("id").to_numpy(), table.column("b")[0].as_py(), wanted.column("many").to_numpy()
        key = wanted.column("key").to_numpy().view(np.uint64)
        (row, anchor, n, at, keys), words, (hot_row, _, hot_key, one, two) = _chosen(table, window, np.unique(key[~many]), np.unique(key[many]))
        code = words.indices.to_numpy()
        first, lo, hi, _ = _least_and_most([code, anchor], row)  # rows are in the order of ids
        k = len(first)
        nothing = pa.nulls(k, pa.int64())
        records = pa.table([pa.array(np.full(k, b, np.int32)), _signed(keys[first]), nothing, nothing, words.dictionary.take(pa.array(code[first])).cast(pa.binary()), pa.array(anchor[first].astype(np.int32)), pa.array(n[first].astype(np.int32)), pa.array(lo.astype(np.int32)), pa.array(at[first].astype(np.int32)), pa.array(ids[lo]), pa.array(ids[hi])], schema=LEAF)
        first, lo, hi, _ = _least_and_most([one, two], hot_row)
        k = len(first)
        nothing = pa.nulls(k, pa.int32())
        windows = pa.table([pa.array(np.full(k, b, np.int32)), *(_signed(x[first]) for x in (hot_key, one, two)), pa.nulls(k, pa.binary()), nothing, nothing, nothing, nothing, pa.array(ids[lo]), pa.array(ids[hi])], schema=LEAF)
        return pa.concat_tables([records, windows])

    return run


def sorted_suffixes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the rows of codes in order, and how many leading codes each has in common with the one before."""
    rows = np.ascontiguousarray(codes.astype(">i4"))
    order = np.argsort(rows.view(np.dtype((np.void, rows.shape[1] * 4))).ravel(), kind="stable")
    same = codes[order[1:]] == codes[order[:-1]]
    common = np.where(same.all(1), codes.shape[1], same.argmin(1)) if codes.shape[1] else np.zeros(len(same), np.int64)
    return order, np.concatenate([np.zeros(min(1, len(order)), np.int64), common])


def _nodes(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """The node of this depth above each leaf: neighbours with so many common codes are below one."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < depth)
    return out


OWNED = "b int, key long, key2 long, key3 long, row int, at int, first int, end int, owner long"


def _trees(window: int):
    """Repeated windows of every leaf, as ranges first to end of its windows with one owner."""

    def run(batches):
        for t in whole_runs(batches, "key"):
            offsets, data = utf8(t.column("words").cast(pa.large_binary()))
            rows, starts, ends = word_spans(data, offsets)
            size = ends - starts
            inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            words = data[np.repeat(starts, size) + inside]
            words = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(words))])
            code = np.append(words.dictionary_encode().indices.to_numpy(), -1)
            anchor, n, lo, hi = (t.column(c).to_numpy().astype(np.int64) for c in ("anchor", "n", "lo", "hi"))
            group = np.unique(t.column("key").to_numpy(), return_inverse=True)[1][:, None]
            mid = rows[:-1] + anchor
            right = mid[:, None] + np.arange(window)
            left = mid[:, None] - 1 - np.arange(window - GRAM)
            none = len(code) - 1
            after = sorted_suffixes(np.hstack([group, code[np.where(right < rows[1:, None], right, none)]]))
            before = sorted_suffixes(np.hstack([group, code[np.where(left >= rows[:-1, None], left, none)]]))
            hits = []
            for e in range(window - GRAM + 1):  # words of the window before the anchor
                leaf = np.flatnonzero((anchor >= e) & (anchor - e < n))
                if not len(leaf):
                    continue
                node = _nodes(*after, 1 + window - e)[leaf] * (len(anchor) + 1) + _nodes(*before, 1 + e)[leaf]
                _, least, _, of = _least_and_most([node], lo[leaf])
                owner = least[of]
                repeat = owner < hi[leaf]
                hits.append((leaf[repeat], anchor[leaf[repeat]] - e, owner[repeat]))
            leaf, k, owner = (np.concatenate(x) for x in zip(*hits, strict=True)) if hits else [np.zeros(0, np.int64)] * 3
            order = np.lexsort((k, leaf))
            leaf, k, owner = leaf[order], k[order], owner[order]
            new = np.flatnonzero(np.append(True, (leaf[1:] != leaf[:-1]) | (k[1:] != k[:-1] + 1) | (owner[1:] != owner[:-1]))) if len(leaf) else leaf
            last = np.append(new[1:], len(leaf)) - 1 if len(leaf) else new
            at = pa.array(leaf[new])
            yield from pa.table({c: t.column(c).take(at) for c in ("b", "key", "key2", "key3", "row", "at")} | {"first": pa.array(k[new].astype(np.int32)), "end": pa.array((k[last] + 1).astype(np.int32)), "owner": pa.array(owner[new])}).to_batches()

    return run


def _marks(table: pa.Table, owned: pa.Table, ids: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, end word) of stretches of a batch to be removed."""
    out = []
    hot = owned.column("key2").is_valid().to_numpy()
    key, key2, key3 = (owned.column(c).fill_null(0).to_numpy().view(np.uint64) for c in ("key", "key2", "key3"))
    owner = owned.column("owner").to_numpy()
    (row, anchor, _, at, _), words, (hot_row, hot_at, _, one, two) = _chosen(table, window, np.unique(key[~hot]), np.unique(key[hot]))
    if not hot.all():
        trees = owned.filter(pa.array(~hot))
        _, _, _, leaf = _least_and_most([words.indices.to_numpy(), anchor], row)
        # the leaf of each answer: by the row and first word of the record that stands for it
        span = int(at.max(initial=0)) + 1
        place = row * span + at
        order = np.argsort(place)
        asked = trees.column("row").to_numpy().astype(np.int64) * span + trees.column("at").to_numpy()
        answer = leaf[order[np.searchsorted(place, asked, sorter=order)]]
        by_leaf = np.argsort(leaf, kind="stable")
        begin, end = np.searchsorted(leaf[by_leaf], answer), np.searchsorted(leaf[by_leaf], answer, "right")
        n = end - begin
        i = np.repeat(np.arange(len(answer)), n)
        m = by_leaf[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)]
        first, last = (trees.column(c).to_numpy().astype(np.int64)[i] for c in ("first", "end"))
        later = owner[~hot][i] < ids[row[m]]
        out.append((row[m][later], (at[m] + first)[later], (at[m] + last + window - 1)[later]))
    if hot.any():
        # windows and their owners as one sequence of hashes, each distinct one once
        pairs = [np.concatenate(x) for x in ((key2[hot], one), (key3[hot], two))]
        _, _, _, of = _least_and_most(pairs, np.arange(len(pairs[0])))
        n, least = int(hot.sum()), np.full(int(of.max(initial=-1)) + 1, NO_ID)
        least[of[:n]] = owner[hot]
        hit = np.flatnonzero(least[of[n:]] < ids[hot_row])
        out.append((hot_row[hit], hot_at[hit], hot_at[hit] + window))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _cover(window: int, spans: bool):
    def run(table, owned):
        if not table.num_rows:
            return schema.empty_table()
        table = _sorted(table)
        row, first, end = _marks(table, owned, table.column("id").to_numpy(), window) if owned.num_rows else [np.zeros(0, np.int64)] * 3
        order = np.argsort(row, kind="stable")
        cuts = np.searchsorted(row[order], np.arange(table.num_rows + 1))
        offsets, data = utf8(table.column("text"))
        raw = memoryview(data)
        out = {k: [] for k in schema.names}
        for d, doc_id in enumerate(table.column("doc_id").to_pylist()):
            words = bytes(raw[offsets[d] : offsets[d + 1]]).split()
            mine, gone, runs = order[cuts[d] : cuts[d + 1]], 0, []
            n = len(words)
            if len(mine):
                change = np.zeros(n + 1, np.int64)
                np.add.at(change, first[mine], 1)
                np.add.at(change, end[mine], -1)
                removed = np.cumsum(change)[:-1] > 0
                gone = int(removed.sum())
                words = [w for w, g in zip(words, removed.tolist(), strict=True) if not g]
                runs = np.flatnonzero(np.diff(np.concatenate([[0], removed.astype(np.int8), [0]]))).reshape(-1, 2).tolist()
            kept = b" ".join(words)
            out["doc_id"].append(doc_id)
            out["n_words"].append(n)
            out["n_removed"].append(gone)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            if spans:
                out["kept"].append(kept.decode())
                out["removed_spans"].append(runs)
        return pa.table(out, schema=schema)

    schema = pa.schema(RESULT if spans else RESULT[:4])
    return run


RESULT = [pa.field("doc_id", pa.int64()), pa.field("n_words", pa.int64()), pa.field("n_removed", pa.int64()), pa.field("kept_sha256", pa.string()), pa.field("kept", pa.string()), pa.field("removed_spans", pa.list_(pa.list_(pa.int64())))]


def substring_dedup(docs: DataFrame, window: int = 50, spans: bool = False, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each document; with ``spans`` also the kept text and removed word runs."""
    if window < GRAM:
        raise ValueError(f"window must be at least {GRAM} words")
    docs = in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    docs = docs.select("b", "doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "text")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.groupBy("b")
    anchors = texts.applyInArrow(_anchors(window), ANCHORS)
    wanted = anchors.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_shared_keys(limit), "b int, key long, many boolean")
    leaves = written(texts.cogroup(wanted.groupBy("b")).applyInArrow(_leaves(window), LEAVES), "leaves")
    groups = leaves.where("key2 is null").repartition(n, "key").sortWithinPartitions("key")
    owned = groups.mapInArrow(_trees(window), OWNED)
    frequent = leaves.where("key2 is not null").select("b", "key", "key2", "key3", "lo", "hi")
    owner = frequent.groupBy("key2", "key3").agg(F.min("lo").alias("owner"), F.max("hi").alias("most")).where("owner < most").drop("most")
    frequent = frequent.join(owner, ["key2", "key3"]).where("owner < hi")
    nothing = F.lit(None).cast("int")
    owned = owned.union(frequent.select("b", "key", "key2", "key3", nothing, nothing, nothing, nothing, "owner"))
    kind = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string, removed_spans array<array<long>>" * spans
    return texts.cogroup(owned.groupBy("b")).applyInArrow(_cover(window, spans), kind)
