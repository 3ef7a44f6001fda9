"""Exact top-k by inner product with dual cover trees.

Queries and candidates are dealt in blocks; a task holds one pair of blocks.  It builds a cover tree over each and walks
both at once from the roots: a pair of nodes can be left out if its bound
``<q, x> + |q| r_x + |x| r_q + r_q r_x`` (centres q and x, covering radii r) is under the worst k-th score of all queries below the
query node.  The surviving pairs of leaves are scored exactly, and the best k of a query over all blocks are merged by id.
The walk takes the most promising candidates first, so that k-th scores rise early.

Cost and memory: both sides are sent once to each block of the other, a block holds at most ``block`` rows, and no task sees
more than two blocks.  The bound's rounding is covered by a slack, and scores are integer sums.

Vectors that are null or hold a null or non-finite component take no part, and vectors of different lengths do not meet; see
``integer_vectors``.  Ties go to the smaller id; of rows that repeat an id each is a candidate, but not for its own id.
A block with components beyond 2**20 in size, whose sums a double may not hold exactly, is scored in whole integers without
pruning; sums beyond a long are cut to its range.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAF, CENTRES = 256, 64
PAIR = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


class Node:
    __slots__ = ("centre", "radius", "children", "first", "end", "norm")

    def __init__(self, centre, radius, first, end):
        self.centre, self.radius, self.first, self.end, self.children = centre, radius, first, end, []
        self.norm = float(np.sqrt(centre @ centre))


def cover_tree(points: np.ndarray) -> tuple[Node, np.ndarray]:
    """(root, order): a tree over points[order]; a node covers points first to end within its radius.

    A node of radius r has children of centres more than r/2 apart that cover its points within r/2; the first child has
    the node's own centre (nesting).  A node of few or equal points is a leaf.
    """
    order = np.arange(len(points))
    root = Node(points[0], 0.0, 0, len(points))
    away = np.sqrt(np.maximum(((points - points[0]) ** 2).sum(1), 0))
    root.radius = float(away.max())
    todo = [(root, away)]
    while todo:
        node, away = todo.pop()
        n = node.end - node.first
        if n <= LEAF or node.radius <= 1e-9:
            continue
        half, mine = node.radius / 2, order[node.first : node.end]
        own, at = points[mine], node.first
        squares = (own**2).sum(1)
        inside = away <= half
        pieces, left = [(node.centre, np.flatnonzero(inside), away[inside])], np.flatnonzero(~inside)
        while len(left):  # the next rows that no child covers become centres, measured some at a time
            some = left[:CENTRES]
            near = np.sqrt(np.maximum(squares[left, None] + squares[some] - 2 * (own[left] @ own[some].T), 0))
            free = np.ones(len(left), bool)
            for j in range(len(some)):
                if free[j]:
                    near[j, j] = 0
                    inside = free & (near[:, j] <= half)
                    pieces.append((own[some[j]], left[inside], near[inside, j]))
                    free &= ~inside
            left = left[free]
        order[node.first : node.end] = mine[np.concatenate([p[1] for p in pieces])]
        for centre, rows, near in pieces:
            child = Node(centre, float(near.max()), at, at + len(rows))
            at += len(rows)
            node.children.append(child)
            todo.append((child, near))
    return root, order


def _walk(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int):
    """The best k of each query: dual-tree search."""
    q_root, q_order = cover_tree(queries)
    x_root, x_order = cover_tree(data)
    queries, query_ids, data, data_ids = queries[q_order], query_ids[q_order], data[x_order], data_ids[x_order]
    n = len(queries)
    scores = np.full((n, k), -np.inf)
    ids = np.full((n, k), np.iinfo(np.int64).max)
    slack = 1e-6 * (1 + q_root.norm + q_root.radius) * (1 + x_root.norm + x_root.radius)

    def arrays(nodes):
        return np.stack([c.centre for c in nodes]), np.array([c.norm for c in nodes]), np.array([c.radius for c in nodes])

    def bounds(left, right):
        (p, p_norm, p_radius), (x, x_norm, x_radius) = left, right
        return p @ x.T + p_norm[:, None] * x_radius + p_radius[:, None] * x_norm + p_radius[:, None] * x_radius + slack

    def worst(a):
        return scores[a.first : a.end, k - 1].min()

    def compare(mine, rows, allowed):
        """Queries mine against rows of data, where allowed."""
        found = np.where(allowed & (query_ids[mine, None] != data_ids[rows]), queries[mine] @ data[rows].T, -np.inf)
        least = scores[mine, k - 1]
        if found.shape[1] > k:
            least = np.maximum(least, np.partition(found, -k, axis=1)[:, -k])
        hits = (found >= least[:, None]) & np.isfinite(found)
        for i in np.flatnonzero(hits.any(1)):
            at, q = np.flatnonzero(hits[i]), mine[i]
            both, both_ids = np.concatenate([scores[q], found[i, at]]), np.concatenate([ids[q], data_ids[rows[at]]])
            best = np.lexsort((both_ids, -both))[:k]
            scores[q], ids[q] = both[best], both_ids[best]

    def ranges(nodes):
        """Rows below the nodes, and the node of each."""
        first, n = np.array([c.first for c in nodes]), np.array([c.end - c.first for c in nodes])
        of = np.repeat(np.arange(len(nodes)), n)
        return np.arange(n.sum()) - (np.cumsum(n) - n)[of] + first[of], of

    below = {}

    def parts(node):
        """The node's children (or itself), with their centres, norms and radii."""
        if id(node) not in below:
            nodes = node.children or [node]
            below[id(node)] = nodes, arrays(nodes)
        return below[id(node)]

    turn, heap = 0, [(-np.inf, 0, q_root, x_root)]
    while heap:
        most, _, a, b = heapq.heappop(heap)
        if -most < worst(a):
            continue
        (left, left_arrays), (right, right_arrays) = parts(a), parts(b)
        value = bounds(left_arrays, right_arrays)
        keep = value >= np.array([worst(c) for c in left])[:, None]
        q_leaf, x_leaf = (np.array([not c.children for c in nodes]) for nodes in (left, right))
        if (near := keep & q_leaf[:, None] & x_leaf).any():
            q_nodes, x_nodes = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
            mine, q_of = ranges([left[i] for i in q_nodes])
            rows, x_of = ranges([right[j] for j in x_nodes])
            near = near[np.ix_(q_nodes, x_nodes)]
            for i in range(0, len(mine), 256):
                compare(mine[i : i + 256], rows, near[q_of[i : i + 256]][:, x_of])
        for i, j in zip(*np.nonzero(keep & ~(q_leaf[:, None] & x_leaf)), strict=True):
            if value[i, j] >= worst(left[i]):
                turn += 1
                heapq.heappush(heap, (-value[i, j], turn, left[i], right[j]))
    row, col = np.nonzero(np.isfinite(scores))
    return query_ids[row], ids[row, col], scores[row, col].astype(np.int64)


def _in_integers(left, right, ids, k: int):
    rows, data, most = [], right.column("v").to_pylist(), (1 << 63) - 1
    for q, i in zip(left.column("v").to_pylist(), ids[0].tolist(), strict=True):
        scores = ((max(-most, min(most, sum(a * b for a, b in zip(q, x, strict=True)))), j) for x, j in zip(data, ids[1].tolist(), strict=True) if j != i)
        rows += [(i, j, s) for s, j in heapq.nsmallest(k, scores, key=lambda p: (-p[0], p[1]))]
    return [np.array([r[c] for r in rows], np.int64) for c in range(3)]


def _search(k: int):
    def run(left, right):
        if not left.num_rows or not right.num_rows:
            return PAIR.empty_table()
        vectors = [np.array(t.column("v").to_pylist(), np.float64) for t in (left, right)]
        ids = [t.column("id").to_numpy() for t in (left, right)]
        if max((np.abs(v).max() for v in vectors if v.size), default=0) > 1 << 20:
            found = _in_integers(left, right, ids, k)
        else:
            found = _walk(vectors[0], ids[0], vectors[1], ids[1], k)
        return pa.table([pa.array(x) for x in found], schema=PAIR)

    return run


def integer_vectors(df: DataFrame, id_column: str, column: str, factor: int = 256) -> DataFrame:
    """id and v: floor(factor * x) of every component as a long; vectors that are null, hold a null or non-finite component,
    or have no id, take no part."""
    v = F.col(column).cast("array<double>")
    good = F.col(id_column).isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.coalesce(good, F.lit(False))).select(F.col(id_column).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * factor)).alias("v"))


def top_k(queries: DataFrame, data: DataFrame, k: int = 5, block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score from frames of id and v (array of longs); only vectors of one length are compared.

    An empty vector scores 0 against empty ones.
    """
    size = F.size("v")
    sides = []
    for side in (queries, data):
        sides.append((side.withColumn("size", size), max(1, -(-side.count() // block))))
    (q, nq), (x, nx) = sides
    q = q.select("size", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(nq)).alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nx - 1).cast("long"))).alias("xb"), "id", "v")
    x = x.select("size", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nq - 1).cast("long"))).alias("qb"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(nx)).alias("xb"), "id", "v")
    keys = ["size", "qb", "xb"]
    found = q.groupBy(*keys).cogroup(x.groupBy(*keys)).applyInArrow(_search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
