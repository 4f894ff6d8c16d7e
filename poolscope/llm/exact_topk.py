"""Exact top-k by inner product over integer vectors, with a KD-tree per shard.

Rows are dealt to shards of bounded size by a hash. A shard's tree splits at the median of its widest
dimension and keeps the tight box of every node; the greatest inner product of a query with any point
of a box bounds the node. A query walks a tree best bound first and stops when no bound reaches its
kth score so far. It searches its home shard first, and the kth score found there goes with it to all
other shards, where boxes below it are never opened.

Shards and blocks of queries meet by an equi-join of dealt tiles, so a task holds one shard and one
block of queries at a time. Scores are exact integers.

Defined cases: vectors that are null, empty or hold null or non-finite components, and null vec_ids,
take no part; vectors are compared with those of their own length; repeated rows are candidates of
their own, while a query id that repeats is one query, with its least vector; scores beyond 64 bits
are cut to the greatest long; empty input gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolscope.llm.shared import written
from poolscope.llm.vectors import FOUND, best, matrices, spread, usable

K = 5
SCALE = 256
SHARD_ROWS = 8_192
BLOCK_QUERIES = 2_048
LEAF = 128
_SCHEMA = FOUND.format("bigint")
_LONG = (1 << 63) - 1


class KdTree:
    """Median splits of the rows of a matrix; `lo` and `hi` are the tight boxes of the nodes, node 0 the root."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.rows = np.arange(len(points))
        self.spans: list[tuple[int, int]] = []
        self.children: list[int | None] = []
        lo, hi, todo = [], [], [(0, len(points))]
        while todo:
            # nodes are numbered in the order they are split; two children take the next free numbers
            ahead = []
            for a, b in todo:
                part = points[self.rows[a:b]]
                lo.append(part.min(0))
                hi.append(part.max(0))
                self.spans.append((a, b))
                if b - a <= leaf:
                    self.children.append(None)
                    continue
                wide = int(np.argmax(hi[-1].astype(np.float64) - lo[-1]))
                mid = (b - a) // 2
                self.rows[a:b] = self.rows[a:b][np.argpartition(part[:, wide], mid)]
                self.children.append(len(ahead))
                ahead += [(a, a + mid), (a + mid, b)]
            base = len(self.spans)
            level = len(self.spans) - len(todo)
            for k in range(level, base):
                if self.children[k] is not None:
                    self.children[k] += base
            todo = ahead
        self.lo, self.hi = np.stack(lo), np.stack(hi)
        self.points = points[self.rows]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Greatest possible score of each query (rows) in each node's box (columns)."""
        return np.maximum(queries, 0) @ self.hi.T + np.minimum(queries, 0) @ self.lo.T


def search(tree: KdTree, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, floors: list[int | None], k: int) -> list[tuple[int, int, int]]:
    """(query row, vec_id, score) of each query's k best rows but its own that reach its floor, ties to smaller ids."""
    bounds, ids, out = tree.bounds(queries), ids[tree.rows], []
    for q in range(len(queries)):
        kth, scores, names = floors[q], np.empty(0, tree.points.dtype), np.empty(0, np.int64)
        open_nodes = [(-bounds[q, 0], 0)]
        while open_nodes:
            bound, node = heapq.heappop(open_nodes)
            if kth is not None and -bound < kth:
                break
            child = tree.children[node]
            if child is not None:
                for c in (child, child + 1):
                    if kth is None or bounds[q, c] >= kth:
                        heapq.heappush(open_nodes, (-bounds[q, c], c))
                continue
            a, b = tree.spans[node]
            got = tree.points[a:b] @ queries[q]
            take = ids[a:b] != own[q]
            if kth is not None:
                take &= got >= kth
            if take.any():
                scores, names = np.concatenate([scores, got[take]]), np.concatenate([names, ids[a:b][take]])
                if len(scores) > k:
                    first = np.lexsort((names, -scores))[:k]
                    scores, names = scores[first], names[first]
                if len(scores) == k:
                    kth = scores.min() if kth is None else max(kth, scores.min())
        out += [(q, int(n), int(s)) for n, s in zip(names, scores, strict=True)]
    return out


def _fit_type(x: np.ndarray, y: np.ndarray) -> type:
    """A number type in which inner products of rows of x and y are exact."""
    most = int(max(np.abs(x.astype(np.float64)).max(initial=0), 1)) * int(max(np.abs(y.astype(np.float64)).max(initial=0), 1)) * x.shape[1]
    return np.float64 if most < 1 << 52 else np.int64 if most < 1 << 62 else object


def search_tile(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """All queries of a tile against all its rows."""
    found: list[tuple[int, int, int]] = []
    if queries.num_rows and rows.num_rows:
        candidates, ids = matrices(rows["ints"]), rows["vec_id"].to_numpy()
        names, floors = queries["query_id"].to_numpy(), queries["floor"].to_pylist()
        for d, (asked, wanted) in matrices(queries["ints"]).items():
            if d not in candidates:
                continue
            place, points = candidates[d]
            kind = _fit_type(points, wanted)
            tree = KdTree(points.astype(kind))
            hits = search(tree, ids[place], wanted.astype(kind), names[asked], [floors[i] for i in asked], k)
            found += [(int(names[asked[q]]), n, max(-_LONG - 1, min(_LONG, s))) for q, n, s in hits]
    cols = zip(*found, strict=True) if found else ([], [], [])
    return pa.table({n: pa.array(list(c), pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), cols, strict=True)})


def exact_top_k(vectors: DataFrame, every: int = 50, k: int = K, scale: int = SCALE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for every row whose id is divisible by `every`, the k best other rows."""
    ints = F.transform("embedding", lambda x: F.floor(x * F.lit(float(scale))))
    rows = written(usable(vectors).withColumn("ints", ints).withColumn("hash", F.xxhash64("vec_id", "embedding")).drop("embedding"), "top-k-rows")
    shards = 1 + rows.count() // shard_rows
    rows = rows.withColumn("shard", F.pmod("hash", F.lit(shards)).cast("int"))
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("ints").alias("ints"))
    asked = written(asked.withColumn("home", F.pmod(F.xxhash64("query_id"), F.lit(shards)).cast("int")), "top-k-queries")
    blocks = 1 + asked.count() // BLOCK_QUERIES
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(blocks)).cast("int"))
    tiles = rows.select("shard", "vec_id", "ints", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def scan(queries: DataFrame) -> DataFrame:
        left = queries.groupBy("shard", "block")
        return left.cogroup(tiles.groupBy("shard", "block")).applyInArrow(lambda q, r: search_tile(q, r, k), _SCHEMA)

    at_home = scan(asked.select(F.col("home").alias("shard"), "block", "query_id", "ints", F.lit(None).cast("long").alias("floor")))
    at_home = written(at_home, "top-k-home")
    floor = at_home.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    others = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != F.col("home"))
    away = asked.join(floor, "query_id", "left").select(F.explode(others).alias("shard"), "block", "query_id", "ints", "floor")
    return best(at_home.unionByName(scan(away)), k, F.col("score").desc())
