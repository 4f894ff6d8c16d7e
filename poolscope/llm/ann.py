"""Approximate nearest neighbours: an inverted file whose lists are scanned by adaptive dimensions.

Centroids are fitted on at most SAMPLE rows (first in hash order), in one task, for each vector length by itself;
every row is then put into the list of its nearest centroid. Rows of a length that the sample lacks are one list. A query probes its nearest lists. Within a list, vectors are
rotated by a fixed random rotation and lie in blocks of columns. After each block the partial squared
distance of m of d dimensions is tested against the kth distance r so far: if it exceeds
r^2 * m / d * (1 + EPSILON / sqrt(m))^2, the hypothesis that the whole distance stays below r is
rejected and the candidate abandoned. Survivors are measured in double precision on their original vectors.

A query searches its nearest list first; its kth distance there goes with it to the other lists. Long
lists are split, and so are the queries of a much-probed list, so a task holds a bounded tile.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and null
vec_ids, take no part; vectors of different lengths are searched apart; repeated rows are candidates of
their own, while a repeated query id is one query, with its least vector; empty input gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolscope.llm.shared import written
from poolscope.llm.vectors import FOUND, best, matrices, usable

K = 10
SAMPLE = 16_000
MOST_LISTS = 1_024
ROUNDS = 8
PROBES, PROBE_SHARE = 24, 0.7
EPSILON = 2.1
COLUMNS = 16
CHUNK = 512
TILE_ROWS, TILE_QUERIES = 8_192, 2_048
_SCHEMA = FOUND.format("double")


def nearest(points: np.ndarray, centres: np.ndarray, count: int = 1) -> np.ndarray:
    """Numbers of the nearest centres of each point, nearest first."""
    out = np.empty((len(points), count), np.int64)
    half = (centres * centres).sum(1) / 2
    for i in range(0, len(points), 4_096):
        far = half - points[i : i + 4_096] @ centres.T
        few = np.argpartition(far, count - 1, axis=1)[:, :count] if count < len(centres) else np.tile(np.arange(len(centres)), (len(far), 1))
        order = np.argsort(np.take_along_axis(far, few, 1), axis=1, kind="stable")
        out[i : i + 4_096] = np.take_along_axis(few, order, 1)
    return out


@lru_cache(8)
def rotation_of(d: int) -> np.ndarray:
    """The fixed random rotation of vectors of length d."""
    return np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))[0]


def fit_index(points: np.ndarray, lists: int) -> np.ndarray:
    """Centroids by Lloyd's rounds from random rows; an emptied list restarts at a random row."""
    rng = np.random.default_rng(4)
    centres = points[rng.permutation(len(points))[:lists]].copy()
    for _ in range(ROUNDS):
        at = nearest(points, centres)[:, 0]
        count = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, points)
        empty = count == 0
        centres = sums / np.maximum(count, 1)[:, None]
        centres[empty] = points[rng.integers(0, len(points), empty.sum())]
    return centres


def scan_list(points: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, radii: np.ndarray, k: int) -> list:
    """(query row, vec_id, distance) of the k nearest rows found for each query, but its own row."""
    d = points.shape[1]
    turned, asked = points @ rotation_of(d), queries @ rotation_of(d)
    # what rounding may add to the partial distance of two copies, many times over; the exact distance decides
    blur = 1e-20 * (queries * queries).sum(1)
    edges = [*range(0, d, COLUMNS), d]
    blocks = [np.ascontiguousarray(turned[:, a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    slack = [m / d * (1 + EPSILON / np.sqrt(m)) ** 2 for m in edges[1:]]
    out = []
    for q in range(len(queries)):
        radius, dist, names = radii[q], np.empty(0), np.empty(0, np.int64)
        for c in range(0, len(points), CHUNK):
            alive = c + np.flatnonzero(ids[c : c + CHUNK] != own[q])
            part = np.zeros(len(alive))
            for n, block in enumerate(blocks[:-1]):
                gap = block[alive] - asked[q, edges[n] : edges[n + 1]]
                part += np.einsum("ij,ij->i", gap, gap)
                stay = part <= slack[n] * radius * radius * (1 + 1e-9) + blur[q]
                alive, part = alive[stay], part[stay]
            gap = points[alive] - queries[q]
            exact = np.sqrt((gap * gap).sum(1))
            stay = exact <= radius
            dist, names = np.concatenate([dist, exact[stay]]), np.concatenate([names, ids[alive[stay]]])
            if len(dist) > k:
                first = np.lexsort((names, dist))[:k]
                dist, names = dist[first], names[first]
            if len(dist) == k:
                radius = min(radius, dist.max())
        out += [(q, int(n), float(s)) for n, s in zip(names, dist, strict=True)]
    return out


class Index:
    """A fitted index over written rows (list, vec_id, embedding)."""

    def __init__(self, rows: DataFrame, model: bytes, sizes: dict[int, int]):
        self.rows, self.model, self.sizes = rows, model, sizes


def build_index(vectors: DataFrame, sample: int = SAMPLE, most_lists: int = MOST_LISTS) -> Index:
    rows = written(usable(vectors, nonzero=True).withColumn("order", F.xxhash64("vec_id", "embedding")), "ann-rows")
    lists = int(max(1, min(most_lists, round(rows.count() ** 0.5))))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [m for b in batches for m in matrices(b.column(0)).values()]
        if found:
            groups: dict[int, list] = {}
            for _, m in found:
                groups.setdefault(m.shape[1], []).append(m)
            total, first, model = sum(len(m) for _, m in found), 0, {}
            for d, parts in sorted(groups.items()):
                points = np.concatenate(parts)
                points = points[np.lexsort(points.T)]
                centres = fit_index(points, max(1, round(lists * len(points) / total)))
                model[d] = first, centres
                first += len(centres)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    picked = rows.orderBy("order", "vec_id").limit(sample).select("embedding").repartition(1)
    model = picked.mapInArrow(fit, "model binary").first()
    if model is None:
        return Index(rows.select(F.lit(0).alias("list"), "vec_id", "embedding", "order"), b"", {})
    shared = rows.sparkSession.sparkContext.broadcast(bytes(model.model))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(shared.value)
        for b in batches:
            for d, (at, points) in matrices(b.column(1)).items():
                first, centres = model.get(d, (-d, None))
                place = first + (nearest(points, centres)[:, 0] if centres is not None else np.zeros(len(at), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), *b.take(pa.array(at)).columns], names=["list", *b.schema.names])

    placed = rows.select("vec_id", "embedding", "order").mapInArrow(assign, "list int, vec_id bigint, embedding array<double>, order bigint")
    placed = written(placed, "ann-lists")
    # at most `most_lists` rows, and one for each length that the sample lacks
    sizes = {r["list"]: r["n"] for r in placed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    return Index(placed, bytes(model.model), sizes)


def search_index(index: Index, queries: DataFrame, k: int = K, probes: int = PROBES, share: float = PROBE_SHARE) -> DataFrame:
    """query_id, rank, vec_id, score for queries (query_id, embedding).

    A query probes `probes` lists or that share of all lists, whichever is more, and further ones where
    those hold fewer than 8 k rows. Vectors without clusters need a large share; clustered ones a small one.
    """
    spark = queries.sparkSession
    if not index.sizes:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    shared = spark.sparkContext.broadcast((index.model, index.sizes))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, sizes = pickle.loads(shared.value[0]), shared.value[1]
        for b in batches:
            for d, (at, points) in matrices(b.column(1)).items():
                first, centres = model.get(d, (-d, np.zeros((1, d))))
                rows_in = np.array([sizes.get(first + i, 0) for i in range(len(centres))])
                most = max(probes, int(np.ceil(share * len(centres))))
                for i in range(0, len(at), 256):
                    order = nearest(points[i : i + 256], centres, len(centres))
                    held = np.cumsum(rows_in[order], axis=1) - rows_in[order]
                    probed = ((np.arange(len(centres)) < most) | (held <= 8 * k)) & (rows_in[order] > 0)
                    row, place = np.nonzero(probed)
                    nth = np.cumsum(probed, axis=1)[row, place] - 1
                    kept = b.take(pa.array(at[i : i + 256][row]))
                    yield pa.RecordBatch.from_arrays(
                        [*kept.columns, pa.array(first + order[row, place], pa.int32()), pa.array(nth, pa.int32())], names=["query_id", "embedding", "list", "nth"]
                    )

    asked = queries.groupBy("query_id").agg(F.min("embedding").alias("embedding"))
    asked = written(asked.select("query_id", "embedding").mapInArrow(choose, "query_id bigint, embedding array<double>, list int, nth int"), "ann-probes")
    # at most `most_lists` rows: how often each list is probed, and into how many tiles it is cut
    probed = {r["list"]: r["n"] for r in asked.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    shape = [(i, 1 + n // TILE_ROWS, 1 + probed[i] // TILE_QUERIES) for i, n in index.sizes.items() if i in probed]
    cuts = F.broadcast(spark.createDataFrame(shape or [(-1, 1, 1)], "list int, parts int, blocks int"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    rows = index.rows.join(cuts, "list").withColumn("part", F.pmod("order", F.col("parts")).cast("int"))
    rows = rows.select("list", "part", "vec_id", "embedding", upto("blocks").alias("block"))
    asked = asked.join(cuts, "list").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
    asked = asked.select("list", "block", "query_id", "embedding", "nth", upto("parts").alias("part"))

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list = []
        if left.num_rows and right.num_rows:
            names = left["query_id"].to_numpy()
            ((_, wanted),), ((_, points),) = matrices(left["embedding"]).values(), matrices(right["embedding"]).values()
            radii = left["radius"].fill_null(np.inf).to_numpy()
            found = [(int(names[q]), n, s) for q, n, s in scan_list(points, right["vec_id"].to_numpy(), wanted, names, radii, k)]
        cols = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    def scanned(part: DataFrame) -> DataFrame:
        keys = ("list", "part", "block")
        return part.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(scan, _SCHEMA)

    first = written(scanned(asked.filter("nth = 0").withColumn("radius", F.lit(None).cast("double"))), "ann-first")
    radius = best(first, k, F.col("score")).groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.max("score")).alias("radius"))
    rest = asked.filter("nth > 0").join(radius, "query_id", "left")
    return best(first.unionByName(scanned(rest)), k, F.col("score"))


def nearest_neighbours(vectors: DataFrame, every: int = 100, k: int = K, probes: int = PROBES, share: float = PROBE_SHARE) -> DataFrame:
    """For every row whose id is divisible by `every`, its k nearest other rows found."""
    index = build_index(vectors)
    queries = index.rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return search_index(index, queries, k, probes, share)
