"""Vector columns in tasks, and the last step that all searches share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FOUND = "query_id bigint, vec_id bigint, score {}"


def usable(vectors: DataFrame, nonzero: bool = False) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that can be compared: with an id, and only finite components."""
    v = F.col("embedding")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    if nonzero:
        fine = fine & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("embedding"))
    return rows.filter(F.col("vec_id").isNotNull() & fine)


def spread(n: int) -> Column:
    """A group number below n, from a hash of the whole row, so that copies of a vector spread."""
    return F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(n)).cast("int")


def matrices(col: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """A list column by vector length: (row numbers, matrix)."""
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    size = np.asarray(arr.value_lengths())
    flat, start = np.asarray(arr.flatten()), np.concatenate([[0], np.cumsum(size)])
    out = {}
    for d in np.unique(size).tolist():
        rows = np.flatnonzero(size == d)
        out[d] = rows, flat[(start[rows][:, None] + np.arange(d)).ravel()].reshape(len(rows), d)
    return out


def best(found: DataFrame, k: int, order: Column) -> DataFrame:
    """The first k rows of each query by `order`, ties to the smaller vec_id."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(order, "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
