"""Packing documents into training sequences along a space-filling curve.

Each document's token counts, hashed to `HASH_DIMS` buckets, are projected to a few dimensions by a
fixed random matrix; the Hilbert curve through those dimensions gives a sort key under which similar
documents lie close together. Documents are range-sorted by that key and laid end to end; every
`length` ids make a sequence. A document's place is the prefix sum of the parts before its own, so
only the very last sequence of the whole run is not full, however many partitions there are.

Encoded documents, and later their sorted order, are written to the shared folder: encoding runs
once although range sorting reads its input twice, and the parts whose sums give the places stay fixed.

Defined cases: null and empty texts consist of the end id alone; null doc_ids are ordinary values;
equal rows lie next to each other, each in pieces of its own; empty input gives no rows. Columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from poolscope.llm.shared import written

LENGTH = 2048
HASH_DIMS = 1024
CURVE_DIMS = 4
CURVE_BITS = 10
SEED = 88
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


def hilbert_key(axes: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of integer points, one per row, with `bits` bits per axis.

    The curve is followed from the coarsest bit down: each step reads one bit per axis in Gray-code
    order and then turns the finer bits into the frame of the entered sub-cube.
    """
    x = axes.astype(np.int64).copy()
    dims = x.shape[1]
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for d in range(dims):
            on = (x[:, d] & bit) != 0
            # set: mirror the first axis; clear: exchange the first axis with this one
            swap = np.where(on, 0, (x[:, 0] ^ x[:, d]) & low)
            x[:, 0] ^= np.where(on, low, swap)
            x[:, d] ^= swap
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    turn = np.zeros(len(x), np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[:, -1] >> level) & 1, (1 << level) - 1, 0)
    x ^= turn[:, None]
    key = np.zeros(len(x), np.int64)
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[:, d] >> level) & 1)
    return key


def curve_points(ids: list[np.ndarray], seed: int = SEED) -> np.ndarray:
    """Integer points of documents: hashed counts, scaled to length one, projected and squashed to the grid."""
    plane = np.random.default_rng(seed).standard_normal((HASH_DIMS, CURVE_DIMS))
    counts = np.stack([np.bincount(x % HASH_DIMS, minlength=HASH_DIMS) for x in ids]).astype(np.float64)
    norm = np.sqrt((counts * counts).sum(1, keepdims=True))
    flat = (counts / np.maximum(norm, 1)) @ plane
    return np.clip((1 / (1 + np.exp(-1.7 * flat))) * (1 << CURVE_BITS), 0, (1 << CURVE_BITS) - 1).astype(np.int64)


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, added: bool = False) -> DataFrame:
    """doc_id, ids (bytes, `width` each), n_tokens, curve (Hilbert key), tie (a hash that spreads equal keys)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from poolscope.llm.tokens import WordEncoder, encoder, slices

        enc = encoder(WordEncoder, tokenizer, added)
        end, width = np.array([end_id], enc.dtype).tobytes(), enc.dtype.itemsize
        for batch in batches:
            done = 0
            for some in slices(batch.column(1)):
                part = batch.slice(done, len(some))
                done += len(some)
                ids = [x + end for x in enc.encode(some.to_pylist())]
                points = [curve_points([np.frombuffer(x, enc.dtype) for x in ids[i : i + 512]]) for i in range(0, len(ids), 512)]
                curve = hilbert_key(np.concatenate(points), CURVE_BITS)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(2),
                        pa.array(ids, pa.binary()),
                        pa.array(np.full(len(ids), width), pa.int32()),
                        pa.array([len(x) // width for x in ids], pa.int64()),
                        pa.array(curve, pa.int64()),
                    ],
                    names=["doc_id", "tie", "ids", "width", "n_tokens", "curve"],
                )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("tie"))
    return slim.mapInArrow(encode, "doc_id bigint, tie bigint, ids binary, width int, n_tokens bigint, curve bigint")


def lay_out(encoded: DataFrame) -> DataFrame:
    """The documents sorted along the curve, with `place`: the ids of all documents before each."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, run = TaskContext.get().partitionId(), 0
        for batch in batches:
            ends = run + np.cumsum(batch.column("n_tokens").to_numpy())
            starts = ends - batch.column("n_tokens").to_numpy()
            run = int(ends[-1]) if len(ends) else run
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "ids", "width", "n_tokens")), pa.array(starts, pa.int64()), pa.array(np.full(len(ends), part), pa.int32())],
                names=["doc_id", "ids", "width", "n_tokens", "local", "part"],
            )

    order = ["curve", "tie"]
    ordered = encoded.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie", "curve")
    ordered = written(ordered.mapInArrow(number, "doc_id bigint, ids binary, width int, n_tokens bigint, local bigint, part int"), "pack-order")
    sums = ordered.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    # one row per partition of the sort
    return ordered.join(F.broadcast(bases), "part").select("doc_id", "ids", "width", "n_tokens", (F.col("base") + F.col("local")).alias("place"))


def cut_pieces(laid: DataFrame, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """One row per piece: which ids of which document lie where in which sequence. `ids` are 32-bit, little-endian."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, place = batch.column("n_tokens").to_numpy(), batch.column("place").to_numpy()
            width = batch.column("width").to_numpy()
            pieces = (place + n - 1) // length - place // length + 1
            row = np.repeat(np.arange(len(n)), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = place[row] // length + nth
            begin = np.maximum(place[row], sequence * length)
            start = begin - place[row]
            size = np.minimum(place[row] + n[row], (sequence + 1) * length) - begin
            crc, kept, last = np.empty(len(row), np.int64), [], -1
            for k, r in enumerate(row):
                if r != last:
                    ids, last = np.frombuffer(batch.column("ids")[int(r)].as_buffer(), f"<u{width[r]}").astype("<u4"), r
                piece = ids[start[k] : start[k] + size[k]].tobytes()
                crc[k] = zlib.crc32(piece)
                kept.append(piece if with_ids else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row)),
                    *(pa.array(v, pa.int64()) for v in (start, size, crc, n[row], sequence, begin - sequence * length)),
                    pa.array(kept, pa.binary()),
                ],
                names=[c.split()[0] for c in PIECES.split(", ")],
            )

    return laid.mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer: str, end_id: int, length: int = LENGTH, with_ids: bool = True, added: bool = False) -> DataFrame:
    """Pieces of all documents in packed sequences of `length` ids; `added` as in `write_token_files`."""
    encoded = written(encode_documents(docs, tokenizer, end_id, added), "pack-ids")
    return cut_pieces(lay_out(encoded), length, with_ids)


def sequences(pieces: DataFrame) -> DataFrame:
    """One row per sequence: its ids in order and the document of each stretch. A sequence has at most `length` pieces."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    rows = pieces.groupBy("sequence_id").agg(parts.alias("parts"))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p["ids"]))
    return rows.select("sequence_id", joined.alias("ids"), F.transform("parts", lambda p: F.struct(p["doc_id"], p["offset"], p["length"])).alias("stretches"))
