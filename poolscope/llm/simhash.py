"""Near-duplicates by SimHash, joined by meet-in-the-middle ball hashing.

Fingerprints link at `RADIUS` = 3 or fewer differing bits. The bits are divided into three blocks. Two
linked fingerprints with three differing bits have one of them in some block; without that block at
most two bits differ, and with fewer differing bits that holds for any block. So for each block, every
fingerprint without the block emits all variants within half of two, one bit: itself and each bit
flipped, 131 keys in all. Two fingerprints link only if they meet in a key. Keys are shuffled, single
ones vanish, and the members that meet are verified on all 64 bits.

Fingerprints are made distinct first, so copies cost nothing, and a key's links are reported as a
spanning forest. When a key gathers more than `CROWD` fingerprints, its members are joined again by the
same method on the bits of the left-out block rather than pair by pair, so no group is compared in full.

Connected components follow by alternating star contractions on the distinct linked fingerprints.
Tables between the steps lie in the shared folder; nothing but counts comes to the driver.

Defined cases: a text without words, null or empty, has fingerprint zero and links like any other;
null doc_ids take part and get the component of their fingerprint, which is null only if it has no
other id; repeated rows are kept; empty input gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolscope.llm.shared import whole_row, written

SHINGLE = 3
HASH_SEED = 42
RADIUS = 3
CROWD = 64
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SIGN = 1 << 63


def _signed(v: int) -> int:
    return v - (1 << 64) if v & _SIGN else v


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """Unsigned fingerprint of a whole text."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode().translate(_LOWER).split()
    if not parts:
        return 0
    if len(parts) <= words:
        shingles = [b" ".join(parts)]
    else:
        shingles = map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False))
    hashes = np.fromiter((xxh64_intdigest(s, HASH_SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        block = hashes[i : i + (1 << 14)]
        ones += np.unpackbits(block.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(sum(1 << b for b in np.flatnonzero(2 * ones > len(hashes)).tolist()))


def row_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, `row` (a hash that names the row) and `fp`, the fingerprint as a signed long."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                fps = [_signed(fingerprint(t)) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fps, pa.int64())], names=["doc_id", "row", "fp"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row"), "text")
    return slim.mapInArrow(make, "doc_id bigint, row bigint, fp bigint")


def _blocks(bits: list[int], parts: int) -> list[list[int]]:
    return [bits[i * len(bits) // parts : (i + 1) * len(bits) // parts] for i in range(parts)]


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


BLOCKS = _blocks(list(range(64)), 3)


def ball_masks() -> list[tuple[int, int, int]]:
    """(left-out block, bits to keep, bits to flip) for every key of a fingerprint."""
    out = []
    for n, left_out in enumerate(BLOCKS):
        kept = [b for b in range(64) if b not in left_out]
        out += [(n, _mask(kept), flip) for flip in [0, *(1 << b for b in kept)]]
    return out


def _distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Forest:
    """Links that join two groups not yet joined."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def link(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((i, j))


def group_links(fps: np.ndarray, bits: list[int], forest: Forest, index: np.ndarray, crowd: int = CROWD) -> None:
    """Link the distinct fingerprints `fps` (places `index` in the forest) that lie within the radius.

    `bits` are the bits by which members of a large group are told apart further on.
    """
    n = len(fps)
    if n < 2:
        return
    if n <= crowd or len(bits) < 3:
        for k in range(n - 1):
            for m in np.flatnonzero(_distance(fps[k + 1 :], fps[k]) <= RADIUS):
                forest.link(int(index[k]), int(index[k + 1 + m]))
        return
    for left_out in _blocks(bits, 3):
        kept = [b for b in bits if b not in left_out]
        base = fps & np.uint64(_mask(kept))
        keys = np.concatenate([base ^ np.uint64(f) for f in [0, *(1 << b for b in kept)]])
        member = np.tile(np.arange(n), len(kept) + 1)
        order = np.argsort(keys, kind="stable")
        keys, member = keys[order], member[order]
        cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1:
                group_links(fps[member[a:b]], left_out, forest, index[member[a:b]], crowd)


def meeting_links(keys: DataFrame) -> DataFrame:
    """Verified links (a, b) among fingerprints (block, key, fp) that meet in a key, a spanning forest for each key."""

    def links(block: np.ndarray, key: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        cuts = _cuts(block, key)
        many = np.flatnonzero(np.diff(cuts) > 1)
        found = []
        for a, b in zip(cuts[many], cuts[many + 1], strict=True):
            group, forest = fps[a:b], Forest(int(b - a))
            group_links(group.view(np.uint64), BLOCKS[block[a]], forest, np.arange(b - a))
            found += [(int(min(group[i], group[j])), int(max(group[i], group[j]))) for i, j in forest.links]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not batch.num_rows:
                continue
            if kept is not None:
                cols = [np.concatenate(x) for x in zip(kept, cols, strict=True)]
            # the last key may go on in the next batch
            last = int(_cuts(cols[0], cols[1])[-2])
            kept = [c[last:] for c in cols]
            if last:
                yield links(*(c[:last] for c in cols))
        if kept is not None:
            yield links(*kept)

    placed = keys.repartition("block", "key").sortWithinPartitions("block", "key")
    return placed.select("block", "key", "fp").mapInArrow(verify, "a bigint, b bigint").distinct()


def _cuts(block: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where groups of equal (block, key) begin, and the end."""
    return np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (block[1:] != block[:-1]), True])


def star_components(edges: DataFrame) -> DataFrame:
    """(v, root): the smallest vertex that each vertex of the edges (a, b) reaches, by star contractions.

    Large stars join a vertex's greater neighbours to its least neighbour, small stars the rest. Both
    keep the components; rounds are few (about the logarithm of the longest path), until nothing changes.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "star")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = written(small.filter("u <> v").distinct(), "star")
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("v"), "root")


def components(prints: DataFrame) -> DataFrame:
    """fp, component_id and keep (the row that stands for the class) for a written table of fingerprints."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("least")
    members = written(prints.groupBy("fp").agg(least), "fingerprints")
    masks = F.array(*[F.struct(F.lit(n).cast("tinyint").alias("block"), F.lit(_signed(k)).alias("kept"), F.lit(_signed(f)).alias("flip")) for n, k, f in ball_masks()])
    keys = members.select("fp", F.explode(masks).alias("m"))
    keys = keys.select(F.col("m.block").alias("block"), F.col("fp").bitwiseAND(F.col("m.kept")).bitwiseXOR(F.col("m.flip")).alias("key"), "fp")
    roots = star_components(written(meeting_links(keys), "links"))
    named = members.join(roots, F.col("fp") == F.col("v"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = written(named, "roots")
    first = named.groupBy("root").agg(F.min("least").alias("first"))
    return named.join(first, "root").select("fp", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("keep"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (least doc_id of its class)."""
    prints = written(fingerprints(docs), "prints")
    found = prints.join(components(prints), "fp")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with one document of each class: the one with the least doc_id, nulls last.

    Of equal rows one stays. All columns are kept.
    """
    keep = components(written(fingerprints(docs), "prints")).select(F.col("keep").alias("_key")).distinct()
    rows = docs.select(whole_row(docs).alias("_row"), F.col("doc_id").alias("_id"), row_key().alias("_key"))
    stay = rows.join(keep, "_key", "left_semi")
    return stay.groupBy("_key", "_id").agg(F.first("_row").alias("_row")).select("_row.*")
