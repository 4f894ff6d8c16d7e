r"""A Merkle manifest of documents, with most interior nodes left out.

Every document is a leaf, the SHA-256 of its columns. The leaves of a language ascend by doc_id; every two nodes in
a row have a parent, a last one alone has a parent of its own, and the one node that remains is the language's
subroot. The subroots, in the order of the languages, are the leaves of a tree above in the same way.

Checkpoint and recompute: only every `STRIDE`-th level of a tree is stored, as a table of (tree, place, digest). The
2^STRIDE stored nodes below one stored node are an aligned subtree, and that is the largest group that a task ever
holds. Building hashes a subtree up to its top and drops the levels between; a proof regenerates them from the
stored nodes, takes the siblings, and drops them again.

Places come from a range sort: a document's number in its partition, less the number at which its language begins
there, plus the rows of the language in earlier partitions (prefix sums over one row per partition and language).
So a language may hold any share of all rows. Texts are read once, in the JVM; everything after works on digests.

Defined cases: a null column counts as `-` and differs from an empty one; the documents without a language are a
tree of their own, first in order; a null doc_id sorts first, equal doc_ids sort by digest, and equal rows are
leaves of their own; empty input has no root and gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from poolscope.llm.shared import written

STRIDE = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(c: Column) -> Column:
    """A value with its length in front, or `-`."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[field(columns[c]) for c in FIELDS]), 256)


def digest(*nodes: str) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def level_above(nodes: list[str]) -> list[str]:
    return [digest(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]


def levels_of(nodes: list[str], first: int, count: int, stride: int) -> list[list[str]]:
    """The levels of one aligned subtree from its stored nodes up: `stride` of them, or up to the only node of the tree.

    The tree has `count` nodes on the stored level, `first` is the place of the first one here.
    """
    out = [nodes]
    alone = first == 0 and count == len(nodes)
    while len(out) <= stride and not (alone and len(out[-1]) == 1):
        out.append(level_above(out[-1]))
    return out


def siblings(levels: list[list[str]], at: int) -> list[str]:
    """The other node of each run from place `at` up, `L` or `R` in front for its side; empty where a run has one node."""
    out = []
    for nodes in levels[:-1]:
        other = at ^ 1
        out.append(("L" if other < at else "R") + nodes[other] if other < len(nodes) else "")
        at //= 2
    return out


def fold(node: str, path: list[str]) -> str:
    """The root that `node` leads to along its siblings."""
    for sibling in path:
        if not sibling:
            node = digest(node)
        elif sibling[0] == "L":
            node = digest(sibling[1:], node)
        else:
            node = digest(node, sibling[1:])
    return node


def numbered(rows: DataFrame, tree: list[str], order: list[Column], name: str) -> DataFrame:
    """`rows` with `place` (from 0, in order, per tree) and `count` (rows of the tree). `order` begins with the tree columns."""
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = written(sorted_rows.withColumns({"_n": F.monotonically_increasing_id(), "_part": F.spark_partition_id()}), name)
    parts = kept.groupBy(*tree, "_part").agg(F.min("_n").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    own = W.partitionBy(*tree)
    ahead = F.sum("_rows").over(own.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.withColumns({"_base": F.coalesce(ahead, F.lit(0)), "count": F.sum("_rows").over(own)})
    parts = parts.select(*[F.col(c).alias(f"_{c}") for c in tree], F.col("_part").alias("_p"), "_first", "_base", "count")
    same = F.col("_part") == F.col("_p")
    for c in tree:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    placed = kept.join(parts, same).withColumn("place", F.col("_n") - F.col("_first") + F.col("_base"))
    return placed.select(*rows.columns, "place", "count")


def subtrees(nodes: DataFrame, stride: int, extra: list[str]) -> DataFrame:
    """One row per aligned subtree of stored nodes (tree, place, count, digest): (tree, place, count, nodes).

    `nodes` is sorted by place and also holds `extra`; it has 2^stride elements at most.
    """
    top = F.expr(f"shiftright(place, {stride})")
    grouped = nodes.groupBy("tree", "count", top.alias("top"))
    return grouped.agg(F.sort_array(F.collect_list(F.struct("place", "digest", *extra))).alias("nodes"))


def tops(nodes: DataFrame, stride: int) -> DataFrame:
    """The stored level `stride` levels up, from every aligned subtree of one."""

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            made = [
                levels_of([n["digest"] for n in r["nodes"]], r["nodes"][0]["place"], r["count"], stride)[-1][0] for r in rows
            ]
            counts = [(r["count"] + (1 << stride) - 1) >> stride for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("tree"), batch.column("top"), pa.array(counts, pa.int64()), pa.array(made, pa.string())],
                names=["tree", "place", "count", "digest"],
            )

    return subtrees(nodes, stride, []).mapInArrow(climb, "tree bigint, place bigint, count bigint, digest string")


@dataclass
class Tree:
    """Stored levels from the leaves up; the last has one node for every tree."""

    levels: list[DataFrame]

    @property
    def roots(self) -> DataFrame:
        return self.levels[-1].select("tree", F.col("digest").alias("root"))


def build(leaves: DataFrame, stride: int, name: str) -> Tree:
    """Levels over stored leaves (tree, place, count, digest, ...). The number of levels is the only thing the driver learns."""
    levels = [leaves]
    most = leaves.agg(F.max("count")).first()[0] or 0
    while most > 1:
        below = levels[-1].select("tree", "place", "count", "digest")
        levels.append(written(tops(below, stride), f"{name}-{len(levels)}"))
        most = (most + (1 << stride) - 1) >> stride
    return Tree(levels)


def paths(tree: Tree, above: DataFrame, stride: int) -> DataFrame:
    """The path from every top of a leaf subtree up (tree, place, path), found level by level from the root down.

    `above` has a path for every tree (tree, path): what lies above its root.
    """
    path = above.select("tree", F.lit(0).cast("long").alias("place"), "path")
    for stored in reversed(tree.levels[1:-1]):
        path = _with_path(subtrees(stored, stride, []), path)
        path = path.mapInArrow(_descend(stride), "tree bigint, place bigint, path array<string>")
    return path


def _with_path(groups: DataFrame, path: DataFrame) -> DataFrame:
    return groups.join(path.withColumnRenamed("place", "top"), ["tree", "top"])


def _descend(stride: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                nodes = r["nodes"]
                first = nodes[0]["place"]
                levels = levels_of([n["digest"] for n in nodes], first, r["count"], stride)
                out += [(r["tree"], n["place"], siblings(levels, n["place"] - first) + r["path"]) for n in nodes]
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()))
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["tree", "place", "path"])

    return step


@dataclass
class Manifest:
    """`documents`: stored leaves (tree, place, count, digest, tampered, doc_id); the trees of the languages, and the one above."""

    languages: Tree
    above: Tree
    names: DataFrame
    stride: int


def build_manifest(docs: DataFrame, tampered: Column | None = None, stride: int = STRIDE) -> Manifest:
    """Hash and store all leaves and every `stride`-th level of all trees.

    `tampered` is an n_chars that replaces a document's own where it isn't null; its leaf is stored beside the true one.
    """
    own = {c: docs[c] for c in FIELDS}
    other = F.lit(None).cast("string") if tampered is None else F.when(tampered.isNotNull(), leaf(own | {"n_chars": tampered}))
    leaves = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].alias("lang"), leaf(own).alias("digest"), other.alias("tampered"),
        F.monotonically_increasing_id().alias("_row"),
    )
    # stored before the sort, so that its sample doesn't hash the texts again and equal rows keep their numbers
    leaves = written(leaves, "merkle-leaves")
    order = [F.col("lang").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("_row")]
    leaves = numbered(leaves, ["lang"], order, "merkle-sorted").drop("_row")
    langs = leaves.filter("place = 0").select("lang").withColumn("all", F.lit(0))
    langs = numbered(langs, ["all"], [F.col("lang").asc_nulls_first()], "merkle-languages")
    langs = written(langs.select("lang", F.col("place").alias("tree"), F.col("count").alias("trees")), "merkle-names")
    named = langs.withColumnRenamed("lang", "_lang")
    leaves = leaves.join(named, leaves.lang.eqNullSafe(named._lang)).select("tree", "place", "count", "digest", "tampered", "doc_id")
    languages = build(written(leaves, "merkle-placed"), stride, "merkle-level")
    subroots = languages.roots.join(langs, "tree")
    subroots = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.col("trees").alias("count"), F.col("root").alias("digest"))
    return Manifest(languages, build(written(subroots, "merkle-subroots"), stride, "merkle-above"), langs, stride)


def _leaf_paths(tree: Tree, above: DataFrame, stride: int, extra: list[str]) -> DataFrame:
    """Every leaf subtree with the path above its top. A tree of one leaf is its own top."""
    groups = subtrees(tree.levels[0], stride, extra)
    return _with_path(groups, paths(tree, above, stride))


def prove(manifest: Manifest) -> DataFrame:
    """Per document: leaf, subroot, root, the digest of its proof, and the root that its tampered or true leaf leads to."""
    stride = manifest.stride
    roots = manifest.above.roots.select("tree", F.array(F.col("root")).alias("path"))
    upper = _leaf_paths(manifest.above, roots, stride, []).mapInArrow(_descend(stride), "tree bigint, place bigint, path array<string>")
    # the path of a language ends in the root; its subroot goes in front of the path for the way down
    subroots = manifest.languages.roots
    known = upper.select(F.col("place").alias("tree"), "path").join(subroots, "tree")
    above = known.select("tree", F.concat(F.col("path"), F.array("root")).alias("path"))
    leaves = _leaf_paths(manifest.languages, above, stride, ["tampered", "doc_id"])
    kinds = [("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()),
             ("folded_root", pa.string()), ("verified", pa.bool_()), ("siblings", pa.int32())]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                *path, root, subroot = r["path"]
                nodes = r["nodes"]
                first = nodes[0]["place"]
                levels = levels_of([n["digest"] for n in nodes], first, r["count"], stride)
                for n in nodes:
                    whole = siblings(levels, n["place"] - first) + path
                    found = [s[1:] for s in whole if s]
                    folded = fold(n["tampered"] or n["digest"], whole)
                    out.append((n["doc_id"], n["digest"], subroot, root, digest(*found), folded, folded == root, len(found)))
            cols = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, kinds, strict=True)], names=[n for n, _ in kinds])

    schema = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, siblings int"
    return leaves.mapInArrow(finish, schema)
