"""Merkle proofs against a tree that is kept whole, over strides and sizes around the subtree borders."""

import hashlib
import zlib
from collections import Counter
from dataclasses import replace

from helpers import hard_docs
from pyspark.sql import functions as F

from poolscope.llm import merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, source, lang, n_chars, text):
    cells = [None if x is None else str(x) for x in (doc_id, source, lang, n_chars, text)]
    return sha(*["-" if x is None else f"{len(x.encode())}:{x}" for x in cells])


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def climb(levels, at, node):
    """(siblings, root from `node`) of place `at`."""
    found = []
    for nodes in levels[:-1]:
        run = nodes[at // 2 * 2 : at // 2 * 2 + 2]
        found += run[: at % 2] + run[at % 2 + 1 :]
        run[at % 2] = node
        node, at = sha(*run), at // 2
    return found, node


def plain(rows):
    """Rows (doc_id, source, lang, n_chars, text) to a Counter of results."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = [(r, plain_leaf(*r)) for r in rows if r[2] == lang]
        own.sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[lang] = own, plain_tree([x for _, x in own])
    above = plain_tree([trees[x][1][-1][0] for x in langs])
    out = Counter()
    for k, lang in enumerate(langs):
        own, levels = trees[lang]
        for at, (r, leaf) in enumerate(own):
            bad = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            claim = plain_leaf(r[0], r[1], r[2], r[3] + 1, r[4]) if bad else leaf
            low, node = climb(levels, at, claim)
            high, node = climb(above, k, node)
            root = above[-1][0]
            out[(r[0], leaf, levels[-1][0], root, sha(*low, *high), node, node == root)] += 1
    return out


def results(docs, stride):
    claimed = F.when(F.crc32(docs["doc_id"].cast("string")) % 7 == 0, docs["n_chars"] + 1)
    got = merkle.prove(merkle.build_manifest(docs, claimed, stride))
    return Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got.collect())


def test_proofs_against_whole_trees(spark):
    rows = [(i * 3 - 40, f"s{i % 4}", ("en", "en", None, "é", "de")[i % 5] if i < 80 else "en", i if i % 9 else None, f"text {i}") for i in range(150)]
    rows += [(5, "x", "zz", 3, None)] + [(None, None, "en", 7, "")] * 3 + [(9, "a", "en", 1, "same")] * 40
    docs = spark.createDataFrame([(*r, 1, "t") for r in rows], "doc_id bigint, source string, lang string, n_chars bigint, text string, place int, tree string")
    assert results(docs, 3) == plain(rows)


def test_sizes_around_a_subtree(spark):
    for n in (1, 16, 17, 65):
        rows = [(i, "a", "en", i, str(i)) for i in range(n)]
        docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
        assert results(docs, 4) == plain(rows)


def test_hard_and_empty_rows(spark):
    docs = hard_docs(spark)
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]
    assert results(docs, 8) == plain(rows)
    assert not results(hard_docs(spark, []), 8)


def test_only_every_stride_is_stored(spark):
    docs = spark.range(300).selectExpr("id doc_id", "'a' source", "'en' lang", "id n_chars", "'x' text")
    manifest = merkle.build_manifest(docs, stride=4)
    assert [x.count() for x in manifest.languages.levels] == [300, 19, 2, 1]


def test_true_leaves_are_folded_too(spark):
    """A stored leaf or root that was changed after the tree was built fails the documents that lead over it, tampered or not."""
    docs = spark.range(60).selectExpr("id doc_id", "'a' source", "if(id < 40, 'en', 'de') lang", "id n_chars", "'x' text")
    manifest = merkle.build_manifest(docs, stride=3)
    assert all(r.verified for r in merkle.prove(manifest).collect())
    leaves = manifest.languages.levels[0]
    wrong = leaves.withColumn("digest", F.when(F.col("doc_id") == 17, F.sha2("digest", 256)).otherwise(F.col("digest")))
    bad = merkle.prove(replace(manifest, languages=merkle.Tree([wrong, *manifest.languages.levels[1:]]))).collect()
    assert {r.doc_id for r in bad if not r.verified} == set(range(16, 24))
    top = manifest.above.levels[-1].withColumn("digest", F.lit("0" * 64))
    bad = merkle.prove(replace(manifest, above=merkle.Tree([*manifest.above.levels[:-1], top]))).collect()
    assert len(bad) == 60 and not any(r.verified for r in bad) and {r.root for r in bad} == {"0" * 64}
    assert {r.folded_root for r in bad} == {r.root for r in manifest.above.roots.collect()}
