"""Near-duplicates against all pairs of a small table."""

import numpy as np
from helpers import HARD, hard_docs
from xxhash import xxh64_intdigest

from poolscope.llm import simhash


def plain_fingerprint(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(fps, ids):
    """Class of each row: the least id reachable over links of three bits or fewer."""
    n, up = len(fps), list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i in range(n):
        if ids[i] is not None:
            least[root(i)] = min(ids[i], least.get(root(i), ids[i]))
    return [least.get(root(i)) for i in range(n)]


def near(base, rng, flips):
    for b in rng.choice(64, flips, replace=False):
        base ^= 1 << int(b)
    return base


def test_hard_rows(spark):
    got = simhash.near_duplicates(hard_docs(spark)).collect()
    fps, ids = [plain_fingerprint(r[1]) for r in HARD], [r[0] for r in HARD]
    want = sorted(zip(map(str, ids), [f"{f:016x}" for f in fps], plain_classes(fps, ids), strict=True), key=str)
    assert sorted(((str(r.doc_id), r.fingerprint, r.component_id) for r in got), key=str) == want
    assert simhash.near_duplicates(hard_docs(spark, [])).count() == 0


def test_long_texts_with_repeats():
    for text in ("b a " * 40_000, "A", "a B", "x y z w " * 3):
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_classes_of_planted_fingerprints(spark):
    rng = np.random.default_rng(1)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 60)]
    for base in fps[:20]:
        fps += [near(base, rng, f) for f in (1, 2, 3, 3, 3, 4, 4, 5)]
    chain = fps[0]
    for _ in range(12):
        chain = near(chain, rng, 3)
        fps.append(chain)
    block = simhash.BLOCKS[1]  # three bits of one block, the others equal
    fps += [fps[5] ^ sum(1 << b for b in block[:3]), fps[6] ^ sum(1 << b for b in simhash.BLOCKS[2][-3:]), fps[7] ^ (1 << 63)]
    fps = [f & ((1 << 64) - 1) for f in fps] + fps[:5]
    ids = [int(x) for x in rng.permutation(len(fps))]
    rows = [(d, d * 7, simhash._signed(f)) for d, f in zip(ids, fps, strict=True)]
    prints = spark.createDataFrame(rows, "doc_id bigint, row bigint, fp bigint")
    got = {r.doc_id: r.component_id for r in prints.join(simhash.components(prints), "fp").collect()}
    assert got == dict(zip(ids, plain_classes(fps, ids), strict=True))


def test_crowded_keys_are_split(spark):
    """Thousands of fingerprints that agree outside one block: the recursion finds what all pairs find."""
    rng = np.random.default_rng(2)
    block = simhash.BLOCKS[0]
    fps = {0}
    while len(fps) < 700:
        fps.add(sum(1 << int(b) for b in rng.choice(block, int(rng.integers(1, 9)), replace=False)))
    fps = np.array(sorted(fps), np.uint64)
    split, pairs = simhash.Forest(len(fps)), simhash.Forest(len(fps))
    simhash.group_links(fps, block, split, np.arange(len(fps)), crowd=8)
    simhash.group_links(fps, block, pairs, np.arange(len(fps)), crowd=10_000)
    assert [split.root(i) for i in range(len(fps))] == [pairs.root(i) for i in range(len(fps))]


def test_keep_one_of_each_class(spark):
    docs = hard_docs(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    fps, every = [plain_fingerprint(r[1]) for r in HARD], [r[0] for r in HARD]
    want = {c for c in plain_classes(fps, every) if c is not None}
    assert len(ids) == len(set(map(str, ids))) and {i for i in ids if i is not None} == want
    assert ids.count(None) == sum(c is None for c in set(plain_classes(fps, every)))
