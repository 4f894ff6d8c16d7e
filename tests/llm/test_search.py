"""Vector searches against brute force."""

import numpy as np
import pytest

from poolscope.llm import ann, exact_topk

SCHEMA = "vec_id bigint, embedding array<double>, label int, list int, shard int, score double"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 1, 2, 3.0) for i, v in rows], SCHEMA)


def vectors(n, d=8, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.normal(size=d) * 0.3).tolist()) for i in range(n)]
    same = rows[3][1]
    rows = [(i, same) if i % 3 == 0 else (i, v) for i, v in rows]  # a third are one vector
    bad = [(1000, None), (1050, [0.1, None] + [0.0] * (d - 2)), (1100, [float("nan")] * d), (1150, [float("inf")] * d), (1200, []), (None, rows[1][1])]
    return [*rows, rows[7], rows[50], (1300, [0.5] * (d + 1)), (1350, [0.25] * (d + 1)), (1400, [0.0] * d), *bad]


def fine(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


def plain_top(rows, every, k):
    rows = [(i, np.floor(np.array(v) * 256).astype(int).tolist()) for i, v in rows if i is not None and fine(v)]
    out, queries = set(), {}
    for i, v in rows:
        if i % every == 0:
            queries[i] = min(v, queries.get(i, v))
    for q, v in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q and len(w) == len(v))
        out |= {(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)}
    return out


@pytest.mark.parametrize("shard_rows", [40, 10_000])
def test_exact_top_k(spark, shard_rows):
    rows = vectors(400)
    got = exact_topk.exact_top_k(table(spark, rows), shard_rows=shard_rows).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == plain_top(rows, 50, 5)
    assert len(got) == len(plain_top(rows, 50, 5))


def test_exact_top_k_small_and_large_values(spark):
    assert exact_topk.exact_top_k(table(spark, [])).count() == 0
    assert exact_topk.exact_top_k(table(spark, [(0, [1.0])])).count() == 0
    rows = [(0, [1e6, -1e6]), (1, [2e6, 1.0]), (2, [-1e7, 3e6]), (3, [0.0, 0.0])]
    got = exact_topk.exact_top_k(table(spark, rows)).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == plain_top(rows, 50, 5)
    huge = exact_topk.exact_top_k(table(spark, [(0, [1e30]), (1, [1e30]), (2, [-1e30])])).collect()
    assert [r.vec_id for r in sorted(huge, key=lambda r: r["rank"])] == [1, 2]


def test_tree_boxes_and_bounds():
    rng = np.random.default_rng(3)
    points = rng.integers(-50, 50, (500, 6)).astype(np.float64)
    tree = exact_topk.KdTree(points, leaf=16)
    queries = rng.integers(-50, 50, (9, 6)).astype(np.float64)
    bounds = tree.bounds(queries)
    assert sorted(tree.rows.tolist()) == list(range(500))
    for n, (a, b) in enumerate(tree.spans):
        assert (tree.lo[n] == tree.points[a:b].min(0)).all() and (tree.hi[n] == tree.points[a:b].max(0)).all()
        assert (tree.points[a:b] @ queries.T <= bounds[:, n] + 1e-9).all()
        if tree.children[n] is not None:
            c = tree.children[n]
            assert tree.spans[c] + tree.spans[c + 1] == (a, (a + b) // 2, (a + b) // 2, b) or tree.spans[c][1] == tree.spans[c + 1][0]


def test_ann_recall_and_scores(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 32))
    rows = [(i, (centres[i % 30] + 0.3 * rng.normal(size=32)).tolist()) for i in range(3000)]
    got = ann.nearest_neighbours(table(spark, rows)).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    x = np.array([v for _, v in rows])
    hits = 0
    for q in range(0, 3000, 100):
        dist = np.sqrt(((x - x[q]) ** 2).sum(1))
        dist[q] = np.inf
        want = np.argsort(dist, kind="stable")[:10].tolist()
        assert len(by[q]) == 10 and all(abs(dist[i] - s) < 1e-12 for i, s in by[q])
        assert [s for _, s in by[q]] == sorted(s for _, s in by[q])
        hits += len(set(want) & {i for i, _ in by[q]})
    assert hits >= 0.9 * 300


def test_ann_recall_on_the_given_vectors(spark):
    """Against brute force, over a table large enough that lists are left out."""
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in vectors.collect()]
    x, ids = np.array([v for _, v in rows], float), np.array([i for i, _ in rows])
    found = {}
    for r in ann.nearest_neighbours(vectors).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        dist = ((x - x[q]) ** 2).sum(1)
        dist[q] = np.inf
        hits += len(found[ids[q]] & set(ids[np.lexsort((ids, dist))[:10]].tolist()))
        total += 10
    assert hits >= 0.9 * total


def test_ann_hard_rows(spark):
    rows = vectors(400)
    got = ann.nearest_neighbours(table(spark, rows)).collect()
    asked = {i for i, v in rows if i is not None and i % 100 == 0 and fine(v) and any(v)}
    assert {r.query_id for r in got} == asked and 1300 in asked
    # lengths are searched apart: the two vectors of nine components find each other and nothing else
    assert [r.vec_id for r in got if r.query_id == 1300] == [1350]
    assert all(r.vec_id != r.query_id and r.vec_id not in (1300, 1350, 1400) for r in got if r.query_id != 1300)
    same = [r for r in got if r.query_id == 300]  # copies of one vector: ties by id
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(same, key=lambda r: r["rank"])] == [(n, 3 * (n - 1), 0.0) for n in range(1, 11)]
    assert ann.nearest_neighbours(table(spark, [])).count() == 0
    few = ann.nearest_neighbours(table(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0])])).collect()
    assert [(r.query_id, r.vec_id) for r in few] == [(0, 1)]


def test_ann_copies_over_many_chunks(spark):
    """One query in the tile and copies beyond a chunk: ties still go to the smallest ids."""
    rng = np.random.default_rng(1)
    same = rng.normal(size=24) * 3
    points = np.concatenate([np.tile(same, (3000, 1)), rng.normal(size=(500, 24))])
    ids = rng.permutation(3500)
    for asked in (1, 2, 5):
        queries, own = points[:asked], ids[:asked]
        got = ann.scan_list(points, ids, queries, own, np.full(asked, np.inf), 10)
        for q in range(asked):
            want = sorted(set(ids[:3000].tolist()) - {int(own[q])})[:10]
            assert [n for row, n, _ in got if row == q] == want
    rows = [(int(i), p.tolist()) for i, p in zip(ids[2000:3500], points[2000:3500], strict=True)] + [(5000 + i, rng.normal(size=3).tolist()) for i in range(40)]
    found = {}
    for r in sorted(ann.nearest_neighbours(table(spark, rows)).collect(), key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append(r.vec_id)
    copies = sorted(int(i) for i in ids[2000:3000])
    for q, names in found.items():
        if q in copies:
            assert names == [i for i in copies if i != q][:10]
    assert len(found[5000]) == 10 and min(found[5000]) > 5000
