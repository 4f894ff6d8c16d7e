"""Shuffled shards, and mixing against its SQL and a plain walk."""

import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from helpers import HARD, hard_docs

from poolscope.llm import mixing, sharding
from poolscope.llm.queries import MIX_SQL


@pytest.mark.parametrize("bucket_bytes", [300, 1 << 24])
def test_shards(spark, bucket_bytes):
    docs = hard_docs(spark)
    kept = sharding.write_shards(docs, shards=4, bucket_bytes=bucket_bytes)
    got = sharding.shard_digest(kept, count=4).collect()
    want = Counter((str(r[0]), len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in HARD)
    assert Counter((str(r.doc_id), r.size, r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 4)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(4))
    shard = {}
    assert all(shard.setdefault(str(r.doc_id), r.shard) == r.shard for r in got)
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(r[:2] for r in HARD)


def test_shards_are_reproducible_and_shuffled(spark):
    docs = hard_docs(spark, [(i, f"text {i}", "en", "a") for i in range(800)])
    runs = [sharding.shard_digest(sharding.write_shards(d, bucket_bytes=400)).collect() for d in (docs, docs.repartition(7))]
    places = [{r.doc_id: (r.shard, r.slot) for r in run} for run in runs]
    assert places[0] == places[1]
    order = [d for d, _ in sorted(places[0].items(), key=lambda x: x[1])]
    rises = sum(a < b for a, b in zip(order, order[1:], strict=False))
    assert 300 < rises < 500  # a random order rises half the time
    assert sharding.shard_digest(sharding.write_shards(hard_docs(spark, []))).count() == 0


def plain_targets(sizes, weights=(3, 1, 2), share=1.5):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, share * sum(sizes.values()), set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if 2 * sizes[s] <= weight[s] * level}
        for s in full or free:
            target[s] = float(2 * sizes[s]) if full else weight[s] * level
        left -= sum(2 * sizes[s] for s in full)
        free = free - full if full else set()
    return target


def test_mix_of_hard_rows(spark, tmp_path):
    docs = hard_docs(spark)
    got = mixing.mix_counts(mixing.mix_plan(docs)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in HARD)
    sizes, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
        assert r.taken <= 2 * r.size
    want = plain_targets(sizes)
    assert all(abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source] for r in got)
    assert all(abs(taken[s] - want[s]) <= 2 * most[s] for s in sizes)
    docs.select("doc_id", "text", "source").coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    sql = con.execute(MIX_SQL).fetchall()
    assert Counter(tuple(r) for r in got) == Counter(sql)


def test_one_hot_source_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 20)
    rows = [(i, "w " * (i % 13), "en", "hot" if i % 3 else f"s{i % 4}") for i in range(600)]
    got = mixing.mix_counts(mixing.mix_plan(hard_docs(spark, rows))).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
    want = plain_targets(sizes)
    assert all(abs(taken[s] - want[s]) <= 26 for s in sizes)
    again = mixing.mix_counts(mixing.mix_plan(hard_docs(spark, rows).repartition(5))).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mixed_rows_are_whole_and_in_order(spark):
    docs = hard_docs(spark, [(i, f"w{i} " * (1 + i % 9), "en", f"s{i % 3}") for i in range(120)])
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    rows = mixed.collect()
    counts = {r.doc_id: r.copies for r in mixing.mix_counts(mixing.mix_plan(docs)).collect() if r.copies}
    assert Counter(r.doc_id for r in rows) == counts
    assert all(r.text == f"w{r.doc_id} " * (1 + r.doc_id % 9) for r in rows)
    # any stretch of the mix holds the sources about in the proportion of the whole
    half = Counter(r.source for r in rows[: len(rows) // 2])
    whole = Counter(r.source for r in rows)
    assert all(abs(2 * half[s] - whole[s]) <= 0.35 * whole[s] for s in whole)
    assert mixing.mix_counts(mixing.mix_plan(hard_docs(spark, []))).count() == 0
    assert mixing.mix_documents(hard_docs(spark, [])).count() == 0
