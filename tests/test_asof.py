"""The as-of join against a plain search, and how it deals out a hot pool."""

import random
import re

import pytest

from poolscope.operators.asof import asof_join, asof_points, latest_per_block

EVENTS = "pool string, block_number bigint, seq bigint, price double, note string"


def plain(rows, events):
    out = []
    for name, pool, at in rows:
        ahead = [e for e in events if e[0] == pool and pool is not None and at is not None and e[1] is not None and e[1] <= at]
        best = max(ahead, key=lambda e: (e[1], e[2]), default=(None,) * 5)
        out.append((name, pool, at, best[3], best[4]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("salt", [1, 3])
@pytest.mark.parametrize("width", [1, 7, 4096])
def test_against_plain_search(spark, width, salt):
    rng = random.Random(width)
    events = [(rng.choice(["hot", "hot", "b", "c"]), rng.randrange(100, 160), i, rng.choice([None, float(i)]), f"n{i}") for i in range(150)]
    events += [(None, 5, 900, 1.0, "x"), ("b", None, 901, 1.0, "y")]
    rows = [(i, rng.choice(["hot", "b", "c", "never", None]), rng.choice([None, rng.randrange(90, 170)])) for i in range(200)]
    rows += [(7, "hot", 130)] * 60
    got = asof_join(
        spark.createDataFrame(rows, "name bigint, pool string, block_number bigint"), spark.createDataFrame(events, EVENTS), ["price", "note"], width=width, salt=salt
    )
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows, events)


def test_empty_sides_and_clashing_names(spark):
    rows, events = spark.createDataFrame([(1, "a", 5)], "name bigint, pool string, block_number bigint"), spark.createDataFrame([], EVENTS)
    assert [tuple(r) for r in asof_join(rows, events, ["price"]).collect()] == [(1, "a", 5, None)]
    assert asof_join(rows.limit(0), events, ["price"]).count() == 0
    with pytest.raises(ValueError, match="price"):
        asof_join(rows.withColumnRenamed("name", "price"), events, ["price"])


def test_a_hot_pool_is_dealt_to_stretches(spark):
    """A pool with all rows: no group before the window exceeds two rows per block of a stretch."""
    events = spark.range(6000).selectExpr("'hot' pool", "id div 4 block_number", "id seq", "id * 1.0D price")
    points = spark.range(4000).selectExpr("'hot' _key", "id % 1500 _block").distinct()
    found = asof_points(points, latest_per_block(events, ["price"], "pool", "block_number", "seq"), width=64)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_key" in plan
    windows = [re.sub(r"#\d+L?", "", line.rsplit(" AS ", 1)[1]) for line in plan.splitlines() if "Window [" in line]
    assert sorted(w.split("], [")[1] for w in windows) == ["_key", "_key, _stretch"]
    assert "_carry" in next(w for w in windows if "[_key]," in w)
    assert found.count() == 1500 and found.filter("_value.price <> _block * 4 + 3").count() == 0
