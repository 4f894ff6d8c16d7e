"""Aggregates, series, scores, ranking and selection."""

import random

import pytest
from pyspark.sql import functions as F

from poolscope import config
from poolscope.functions import money as M
from poolscope.functions import rsi as R
from poolscope.operators import aggregate as A
from poolscope.operators import rank as K
from poolscope.operators import select as T
from poolscope.operators import series as S
from poolscope.operators.pools import anchor_side, attach_pools, build_v3_pools
from poolscope.plans.joins import join_dimension

SWAP = (
    "pool string, trader string, amount0 decimal(38,0), amount1 decimal(38,0), sqrt_price double, sqrt_price_word string, "
    "event_fee bigint, block_number bigint, seq bigint, window_id bigint"
)
POOL = "pool string, token string, anchor string, anchor_kind string, anchor_is_token0 boolean, fee_pips int"


def swap(pool="p", trader="x", a0=0, a1=0, price=1, fee=500, block=1, seq=1):
    from decimal import Decimal

    return (pool, trader, Decimal(a0), Decimal(a1), float(price), format(price, "064x"), fee, block, seq, 0)


def pools(spark, is0=True, fee=2500):
    return spark.createDataFrame([("p", "t", "a", "usd", is0, fee)], POOL)


def test_v3_aggregate(spark):
    rows = [
        swap(trader="x", a0=100, a1=-50, price=111, block=5, seq=1),
        swap(trader="y", a0=-30, a1=20, price=222, block=9, seq=2),
        swap(trader="x", a0=1_000_000, a1=-1, price=333, block=9, seq=3),
        swap(pool="unknown", a0=5),
    ]
    got = A.aggregate_v3(attach_pools(spark.createDataFrame(rows, SWAP), pools(spark))).collect()
    assert len(got) == 1
    r = got[0]
    assert (int(r.volume_anchor), r.swaps, r.traders) == (1_000_130, 3, 2)
    assert (int(r.fees0), int(r.fees1)) == (2500, 0)  # each swap truncates on its own
    assert (r.last_sqrt_price, r.last_block, int(r.last_sqrt_word, 16)) == (333.0, 9, 333)


def test_amounts_of_every_size_add_up_exactly(spark):
    rng = random.Random(11)
    rows, vol, f0, f1 = [], 0, 0, 0
    for i in range(400):
        size = 10 ** rng.randrange(1, 36)
        a0, a1 = rng.randrange(-size, size), rng.randrange(-size, size)
        rows.append(swap(a0=a0, a1=a1, seq=i))
        vol += abs(a1)
        f0 += a0 * 2500 // 10**6 if a0 > 0 else 0
        f1 += a1 * 2500 // 10**6 if a1 > 0 else 0
    df = spark.createDataFrame(rows, SWAP).repartition(4)
    r = A.aggregate_v3(attach_pools(df, pools(spark, is0=False))).first()
    assert (int(r.volume_anchor), int(r.fees0), int(r.fees1)) == (vol, f0, f1)


def test_cl_aggregate_ignores_absurd_fees_but_not_their_volume(spark):
    rows = [swap(a0=-1_000_000, fee=500, seq=1), swap(a0=2_000_000, fee=980310, seq=2)]
    r = A.aggregate_cl(attach_pools(spark.createDataFrame(rows, SWAP), pools(spark))).first()
    assert (int(r.volume_anchor), int(r.fees_anchor), r.last_fee_pips) == (3_000_000, 500, 500)


def test_salted_lookup_equals_the_plain_one(spark):
    rows = [swap(pool="p" if i % 3 else f"q{i}", seq=i) for i in range(300)]
    dim = spark.createDataFrame([("p", 1)] + [(f"q{i}", i) for i in range(0, 300, 6)], "pool string, v int")
    facts = spark.createDataFrame(rows, SWAP)
    for how in ("inner", "left"):
        plain = join_dimension(facts, dim, ["pool"], how, salt=1).select("seq", "v")
        salted = join_dimension(facts, dim, ["pool"], how, salt=8).select("seq", "v")
        assert sorted(map(str, plain.collect())) == sorted(map(str, salted.collect()))


def fold_volume(samples, keep=24, per_bucket=667):
    """Sequential model: history before each sample."""
    state, seen = None, []
    for bucket, volume, blocks in samples:
        if state is None:
            state = [bucket, volume, blocks, []]
        elif bucket == state[0]:
            state = [bucket, state[1] + volume, state[2] + blocks, state[3]]
        elif bucket > state[0]:
            past = state[3] + [(state[1], state[2])]
            for _ in range(bucket - state[0] - 1):
                if len(past) >= keep:
                    break
                past.append((0, per_bucket))
            state = [bucket, volume, blocks, past[-keep:]]
        seen.append((len(state[3]), sum(v for v, _ in state[3]), sum(b for _, b in state[3])))
    return seen


def fold_candles(samples, keep=30):
    state, seen = None, []
    for bucket, price in samples:
        if price is not None:
            if state is None:
                state = (bucket, price, [])
            elif bucket == state[0]:
                state = (bucket, price, state[2])
            elif bucket > state[0]:
                past = state[2] + [state[1]]
                for _ in range(bucket - state[0] - 1):
                    if len(past) >= keep:
                        break
                    past.append(state[1])
                state = (bucket, price, past[-keep:])
        seen.append(None if state is None else state[2] + [state[1]])
    return seen


def random_samples(seed, n_pools=12, n=70):
    rng = random.Random(seed)
    out = {}
    for p in range(n_pools):
        bucket, rows = rng.randrange(5), []
        for w in range(n):
            step = rng.choice([0, 0, 1, 1, 1, 2, rng.choice([5, 12, 40]), -1])
            bucket = max(0, bucket + step)
            price = None if rng.random() < 0.1 else rng.random() + 0.5
            rows.append((w, bucket, rng.randrange(1, 1000), price))
        out[f"p{p}"] = rows
    return out


SAMPLE = "pool string, window_id bigint, bucket bigint, volume_anchor decimal(38,0), window_blocks bigint, price double"


def sample_df(spark, data, windows=None):
    from decimal import Decimal

    rows = [
        (p, w, b, Decimal(v), 300, x) for p, rs in data.items() for w, b, v, x in rs if windows is None or w in windows
    ]
    return spark.createDataFrame(rows, SAMPLE).repartition(5)


@pytest.mark.parametrize("seed", [1, 2])
def test_volume_history_equals_the_sequential_fold(spark, seed):
    data = random_samples(seed)
    got = {(r.pool, r.window_id): r for r in S.volume_history(sample_df(spark, data)).collect()}
    for pool, rows in data.items():
        expect = fold_volume([(b, v, 300) for _, b, v, _ in rows])
        for (w, *_), (length, volume, blocks) in zip(rows, expect):
            r = got[pool, w]
            assert (r.history_len, int(r.history_volume), r.history_blocks) == (length, volume, blocks), (pool, w)


@pytest.mark.parametrize("seed", [3, 4])
def test_candle_series_equals_the_sequential_fold(spark, seed):
    data = random_samples(seed)
    got = {(r.pool, r.window_id): r.series for r in S.candle_series(sample_df(spark, data)).collect()}
    for pool, rows in data.items():
        for (w, *_), expect in zip(rows, fold_candles([(b, x) for _, b, _, x in rows])):
            assert got[pool, w] == expect, (pool, w)


def test_state_carries_history_across_batches(spark, tmp_path):
    data = random_samples(5, n_pools=6)
    whole_v = {(r.pool, r.window_id): (r.history_len, r.history_volume, r.history_blocks) for r in S.volume_history(sample_df(spark, data)).collect()}
    whole_c = {(r.pool, r.window_id): r.series for r in S.candle_series(sample_df(spark, data)).collect()}
    volumes = candles = None
    for i, span in enumerate((range(0, 20), range(20, 21), range(21, 55), range(55, 70))):
        part = sample_df(spark, data, set(span))
        history = S.volume_history(part, state=volumes)
        series = S.candle_series(part, state=candles)
        for r in history.filter(~F.col("_stored")).collect():
            assert (r.history_len, r.history_volume, r.history_blocks) == whole_v[r.pool, r.window_id]
        for r in series.filter(~F.col("_stored")).collect():
            assert r.series == whole_c[r.pool, r.window_id]
        S.volume_state(history).write.parquet(f"{tmp_path}/v{i}")
        S.candle_state(series).write.parquet(f"{tmp_path}/c{i}")
        volumes, candles = spark.read.parquet(f"{tmp_path}/v{i}"), spark.read.parquet(f"{tmp_path}/c{i}")
        assert volumes.groupBy("pool").count().agg(F.max("count")).first()[0] <= 25


def test_documented_gap_examples(spark):
    data = {"p": [(0, 10, 5, 1.0), (1, 14, 7, 2.0)]}
    row = S.volume_history(sample_df(spark, data)).filter("window_id = 1").first()
    assert (row.history_len, int(row.history_volume), row.history_blocks) == (4, 5, 300 + 3 * 667)
    assert S.candle_series(sample_df(spark, data)).filter("window_id = 1").first().series == [1.0] * 4 + [2.0]


def test_late_drop_and_keep_recent(spark):
    data = {"p": [(0, 5, 1, 1.0), (1, 4, 1, 1.0), (2, 5, 1, 1.0)], "q": [(1, 1, 1, 1.0)]}
    kept = {(r.pool, r.window_id) for r in S.late_drop(sample_df(spark, data)).collect()}
    assert kept == {("p", 0), ("p", 2), ("q", 1)}
    assert {r.pool for r in S.keep_recent(sample_df(spark, data), 1).collect()} == {"p"}


def wilder(prices, period=14):
    if len(prices) < period + 1:
        return 50
    deltas = [b - a for a, b in zip(prices, prices[1:])]
    gain = sum(max(d, 0) for d in deltas[:period]) / period
    loss = sum(max(-d, 0) for d in deltas[:period]) / period
    for d in deltas[period:]:
        gain = (gain * (period - 1) + max(d, 0)) / period
        loss = (loss * (period - 1) + max(-d, 0)) / period
    return 100 if loss == 0 else 100 - 100 / (1 + gain / loss)


def test_rsi(spark):
    rng = random.Random(2)
    series = [[rng.random() for _ in range(n)] for n in (1, 14, 15, 16, 31)] + [[1.0] * 20, [float(i) for i in range(20)]]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(series)], "i int, s array<double>")
    for r in df.select("i", "s", R.wilder_rsi(F.col("s")).alias("x"), R.rsi_value(F.col("s")).alias("v")).collect():
        assert abs(r.x - wilder(r.s)) < 1e-9
    values = [r.v for r in df.select("i", R.rsi_value(F.col("s")).alias("v")).orderBy("i").collect()]
    assert values[:2] == [None, None] and values[-2:] == [50, 100]


def test_spike(spark):
    rows = [
        (800, 10, 10**20, 4.0, 20.0),
        (800, 10, 10**18, 4.0, None),
        (800, 10, None, 4.0, None),
        (800, 10, 10**20, None, None),
        (800, 10, 10**20, 0.0, 999.0),
        (8000000, 10, 10**20, 1e-3, 999.0),
        (0, 10, 10**20, 4.0, None),
    ]
    df = spark.createDataFrame([(v, b, None if u is None else str(u), x, e) for v, b, u, x, e in rows], "v bigint, b bigint, u string, x double, e double")
    score = S.spike_score(F.col("v"), F.col("b"), F.col("u").cast("decimal(38,0)"), F.col("x"))
    for r in df.select("e", score.alias("s")).collect():
        assert r.s == r.e


def test_rank_orders(spark):
    rows = [("whale", 500, 3, 500, 1), ("busy", 2, 74, 2, 2), ("mid", 50, 20, None, 3), ("tie", 60, 20, 60, 4)]
    df = spark.createDataFrame(rows, "id string, volume_anchor bigint, swaps bigint, volume_usd bigint, first_seq bigint")
    df = df.withColumn("window_id", F.lit(0)).withColumn("spike", F.when(F.col("id") == "mid", 2.0))
    order = lambda by: [r.id for r in K.rank(df, by).orderBy("rank").collect()]
    assert order("swaps") == ["busy", "tie", "mid", "whale"]
    assert order("volume") == ["whale", "tie", "mid", "busy"]
    assert order("spike") == ["mid", "whale", "tie", "busy"]
    for by in ("swaps", "volume", "spike"):
        assert [r.id for r in df.orderBy(K.rank_key(by)).collect()] == order(by)


def walk(ranked, min_usd, per_group, budget):
    memo, main, danger, lookups, capped = {}, [], [], 0, False
    for row, token, fdv in ranked:
        if len(main) >= per_group and len(danger) >= per_group:
            break
        if token not in memo:
            if lookups >= budget:
                capped = True
                break
            memo[token] = fdv
            lookups += 1
        group = main if memo[token] is not None and memo[token] >= min_usd else danger
        if len(group) < per_group:
            group.append(row)
    return main, danger, lookups, capped


def test_budgeted_selection_equals_the_walk(spark):
    rng = random.Random(9)
    rows, expect = [], {}
    for board in range(400):
        n, n_tokens = rng.randrange(1, 25), rng.randrange(1, 9)
        ranked = [(i, f"t{rng.randrange(n_tokens)}", rng.choice([None, 1.0, 5.0, 9.0])) for i in range(n)]
        rows += [(board, i, t, f) for i, t, f in ranked]
        expect[board] = walk(ranked, 5.0, 3, 4)
    df = spark.createDataFrame(rows, "board int, pos int, token string, fdv double").repartition(6)
    got = T.select_by_fdv(df, F.struct("pos"), 5.0, 3, 4, board=("board",)).collect()
    seen = {}
    for r in sorted(got, key=lambda r: r.group_pos):
        entry = seen.setdefault(r.board, ([], [], r.lookups, r.capped))
        entry[0 if r.variant == "main" else 1].append(r.pos)
    assert seen == expect
    free = T.select_by_fdv(df, F.struct("pos"), 5.0, 3, None, board=("board",))
    assert free.filter("capped").count() == 0


def test_anchor_side_is_exclusive(spark):
    rows = [(config.WBNB.upper().replace("0X", "0x"), "0xT"), ("0xT", config.USDT), (config.WBNB, config.USDT), ("0xA", "0xB")]
    got = anchor_side(spark.createDataFrame(rows, "currency0 string, currency1 string")).collect()
    assert [(r.token, r.anchor, r.anchor_kind, r.anchor_is_token0) for r in got] == [
        ("0xt", config.WBNB, "bnb", True),
        ("0xt", config.USDT, "usd", False),
    ]


def test_pool_answers_are_three_valued(spark):
    def addr(a):
        return "0x" + a[2:].rjust(64, "0")

    token, pool, fee = "0x" + "12" * 20, "0x" + "ab" * 20, "0x" + format(2500, "064x")
    good = (addr(token), addr(config.USDT), fee, addr(pool))
    cases = [
        (good, "ok"),
        ((None, *good[1:]), None),
        (("0x", *good[1:]), "rejected"),
        ((*good[:1], addr(token), *good[2:]), "rejected"),
        ((*good[:2], None, good[3]), None),
        ((*good[:2], "0x", good[3]), "rejected"),
        ((*good[:3], None), None),
        ((*good[:3], addr(token)), "rejected"),
    ]
    for answers, status in cases:
        df = spark.createDataFrame([(pool, *answers)], "pool string, token0_raw string, token1_raw string, fee_raw string, registry_raw string")
        r = build_v3_pools(df).first()
        assert r.status == status
        assert (r.token is not None) == (status == "ok")


def test_money(spark):
    from decimal import Decimal

    big = 10**30
    rows = [(Decimal(big), "bnb", 2.0, 2 * big), (Decimal(5), "usd", None, 5), (Decimal(5), "bnb", None, None)]
    rows += [(Decimal(5), "bnb", bad, None) for bad in (0.0, -1.0, float("nan"), float("inf"))]
    rows.append((Decimal(-7), "bnb", 0.5, -3))
    df = spark.createDataFrame([(a, k, r, None if e is None else str(e)) for a, k, r, e in rows], "a decimal(38,0), k string, r double, e string")
    for r in df.select("e", M.to_usd(F.col("a"), F.col("k"), F.col("r")).cast("string").alias("u")).collect():
        assert r.u == r.e
    one = spark.range(1)
    fdv = M.fdv_usd(F.lit(0.001), F.lit(1e24), F.lit(18), F.lit(2000.0))
    assert abs(one.select(fdv).first()[0] - 2_000_000) < 1e-6
    for bad in (M.fdv_usd(F.lit(0.0), F.lit(1e24), F.lit(18), F.lit(1.0)), M.fdv_usd(F.lit(1.0), F.lit(1e24), F.lit(40), F.lit(1.0))):
        assert one.select(bad).first()[0] is None


def test_wide_mul_div(spark):
    from decimal import Decimal

    rng = random.Random(5)
    rows = [(Decimal(rng.randrange(-(10**n), 10**n)), rng.randrange(1, 10**6)) for n in range(1, 37) for _ in range(6)]
    df = spark.createDataFrame(rows, "x decimal(38,0), f bigint")
    for r in df.select("x", "f", M.mul_div(F.col("x"), F.col("f"), 10**6).alias("q")).collect():
        exact = abs(int(r.x)) * r.f // 10**6
        assert int(r.q) == (exact if r.x >= 0 else -exact)


def test_fees_to_anchor_beyond_256_bits(spark):
    rng = random.Random(1)
    cases = [(rng.randrange(10**30), rng.randrange(10**36), rng.randrange(2**80, 2**160), i % 2 == 0) for i in range(50)]
    cases.append((10, 20, 0, True))
    rows = [(str(a), str(b), format(p, "064x"), is0) for a, b, p, is0 in cases]
    df = spark.createDataFrame(rows, "a string, b string, w string, z boolean")
    got = df.select(M.fees_to_anchor(F.col("a"), F.col("b"), F.col("w"), F.col("z"))).collect()
    for (a, b, p, is0), r in zip(cases, got):
        if is0:
            expect = a + (0 if p == 0 else (b << 192) // (p * p))
        else:
            expect = b + ((a * p * p) >> 192)
        assert int(r[0]) == expect


def test_sketches_merge_to_any_span(spark):
    """Traders who come back are counted once over a span, and small counts are exact."""
    swaps = spark.range(60_000).selectExpr("concat('p', id % 3) pool", "id div 1000 bucket", "concat('t', id % 3, '-', (id div 3) % 7000) trader")
    sketches = A.trader_sketches(swaps, ["pool", "bucket"], "trader")
    every = {r.pool: r.traders for r in A.merge_traders(sketches, ["pool"]).collect()}
    assert all(abs(n - 7000) <= 0.05 * 7000 for n in every.values()) and len(every) == 3
    newest = {r.pool: r.traders for r in A.merge_traders(A.recent_buckets(sketches, 1), ["pool"]).collect()}
    assert all(abs(n - 333) <= 1 for n in newest.values())
    assert A.merge_traders(sketches.limit(0), ["pool"]).count() == 0
