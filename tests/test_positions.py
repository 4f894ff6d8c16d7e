"""Ranges, position values, quotes and units."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from poolscope import config
from poolscope.functions import money as M
from poolscope.operators import positions as X


def test_documented_ranges(spark):
    df = spark.createDataFrame([(200843, 500)], "tick int, fee_pips int")
    below = X.plan_ranges(df, F.lit(5.0), F.lit("token1"), F.lit(1.0)).first()
    assert (below.tick_lower, below.tick_upper) == (200260, 200740)
    above = X.plan_ranges(df, F.lit(5.0), F.lit("token0"), F.lit(1.0)).first()
    assert above.tick_lower > 200843 and above.tick_upper > above.tick_lower
    band = X.plan_ranges(df, F.lit(10.0)).first()
    assert band.tick_lower <= 200843 - 953 and band.tick_upper >= 200843 + 953
    assert band.tick_lower % 10 == 0 and band.tick_upper % 10 == 0


def test_range_errors_and_bounds(spark):
    df = spark.createDataFrame([(0, 3000), (887270, 10000)], "tick int, fee_pips int")
    bad, edge = X.plan_ranges(df, F.lit(50.0)).orderBy("tick").collect()
    assert bad.range_error == "unsupported fee tier" and bad.tick_lower is None
    assert edge.tick_upper == config.MAX_TICK
    zero = X.plan_ranges(df, F.lit(0.0)).filter("fee_pips = 10000").first()
    assert zero.range_error is not None


def test_exact_values_equal_integer_maths(spark):
    sqrt = int(1.0001 ** (200843 / 2) * 2**96)
    rows = [
        (1, "p", 200260, 200740, Decimal(646075971053)),
        (2, "p", 100, 200, Decimal(10**20)),
        (3, "p", 300000, 300100, Decimal(10**20)),
        (4, "p", 200000, 201000, Decimal(10**20)),
        (5, "p", 5, 5, Decimal(1)),
        (6, "p", 1, 5, Decimal(0)),
    ]
    pos = spark.createDataFrame(rows, "token_id int, pool string, tick_lower int, tick_upper int, liquidity decimal(38,0)")
    prices = spark.createDataFrame([("p", float(sqrt), format(sqrt, "064x"))], "pool string, sqrt_price double, sqrt_price_word string")
    exact = {r.token_id: r for r in X.value_positions(pos, prices, exact=True).collect()}
    quick = {r.token_id: r for r in X.value_positions(pos, prices.drop("sqrt_price_word")).collect()}
    for i, _, lo, hi, size in rows[:4]:
        a, b = (int(1.0001 ** (t / 2) * 2.0**96) for t in (lo, hi))
        p = min(max(sqrt, a), b)
        e0 = 0 if p >= b else int(size) * (b - p) * 2**96 // (p * b)
        e1 = 0 if p <= a else int(size) * (p - a) // 2**96
        assert (int(exact[i].amount0), int(exact[i].amount1)) == (e0, e1)
        for e, got in ((e0, quick[i].amount0), (e1, quick[i].amount1)):
            assert abs(got - e) <= max(2.0, e * 1e-9)
    assert abs(int(exact[1].amount1) / 1e18 - 0.00035) < 0.00002
    assert exact[5].error == "empty range" and exact[5].amount0 is None and quick[5].amount0 is None
    assert (exact[6].amount0, exact[6].amount1) == ("0", "0")


@pytest.mark.parametrize(
    "typed, decimals, units",
    [("1.5", 6, 1500000), ("1,000", 2, 100000), (".5", 1, 5), ("5.", 0, 5), ("1.23", 1, None), ("", 2, None), (".", 2, None), ("-1", 2, None), ("1e5", 2, None)],
)
def test_units(spark, typed, decimals, units):
    df = spark.createDataFrame([(typed, decimals)], "t string, d int")
    got = df.select(M.to_base_units(F.col("t"), F.col("d"))).first()[0]
    assert (None if got is None else int(got)) == units


def test_units_back(spark):
    df = spark.createDataFrame([(Decimal(1500000), 6), (Decimal(5), 18), (Decimal(10**30), 18), (Decimal(7), 0)], "v decimal(38,0), d int")
    got = [r[0] for r in df.select(M.from_base_units(F.col("v"), F.col("d"))).collect()]
    assert got == ["1.5", "0", "1000000000000", "7"]


def test_exit_steps_and_rejections(spark):
    rows = [(1, 1000, 0, 100.0), (2, 1000, 0, 50.0), (3, 0, 5, 100.0), (4, 0, 0, 100.0), (5, 1, 0, 0.01), (6, 10, 0, 101.0)]
    df = spark.createDataFrame(
        [(i, "p", -1000, 1000, Decimal(n), Decimal(o), Decimal(0), p) for i, n, o, p in rows],
        "token_id int, pool string, tick_lower int, tick_upper int, liquidity decimal(38,0), owed0 decimal(38,0), owed1 decimal(38,0), p double",
    )
    prices = spark.createDataFrame([("p", 2.0**96)], "pool string, sqrt_price double")
    got = {r.token_id: r for r in X.exit_quotes(df, prices, F.col("p"), F.lit(1.0)).collect()}
    assert got[1].steps == ["withdraw", "collect", "burn"] and int(got[1].liquidity_out) == 1000
    assert got[2].steps == ["withdraw", "collect"] and int(got[2].liquidity_out) == 500
    assert got[3].steps == ["collect", "burn"]
    assert [got[i].error for i in (4, 5, 6)] == ["already empty", "rounds to zero liquidity", "percent out of range"]
    assert int(got[1].min0) == int(got[1].expected0) * 99 // 100


def test_approval_gap(spark):
    req = spark.createDataFrame([("o", "a", 10), ("o", "b", 10), ("o", "c", 0), ("o", "d", 10)], "owner string, token string, amount bigint")
    have = spark.createDataFrame([("o", "a", 9), ("o", "b", 10)], "owner string, token string, allowance bigint")
    assert sorted(r.token for r in X.approval_gap(req, have).collect()) == ["a", "d"]


def test_exact_amounts_run_in_batches(spark):
    """Awkward input as with limb columns: no liquidity counts as none, odd words and ranges give NULL."""
    from poolscope.functions import ticks as K

    q96, big = float(2**96), "f" * 40
    cases = [
        (5 * 10**30, 1.5 * q96, 2.0**191, big), (7, 0.0, q96, "0"), (10**37, 3.0, 1e57, "1" + "0" * 24), (None, 1.0, q96, "ff"), (-4, 1.0, q96, "ff"),
        (9, 2.0, 1.0, "ff"), (9, 1.0, 2.0**192, "ff"), (9, -1.0, 2.0, "ff"), (9, 1.0, q96, "xyz"), (9, 1.0, q96, ""), (9, None, q96, "ff"), (9, 1.0, float("nan"), "ff"),
    ]
    df = spark.createDataFrame([(i, str(c[0]) if c[0] is not None else None, *c[1:]) for i, c in enumerate(cases)], "i int, l string, a double, b double, w string")
    rows = df.withColumn("v", K.exact_amounts_between(F.col("l").cast("decimal(38,0)"), F.col("a"), F.col("b"), F.col("w"))).select("i", "v.*")
    text = rows._jdf.queryExecution().executedPlan().toString()
    assert text.count("ArrowEvalPython") == 1 and "aggregate(" not in text
    for r in rows.collect():
        size, a, b, word = cases[r.i]
        if r.i > 4:
            assert (r.amount0, r.amount1) == (None, None)
            continue
        held, a, b = max(size or 0, 0), int(a), int(b)
        p = min(max(int(word, 16), a), b)
        assert r.amount0 == (str(held * (b - p) * 2**96 // (p * b)) if p else None) and r.amount1 == str(held * (p - a) // 2**96)


def test_amounts_exact_makes_no_limbs(spark):
    """One Python step over the orders, and no lambda over arrays, which costs a hundred microseconds and more a row."""
    from workload import positions as Q

    text = Q.amounts_exact(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert text.count("ArrowEvalPython") == 1 and "lambdafunction" not in text
