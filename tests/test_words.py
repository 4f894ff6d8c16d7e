"""Words, decoding and exact sums against Python integers."""

import random

from pyspark.sql import functions as F

from poolscope.functions import words as W
from poolscope.operators import decode as D


def hex_word(value: int) -> str:
    return format(value % (1 << 256), "064x")


def test_signed_and_unsigned_words(spark):
    rng = random.Random(7)
    values = [0, 1, -1, 10**18, -(10**18), 5 * 10**30, -12345678901234567890123, 2**124 - 1, -(2**124), 2**64, -(2**64)]
    values += [rng.randrange(-(2**120), 2**120) for _ in range(200)]
    df = spark.createDataFrame([(str(v), "0x" + hex_word(v)) for v in values], "v string, d string")
    out = df.select("v", W.signed_word(F.col("d"), 0).cast("string").alias("s"), W.word(F.col("d"), 0).cast("string").alias("u"))
    for row in out.collect():
        v = int(row.v)
        assert row.s == row.v, row
        assert row.u == (row.v if 0 <= v < 2**124 else None)


def test_wide_words_are_null_not_wrong(spark):
    df = spark.createDataFrame([("0x" + hex_word(v),) for v in (2**124, -(2**124) - 1, 2**255, 2**200)], "d string")
    assert [r[0] for r in df.select(W.signed_word(F.col("d"), 0)).collect()] == [None] * 4


def test_absent_partial_and_bad_words(spark):
    df = spark.createDataFrame([("0x",), ("0x12",), ("0x" + "zz" * 32,)], "d string")
    got = [r[0] for r in df.select(W.word(F.col("d"), 0)).collect()]
    assert got[0] == 0 and got[1] is None and got[2] is None
    flags = df.select(W.has_words(F.col("d"), 1)).collect()
    assert [r[0] for r in flags] == [False, False, True]


def test_price_word_keeps_its_size(spark):
    values = [0, 1, 2**96, 3 * 2**100 + 12345, 2**160 - 1]
    df = spark.createDataFrame([("0x" + hex_word(v),) for v in values], "d string")
    got = [r[0] for r in df.select(W.word_double(W.word_hex(F.col("d"), 0))).collect()]
    for v, g in zip(values, got):
        assert abs(g - v) <= v * 1e-15


def test_exact_sum_of_wide_and_narrow_words(spark):
    rng = random.Random(3)
    rows, expect = [], {}
    for _ in range(500):
        key = rng.randrange(4)
        value = rng.choice([rng.randrange(-(2**70), 2**70), rng.randrange(-(2**250), 2**250), -1, 0])
        rows.append((key, hex_word(value)))
        expect[key] = expect.get(key, 0) + value
    df = spark.createDataFrame(rows, "k int, w string")
    got = {r.k: int(r.total) for r in W.exact_sum(df, ["k"], "w").collect()}
    assert got == expect


def test_abi_string(spark):
    def encode(raw: bytes) -> str:
        return "0x" + hex_word(32) + hex_word(len(raw)) + raw.hex().ljust(64, "0")

    cases = {
        encode(b"CAKE"): "CAKE",
        encode("é🥞".encode()): "é🥞",
        encode(b"A\0B"): "AB",
        "0x": "",
        "0x" + hex_word(32): "",
        "0x" + hex_word(32) + "zz" * 32: "",
    }
    df = spark.createDataFrame([(a, t) for a, t in cases.items()], "a string, t string")
    for row in df.select("t", W.abi_string(F.col("a")).alias("got")).collect():
        assert row.got == row.t


def log(topics, words, block="0x10", address="0xAbC"):
    return (address, topics, "0x" + "".join(hex_word(w) for w in words), block, 3)


def test_v3_swap_decode_and_malformed_logs(spark):
    t = "0x" + "0" * 24
    logs = spark.createDataFrame(
        [
            log(["0xt0", t + "11" * 20, t + "AA" * 20], [100, -50, 2**96]),
            log(["0xt0", t + "11" * 20], [1, 2, 3]),
        ],
        "address string, topics array<string>, data string, block_number string, log_index int",
    )
    row = D.decode_v3_swaps(D.usable_logs(logs)).collect()
    assert len(row) == 1
    r = row[0]
    assert (r.pool, r.sender, r.recipient) == ("0xabc", "0x" + "11" * 20, "0x" + "aa" * 20)
    assert (int(r.amount0), int(r.amount1), r.sqrt_price, r.block_number) == (100, -50, float(2**96), 16)
    assert r.seq == (16 << 20) + 3


def test_cl_swap_decode_reads_the_event_fee(spark):
    t = "0x" + "0" * 24
    logs = spark.createDataFrame(
        [log(["0xt0", "0x" + "ee" * 32, t + "22" * 20], [-7, 9, 5, 0, 0, 980310])],
        "address string, topics array<string>, data string, block_number string, log_index int",
    )
    r = D.decode_cl_swaps(logs).first()
    assert (r.pool, r.trader, r.event_fee) == ("0x" + "ee" * 32, "0x" + "22" * 20, 980310)


def test_pool_keys(spark):
    def key(c0, c1, params, words=6):
        return "0x" + "".join(hex_word(x) for x in (c0, c1, 0, 5, 500, params))[: words * 64]

    df = spark.createDataFrame(
        [("a", key(0, 7, 1)), ("b", key(0, 0, 0)), ("c", key(1, 2, 3, 5)), ("d", None)], "pool string, key_raw string"
    )
    got = {r.pool: r for r in D.decode_pool_keys(df).collect()}
    assert got["a"].key_status == "ok" and got["a"].currency0 == "0x" + "0" * 40
    assert got["b"].key_status == "empty"
    assert got["c"].key_status is None and got["d"].key_status is None


def test_malformed_logs_are_counted_in_the_same_pass(spark):
    from pyspark.sql import Observation

    t = "0x" + "0" * 64
    logs = spark.createDataFrame([log([t, t, t], [1]), log([t], [1]), log([t, t], [1])], "address string, topics array<string>, data string, block_number string, log_index int")
    seen = Observation()
    assert D.usable_logs(logs, seen).count() == 1
    assert seen.get == {"logs": 3, "malformed_logs": 2, "unplaced_logs": 0}


def test_logs_without_a_place_in_their_block_do_not_fail_the_others(spark):
    from pyspark.sql import Observation

    t = "0x" + "0" * 64
    rows = [(*log([t, t, t], [1])[:-1], i) for i in (0, None, -1, 1 << 20, (1 << 20) - 1)]
    logs = spark.createDataFrame(rows, "address string, topics array<string>, data string, block_number string, log_index int")
    seen = Observation()
    assert sorted(r.log_index for r in D.decode_v3_swaps(D.usable_logs(logs, seen)).collect()) == [0, (1 << 20) - 1]
    assert seen.get == {"logs": 5, "malformed_logs": 3, "unplaced_logs": 3}


def test_order_key_refuses_to_wrap(spark):
    import pytest

    from poolscope.sources.logs import chain_order

    df = spark.createDataFrame([(5, 7), (5, 1 << 20)], "b bigint, i bigint")
    assert df.filter("i = 7").select(chain_order(F.col("b"), F.col("i"))).first()[0] == (5 << 20) + 7
    with pytest.raises(Exception, match="order key"):
        df.select(chain_order(F.col("b"), F.col("i"))).collect()
