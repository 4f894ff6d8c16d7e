"""Raw event logs derived from events: layout, scans, windows and decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolscope import config
from poolscope.functions import words as W
from poolscope.operators import decode as D
from poolscope.sources import logs as L
from poolscope.sources.state import shared_dir
from workload import derive as d
from workload.market import text
from workload.registry import query

_AMOUNT = "sgn * (cents * {unit} + log_index % {mod})"


def _word(expr: str) -> str:
    """A signed BIGINT as a 32-byte two's-complement word."""
    return f"concat(repeat(CASE WHEN {expr} < 0 THEN 'f' ELSE '0' END, 48), lpad(lower(hex({expr})), 16, '0'))"


def raw_logs(spark, sf, venue: str = "v3", wide_cl: bool = False, wide: bool = True) -> DataFrame:
    """Swap logs as a node returns them, with the awkward ones left in.

    Some logs lack a topic, some data fields stop after two words, some first amounts are 128 bits
    wider, and addresses come in mixed case.
    """
    amount0, amount1 = _AMOUNT.format(unit=10**14, mod=1009), "-" + _AMOUNT.format(unit=7 * 10**13, mod=1013)
    cfg = config.V3 if venue == "v3" else config.CL
    base = d.raw_swaps(spark, sf).selectExpr(
        "seq", "block_number", "log_index", "pool_id", "user_id", "price_milli", "event_fee",
        f"CAST({amount0} AS bigint) AS a0", f"CAST({amount1} AS bigint) AS a1",
    )
    trader = "concat(repeat('0', 24), '7a', lpad(CAST(user_id AS string), 38, '0'))"
    sqrt = "lpad(concat(lower(hex(price_milli)), repeat('0', 22)), 64, '0')"
    word0 = f"CASE WHEN seq % 7 = 3 THEN concat(substr({_word('a0')}, 33), repeat('0', 32)) ELSE {_word('a0')} END"
    if not wide:
        word0 = _word("a0")
    if venue == "v3":
        address = "concat(CASE WHEN seq % 2 = 0 THEN '0xB0' ELSE '0xb0' END, lpad(CAST(pool_id AS string), 38, '0'))"
        topics = f"array('{cfg.swap_topic0}', concat('0x', {trader}), concat('0x', upper({trader})))"
        data = f"concat('0x', {word0}, {_word('a1')}, CASE WHEN seq % 103 = 0 THEN '' ELSE {sqrt} END)"
    else:
        address = f"'{cfg.log_addresses[0]}'"
        topics = f"array('{cfg.swap_topic0}', concat('0x', lpad(CAST(pool_id AS string), 64, '0')), concat('0x', {trader}))"
        data = f"concat('0x', {word0 if wide_cl else _word('a0')}, {_word('a1')}, {sqrt}, repeat('0', 128), {_word('CAST(event_fee AS bigint)')}, repeat('0', 64))"
    return base.selectExpr(
        f"'{cfg.swap_topic0}' AS topic0",
        f"{address} AS address",
        f"CASE WHEN seq % 101 = 0 THEN slice({topics}, 1, 2) ELSE {topics} END AS topics",
        f"{data} AS data",
        "block_number",
        "log_index",
        "seq",
    )


_SENT = "'0x7a' || lpad(CAST(user_id AS VARCHAR), 38, '0')"


@query(
    "decode_v3",
    f"""WITH {d.SQL_SWAPS}
    SELECT seq, block_number, pool, trader AS sender, trader AS recipient,
      CASE WHEN seq % 7 <> 3 THEN CAST(amount0 AS VARCHAR) END AS amount0, CAST(amount1 AS VARCHAR) AS amount1,
      CASE WHEN seq % 103 = 0 THEN 0.0::DOUBLE ELSE sqrt_price END AS sqrt_price, seq % 103 = 0 AS short_row
    FROM swaps WHERE seq % 101 <> 0""",
)
def decode_v3(spark, sf):
    rows = D.decode_v3_swaps(D.usable_logs(raw_logs(spark, sf)))
    return rows.select(
        "seq", "block_number", "pool", "sender", "recipient", *text("amount0", "amount1"), "sqrt_price", "short_row"
    )


@query(
    "decode_cl",
    f"""WITH {d.SQL_SWAPS}
    SELECT seq, block_number, cl_pool AS pool, trader, CAST(amount0 AS VARCHAR) AS amount0,
      CAST(amount1 AS VARCHAR) AS amount1, sqrt_price, CAST(event_fee AS BIGINT) AS event_fee
    FROM swaps WHERE seq % 101 <> 0""",
)
def decode_cl(spark, sf):
    rows = D.decode_cl_swaps(D.usable_logs(raw_logs(spark, sf, "cl")))
    return rows.select("seq", "block_number", "pool", "trader", *text("amount0", "amount1"), "sqrt_price", "event_fee")


@query(
    "exact_sum",
    f"""WITH {d.SQL_SWAPS},
    parts AS (SELECT pool_id, coalesce(sum(amount0) FILTER (WHERE seq % 7 = 3), 0) AS wide,
                coalesce(sum(amount0) FILTER (WHERE seq % 7 <> 3), 0) AS narrow, count(*) FILTER (WHERE seq % 7 = 3) AS n
              FROM swaps GROUP BY pool_id)
    SELECT '0xb0' || lpad(CAST(pool_id AS VARCHAR), 38, '0') AS pool, n AS wide_rows, CAST(0 AS BIGINT) AS bad_rows,
      CAST(list_reduce(range(128), lambda a, i: a + a, CAST(wide AS BIGNUM)) + CAST(narrow AS BIGNUM) AS VARCHAR) AS total
    FROM parts""",
)
def exact_sum(spark, sf):
    logs = raw_logs(spark, sf).select(
        F.lower("address").alias("pool"), W.word_hex(F.col("data"), 0).alias("amount0_word")
    )
    return W.exact_sum(logs, ["pool"], "amount0_word")


_RANGE = (1_000_000, 3_000_000)
_PART = 500_000


@query(
    "scan_range",
    f"""WITH {d.SQL_SWAPS}
    SELECT pool, count(*) AS logs, min(block_number) AS first_block, max(block_number) AS last_block
    FROM swaps WHERE block_number BETWEEN {_RANGE[0]} AND {_RANGE[1]} AND pool_id IN (0, 1, 2, 3) GROUP BY pool""",
)
def scan_range(spark, sf):
    """Events of one kind, from given contracts, in an inclusive block range, out of stored logs."""
    wanted = ["0xb0" + str(p).rjust(38, "0") for p in range(4)]
    path = shared_dir(spark, "logs")
    L.write_logs(raw_logs(spark, sf), path, _PART)
    rows = L.read_logs(spark, path, config.V3.swap_topic0, wanted, _RANGE, _PART)
    return rows.groupBy(F.col("address").alias("pool")).agg(
        F.count(F.lit(1)).alias("logs"),
        F.min("block_number").alias("first_block"),
        F.max("block_number").alias("last_block"),
    )


@query(
    "window_assign",
    f"""WITH {d.SQL_SWAPS},
    runs AS (SELECT seq, block_number AS head, CASE WHEN seq % 97 = 0 THEN 0 ELSE greatest(0, block_number - seq % 500) END AS last FROM swaps)
    SELECT seq, head // 60000 AS window_id,
      CASE WHEN last = 0 OR head - last > 300 THEN greatest(1, head - 299) ELSE last + 1 END AS from_block,
      head AS to_block,
      CASE WHEN last > 0 AND head - last > 300 THEN head - 300 - last ELSE 0 END AS skipped,
      CASE WHEN last = 0 OR head - last > 300 THEN head < 1 ELSE head < last + 1 END AS is_empty
    FROM runs""",
)
def window_assign(spark, sf):
    """Grid window of each block, and the clamped window of a run whose cursor lags behind it."""
    rows = d.raw_swaps(spark, sf).selectExpr(
        "seq", "block_number", "CASE WHEN seq % 97 = 0 THEN 0 ELSE greatest(0, block_number - seq % 500) END AS last_block"
    )
    bounds = L.window_bounds(F.col("last_block"), F.col("block_number"), 300)
    named = L.assign_windows(rows, d.WINDOW_BLOCKS)
    return named.select("seq", "window_id", *[c.alias(n) for n, c in bounds.items()])


@query(
    "block_slices",
    f"""WITH {d.SQL_SWAPS},
    spans AS (SELECT block_number // 5760 AS hour_id, min(block_number) AS lo, max(block_number) AS hi FROM swaps GROUP BY 1),
    cut AS (SELECT hour_id, hi, unnest(range(lo, hi + 1, 25)) AS slice_from FROM spans)
    SELECT hour_id, slice_from, least(slice_from + 24, hi) AS slice_to FROM cut""",
)
def block_slices(spark, sf):
    """Every stretch of traded blocks cut into gap-free slices of at most 25."""
    spans = (
        d.blocks(spark, sf)
        .groupBy(F.expr("block_number div 5760").alias("hour_id"))
        .agg(F.min("block_number").alias("lo"), F.max("block_number").alias("hi"))
    )
    return L.block_slices(spans, 25).select("hour_id", "slice_from", "slice_to")


@query(
    "union_slices",
    f"""WITH {d.SQL_SWAPS}
    SELECT pool, count(*) AS logs, max(seq) AS last_seq FROM swaps GROUP BY pool""",
)
def union_slices(spark, sf):
    """Three range scans of the same logs, concatenated, cover every block once."""
    logs = raw_logs(spark, sf)
    cuts = [(0, 1_999_999), (2_000_000, 3_999_999), (4_000_000, 2**62)]
    parts = [L.select_logs(logs, config.V3.swap_topic0, None, c) for c in cuts]
    return L.union_slices(*parts).groupBy(F.lower("address").alias("pool")).agg(
        F.count(F.lit(1)).alias("logs"), F.max("seq").alias("last_seq")
    )


@query(
    "union_venues",
    f"""WITH {d.SQL_SWAPS}, both_venues AS (
      SELECT 'v3' AS venue, pool, trader, NULL AS event_fee FROM swaps
      UNION ALL SELECT 'cl', cl_pool, trader, event_fee FROM swaps)
    SELECT venue, pool, count(*) AS swaps, count(DISTINCT trader) AS traders, CAST(max(event_fee) AS BIGINT) AS max_fee
    FROM both_venues GROUP BY venue, pool""",
)
def union_venues(spark, sf):
    v3 = d.swaps(spark, sf).drop("event_fee")
    return L.all_swaps(v3, d.swaps(spark, sf, "cl")).groupBy("venue", "pool").agg(
        F.count(F.lit(1)).alias("swaps"),
        F.count_distinct("trader").alias("traders"),
        F.max("event_fee").alias("max_fee"),
    )


@query(
    "abi_string",
    """SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '' ELSE text END AS decoded FROM documents""",
)
def abi_string(spark, sf):
    """Whole texts, ABI-encoded and decoded back; a broken answer gives an empty string."""
    docs = d.table(spark, sf, "documents")
    raw = F.lower(F.hex(F.encode("text", "UTF-8")))
    size = F.lpad(F.lower(F.hex(F.octet_length("text").cast("bigint"))), 64, "0")
    answer = F.concat(F.lit("0x" + "0" * 62 + "20"), size, raw, F.lit("00" * 7))
    broken = F.when(F.col("doc_id") % 2 == 0, F.lit("0x")).otherwise(F.lit("0x" + "0" * 64))
    rows = docs.select("doc_id", F.when(F.col("doc_id") % 11 == 0, broken).otherwise(answer).alias("answer"))
    return rows.select("doc_id", W.abi_string(F.col("answer")).alias("decoded"))


@query(
    "pool_key",
    f"""WITH k AS (SELECT o_orderkey AS id, o_custkey AS c FROM orders),
    sides AS (SELECT id, CASE WHEN c % 5 = 0 THEN '{config.NATIVE_COIN}' WHEN c % 5 = 1 THEN '{config.USDT}'
                ELSE '0x70' || lpad(CAST(c AS VARCHAR), 38, '0') END AS c0,
               CASE WHEN c % 3 = 0 THEN '{config.USDC}' ELSE '0x71' || lpad(CAST(c AS VARCHAR), 38, '0') END AS c1 FROM k),
    named AS (SELECT *, c0 IN ('{config.NATIVE_COIN}', '{config.USDT}') AS k0, c1 = '{config.USDC}' AS k1,
                CASE WHEN id % 13 = 0 THEN NULL WHEN id % 17 = 0 THEN 'rejected' ELSE 'ok' END AS base FROM sides)
    SELECT '0x' || lpad(CAST(id AS VARCHAR), 64, '0') AS pool,
      CASE WHEN base = 'ok' THEN CASE WHEN k0 <> k1 THEN 'ok' ELSE 'rejected' END ELSE base END AS status,
      CASE WHEN base = 'ok' AND k0 <> k1 THEN CASE WHEN k0 THEN c1 ELSE c0 END END AS token,
      CASE WHEN base = 'ok' AND k0 <> k1 THEN CASE WHEN k0 THEN c0 ELSE c1 END END AS anchor,
      CASE WHEN base = 'ok' AND k0 <> k1 THEN k0 END AS anchor_is_token0
    FROM named""",
)
def pool_key(spark, sf):
    """Six-word pool keys of many ids -> pool dimension rows; too-short answers stay undecided."""
    orders = d.table(spark, sf, "orders").selectExpr("o_orderkey AS id", "o_custkey AS c")
    from poolscope.operators.pools import build_cl_pools

    strip = lambda e: f"lpad(substr({e}, 3), 64, '0')"
    c0 = f"""CASE WHEN c % 5 = 0 THEN '{config.NATIVE_COIN}' WHEN c % 5 = 1 THEN '{config.USDT}'
             ELSE concat('0x70', lpad(CAST(c AS string), 38, '0')) END"""
    c1 = f"CASE WHEN c % 3 = 0 THEN '{config.USDC}' ELSE concat('0x71', lpad(CAST(c AS string), 38, '0')) END"
    rows = orders.selectExpr(
        "concat('0x', lpad(CAST(id AS string), 64, '0')) AS pool",
        f"""concat('0x', {strip(c0)}, {strip(c1)}, repeat('0', 128), lpad(hex(500), 64, '0'),
              CASE WHEN id % 13 = 0 THEN '' WHEN id % 17 = 0 THEN repeat('0', 64) ELSE lpad('a0001', 64, '0') END) AS key_raw""",
    )
    return build_cl_pools(D.decode_pool_keys(rows)).select("pool", "status", "token", "anchor", "anchor_is_token0")
