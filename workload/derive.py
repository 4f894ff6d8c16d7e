"""Swap-market tables derived from the given tables by Spark, and the same derivations as SQL text.

Swaps come from `events`: one swap per event, in event order. Pools 0-23 trade all the time; pools
24-47 take turns by block range, so their histories have gaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolscope import config
from poolscope.operators.pools import anchor_side

WINDOW_BLOCKS = 60_000
BUCKET_BLOCKS = 120_000
RATE = 612.5
Q88 = "309485009821345068724781056"
POOLS = 48

CFG = config.BoardConfig(
    blocks_per_bucket=BUCKET_BLOCKS,
    lookback_blocks=WINDOW_BLOCKS,
    rows_per_group=3,
    min_market_cap_usd=400_000.0,
    max_lookups=5,
    spike_floor_usd18=5 * 10**17,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_MICROS = """
CAST((datediff(CAST(ts AS date), DATE'2024-01-01') * 86400 + hour(ts) * 3600 + minute(ts) * 60
      + extract(SECOND FROM ts)) * 1000000 AS bigint)
"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their block number (0.45 s per block), independent of the session time zone."""
    ev = table(spark, sf_dir, "events")
    return ev.selectExpr("event_id", "user_id", "event_type", "value", f"({_MICROS}) div 450000 AS block_number")


def raw_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).selectExpr(
        "event_id AS seq",
        "event_id AS log_index",
        "block_number",
        "user_id",
        """CASE WHEN event_type IN ('error', 'purchase')
                THEN 24 + (user_id % 4) + 4 * ((block_number div 480000) % 6)
                ELSE user_id % 24 END AS pool_id""",
        "CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS sgn",
        "CAST(round(value * 100) AS bigint) AS cents",
        "CASE WHEN event_id % 53 = 0 THEN 0 ELSE 1000 + event_id % 977 END AS price_milli",
        """CASE event_type WHEN 'click' THEN 100 WHEN 'view' THEN 500 WHEN 'signup' THEN 2500
                WHEN 'error' THEN 980310 ELSE 10000 END AS event_fee""",
    )


def swaps(spark: SparkSession, sf_dir: str, venue: str = "v3") -> DataFrame:
    """Decoded swaps with a window id."""
    pool = (
        "concat('0xb0', lpad(CAST(pool_id AS string), 38, '0'))"
        if venue == "v3"
        else "concat('0x', lpad(CAST(pool_id AS string), 64, '0'))"
    )
    return raw_swaps(spark, sf_dir).selectExpr(
        f"'{venue}' AS venue",
        f"{pool} AS pool",
        "concat('0x7a', lpad(CAST(user_id AS string), 38, '0')) AS trader",
        "CAST(sgn * (cents * 100000000000000 + log_index % 1009) AS decimal(38,0)) AS amount0",
        "CAST(-sgn * (cents * 70000000000000 + log_index % 1013) AS decimal(38,0)) AS amount1",
        f"CAST(price_milli AS double) * {Q88}D AS sqrt_price",
        "lpad(concat(lower(hex(price_milli)), repeat('0', 22)), 64, '0') AS sqrt_price_word",
        "CAST(event_fee AS bigint) AS event_fee" if venue == "cl" else "CAST(NULL AS bigint) AS event_fee",
        "block_number",
        "log_index",
        "seq",
        f"block_number div {WINDOW_BLOCKS} AS window_id",
    )


def pool_name(pool_id: int) -> str:
    return "0xb0" + str(pool_id).rjust(38, "0")


def pool_pairs(spark: SparkSession, venue: str = "v3") -> DataFrame:
    """Currency pairs of the pools: token T = pool_id div 2; the anchor rotates with T."""
    width, prefix = (38, "0xb0") if venue == "v3" else (64, "0x")
    anchor = f"""CASE WHEN t % 12 IN (0, 1) THEN '{config.NATIVE_COIN}' WHEN t % 12 IN (2, 3) THEN '{config.WBNB}'
                      WHEN t % 12 BETWEEN 4 AND 7 THEN '{config.USDT}' WHEN t % 12 = 8 THEN '{config.USDC}'
                      WHEN t % 12 = 9 THEN '{config.USD1}' WHEN t % 12 = 10 THEN '{config.USDT}'
                      ELSE concat('0x71', lpad(CAST(t AS string), 38, '0')) END"""
    subject = f"CASE WHEN t % 12 = 10 THEN '{config.WBNB}' ELSE concat('0x70', lpad(CAST(t AS string), 38, '0')) END"
    return (
        spark.range(POOLS)
        .selectExpr("id AS pool_id", "id div 2 AS t")
        .selectExpr(
            "pool_id",
            f"concat('{prefix}', lpad(CAST(pool_id AS string), {width}, '0')) AS pool",
            "CAST(element_at(array(100, 500, 2500, 10000), CAST(pool_id % 4 + 1 AS int)) AS int) AS fee_pips",
            f"CASE WHEN pool_id % 2 = 0 THEN {anchor} ELSE {subject} END AS currency0",
            f"CASE WHEN pool_id % 2 = 0 THEN {subject} ELSE {anchor} END AS currency1",
        )
    )


def pools(spark: SparkSession, venue: str = "v3") -> DataFrame:
    return anchor_side(pool_pairs(spark, venue)).drop("currency0", "currency1", "pool_id")


def tokens(spark: SparkSession) -> DataFrame:
    """Supply and decimals; token 5 is missing, so its value is unknown."""
    return (
        spark.range(POOLS // 2)
        .filter("id <> 5")
        .selectExpr(
            "concat('0x70', lpad(CAST(id AS string), 38, '0')) AS token",
            "CAST(CASE WHEN id = 3 THEN 6 ELSE 18 END AS int) AS decimals",
            "CASE WHEN id = 3 THEN (id + 1) * 1e9D ELSE (id + 1) * 1e21D END AS supply_value",
            "CASE WHEN id % 3 = 0 THEN '' ELSE concat('TK', CAST(id AS string)) END AS symbol",
        )
    )


def audits(spark: SparkSession) -> DataFrame:
    return spark.range(POOLS // 2).filter("id % 4 <> 1").selectExpr(
        "concat('0x70', lpad(CAST(id AS string), 38, '0')) AS token",
        "id % 4 <> 2 AS verified",
        "CASE WHEN id % 4 = 2 THEN 'unknown' WHEN id % 8 = 0 THEN 'high' ELSE 'clean' END AS risk",
    )


def denied(spark: SparkSession) -> DataFrame:
    from poolscope.sources.reference import denylist_df

    return denylist_df(spark, extra=("0x70" + "7".rjust(38, "0"),))


# --- the same derivations as SQL ---

SQL_SWAPS = """
ev AS (
  SELECT event_id, user_id, event_type, value, (epoch_us(ts) - 1704067200000000) // 450000 AS block_number
  FROM events),
rawswaps AS (
  SELECT event_id AS seq, block_number, user_id,
    CASE WHEN event_type IN ('error', 'purchase')
         THEN 24 + (user_id % 4) + 4 * ((block_number // 480000) % 6) ELSE user_id % 24 END AS pool_id,
    CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS sgn,
    CAST(round(value * 100) AS BIGINT) AS cents,
    CASE WHEN event_id % 53 = 0 THEN 0 ELSE 1000 + event_id % 977 END AS price_milli,
    CASE event_type WHEN 'click' THEN 100 WHEN 'view' THEN 500 WHEN 'signup' THEN 2500
         WHEN 'error' THEN 980310 ELSE 10000 END AS event_fee
  FROM ev),
swaps AS (
  SELECT seq, block_number, pool_id, block_number // 60000 AS window_id,
    '0xb0' || lpad(CAST(pool_id AS VARCHAR), 38, '0') AS pool,
    '0x' || lpad(CAST(pool_id AS VARCHAR), 64, '0') AS cl_pool,
    '0x7a' || lpad(CAST(user_id AS VARCHAR), 38, '0') AS trader,
    sgn * (CAST(cents AS HUGEINT) * 100000000000000 + seq % 1009) AS amount0,
    -sgn * (CAST(cents AS HUGEINT) * 70000000000000 + seq % 1013) AS amount1,
    price_milli, CAST(price_milli AS DOUBLE) * 309485009821345068724781056.0::DOUBLE AS sqrt_price, event_fee
  FROM rawswaps)
"""

_NATIVE = config.NATIVE_COIN
SQL_POOLS = f"""
pool_ids AS (SELECT range AS pool_id, range // 2 AS t FROM range(48)),
pool_sides AS (
  SELECT pool_id, t,
    CASE WHEN t % 12 IN (0, 1) THEN '{_NATIVE}' WHEN t % 12 IN (2, 3) THEN '{config.WBNB}'
         WHEN t % 12 BETWEEN 4 AND 7 THEN '{config.USDT}' WHEN t % 12 = 8 THEN '{config.USDC}'
         WHEN t % 12 = 9 THEN '{config.USD1}' WHEN t % 12 = 10 THEN '{config.USDT}'
         ELSE '0x71' || lpad(CAST(t AS VARCHAR), 38, '0') END AS quote,
    CASE WHEN t % 12 = 10 THEN '{config.WBNB}' ELSE '0x70' || lpad(CAST(t AS VARCHAR), 38, '0') END AS subject,
    CASE pool_id % 4 WHEN 0 THEN 100 WHEN 1 THEN 500 WHEN 2 THEN 2500 ELSE 10000 END AS fee_pips
  FROM pool_ids),
pools AS (
  SELECT pool_id, t, subject AS token, quote AS anchor, fee_pips, pool_id % 2 = 0 AS is0,
    CASE WHEN t % 12 < 4 THEN 'bnb' ELSE 'usd' END AS anchor_kind,
    CASE WHEN t % 12 < 4 THEN 'wbnb' WHEN t % 12 BETWEEN 4 AND 7 THEN 'usdt' END AS board
  FROM pool_sides WHERE t % 12 < 10)
"""

SQL_AGG = (
    SQL_SWAPS
    + ","
    + SQL_POOLS
    + """,
agg AS (
  SELECT s.window_id, s.pool_id, s.pool, p.token, p.t, p.anchor, p.anchor_kind, p.board, p.is0, p.fee_pips,
    sum(abs(CASE WHEN p.is0 THEN amount0 ELSE amount1 END)) AS volume,
    count(*) AS swaps, count(DISTINCT trader) AS traders,
    sum(CASE WHEN amount0 > 0 THEN amount0 * p.fee_pips // 1000000 ELSE 0 END) AS fees0,
    sum(CASE WHEN amount1 > 0 THEN amount1 * p.fee_pips // 1000000 ELSE 0 END) AS fees1,
    arg_max(price_milli, seq) AS last_milli, arg_max(sqrt_price, seq) AS last_sqrt,
    arg_max(block_number, seq) AS last_block, min(seq) AS first_seq
  FROM swaps s JOIN pools p USING (pool_id)
  GROUP BY s.window_id, s.pool_id, s.pool, p.token, p.t, p.anchor, p.anchor_kind, p.board, p.is0, p.fee_pips)
"""
)

SQL_CL_AGG = (
    SQL_SWAPS
    + ","
    + SQL_POOLS
    + """,
agg AS (
  SELECT s.window_id, s.pool_id, s.cl_pool AS pool, p.token, p.t, p.anchor, p.anchor_kind, 'cl' AS board, p.is0,
    sum(abs(CASE WHEN p.is0 THEN amount0 ELSE amount1 END)) AS volume,
    count(*) AS swaps, count(DISTINCT trader) AS traders,
    coalesce(sum(abs(CASE WHEN p.is0 THEN amount0 ELSE amount1 END) * event_fee // 1000000)
             FILTER (WHERE event_fee <= 100000), 0) AS fees_anchor,
    arg_max(event_fee, seq) FILTER (WHERE event_fee <= 100000) AS fee_pips,
    arg_max(price_milli, seq) AS last_milli, arg_max(sqrt_price, seq) AS last_sqrt,
    arg_max(block_number, seq) AS last_block, min(seq) AS first_seq
  FROM swaps s JOIN pools p USING (pool_id)
  GROUP BY s.window_id, s.pool_id, s.cl_pool, p.token, p.t, p.anchor, p.anchor_kind, p.is0)
"""
)

# samples of the series, shared by both venues
SQL_SAMPLES = """
samples AS (
  SELECT *, last_block // 120000 AS bucket,
    CASE WHEN last_sqrt > 0 THEN
      CASE WHEN is0 THEN 1.0 / ((last_sqrt / pow(2, 96)) * (last_sqrt / pow(2, 96)))
           ELSE (last_sqrt / pow(2, 96)) * (last_sqrt / pow(2, 96)) END END AS price
  FROM agg)
"""

# the retained history as a sequential fold per sample, which is what the window form must equal
SQL_HISTORY = """
seen AS (
  SELECT pool, window_id,
    list({'b': bucket, 'v': volume}) OVER (PARTITION BY pool ORDER BY window_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS xs
  FROM samples),
folded AS (
  SELECT pool, window_id, list_reduce(xs, lambda a, x:
    CASE WHEN x.b = a.b THEN {'b': a.b, 'v': a.v + x.v, 'n': a.n + 60000, 'h': a.h}
         WHEN a.b < 0 THEN {'b': x.b, 'v': x.v, 'n': CAST(60000 AS BIGINT), 'h': a.h}
         WHEN x.b > a.b THEN {'b': x.b, 'v': x.v, 'n': CAST(60000 AS BIGINT), 'h': list_concat(list_concat(a.h, [{'v': a.v, 'n': a.n}]),
              [{'v': CAST(0 AS HUGEINT), 'n': CAST(120000 AS BIGINT)} for i in range(greatest(0, least(x.b - a.b - 1, 23 - len(a.h))))])[-24:]}
         ELSE a END,
    {'b': CAST(-1 AS BIGINT), 'v': CAST(0 AS HUGEINT), 'n': CAST(0 AS BIGINT), 'h': CAST([] AS STRUCT(v HUGEINT, n BIGINT)[])}) AS st
  FROM seen)
"""

# the candle closes as a sequential fold per sample, unpriced samples skipped
SQL_CANDLES = """
priced AS (
  SELECT pool, window_id,
    list({'b': bucket, 'p': price}) FILTER (WHERE price IS NOT NULL) OVER (PARTITION BY pool ORDER BY window_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS xs
  FROM samples),
closes AS (
  SELECT pool, window_id, list_reduce(xs, lambda a, x:
    CASE WHEN x.b = a.b THEN {'b': a.b, 'c': x.p, 'h': a.h}
         WHEN x.b > a.b AND a.b >= 0 THEN {'b': x.b, 'c': x.p, 'h': list_concat(list_concat(a.h, [a.c]),
              [a.c for i in range(greatest(0, least(x.b - a.b - 1, 29 - len(a.h))))])[-30:]}
         WHEN a.b < 0 THEN {'b': x.b, 'c': x.p, 'h': a.h}
         ELSE a END,
    {'b': CAST(-1 AS BIGINT), 'c': CAST(0 AS DOUBLE), 'h': CAST([] AS DOUBLE[])}) AS st
  FROM priced WHERE xs IS NOT NULL),
series AS (SELECT pool, window_id, list_concat(st.h, [st.c]) AS s FROM closes),
deltas AS (SELECT pool, window_id, s, [s[i + 1] - s[i] for i in range(1, len(s))] AS d FROM series),
rsi_avg AS (
  SELECT pool, window_id, s, CASE WHEN len(s) >= 15 THEN list_reduce(d[15:], lambda a, x:
      {'g': (a.g * 13 + greatest(x, 0)) / 14, 'l': (a.l * 13 + greatest(-x, 0)) / 14},
      {'g': list_sum([greatest(x, 0) for x in d[:14]]) / 14, 'l': list_sum([greatest(-x, 0) for x in d[:14]]) / 14}) END AS av
  FROM deltas),
rsi AS (
  SELECT pool, window_id, s, av, CASE WHEN len(s) < 15 THEN NULL WHEN list_min(s) = list_max(s) THEN 50
      WHEN av.l = 0 THEN 100 ELSE CAST(floor(100 - 100 / (1 + av.g / av.l) + 0.5) AS INTEGER) END AS rsi
  FROM rsi_avg)
"""

# dollar volume, spike and RSI of each sample
SQL_SCORED = """
scored AS (
  SELECT s.*, CASE WHEN anchor_kind = 'usd' THEN volume ELSE volume * 612500000 // 1000000 END AS volume_usd,
    CASE WHEN len(f.st.h) >= 3 THEN CAST(list_sum([x.v for x in f.st.h]) AS DOUBLE) / list_sum([x.n for x in f.st.h]) END AS baseline,
    r.rsi, CASE WHEN list_min(r.s) < list_max(r.s) AND r.rsi < 30 THEN 'oversold'
                WHEN list_min(r.s) < list_max(r.s) AND r.rsi > 70 THEN 'overbought' END AS rsi_label
  FROM samples s JOIN folded f USING (pool, window_id) LEFT JOIN rsi r USING (pool, window_id)),
spiked AS (
  SELECT *, CASE WHEN volume_usd >= 500000000000000000 AND baseline IS NOT NULL AND volume > 0
                 THEN CASE WHEN baseline <= 0 THEN 999.0 ELSE least(CAST(volume AS DOUBLE) / 60000 / baseline, 999.0) END END AS spike
  FROM scored)
"""


def sql_selected(order: str, min_usd: float = 400000.0, per_group: int = 3, max_lookups: int = 5) -> str:
    """The budgeted walk as running counts over a full ranking (a different form than ours)."""
    return f"""
valued AS (
  SELECT *, CASE WHEN t <> 5 AND price > 0 THEN
      (CASE WHEN t = 3 THEN (t + 1) * 1e9 / pow(10.0, 6) ELSE (t + 1) * 1e21 / pow(10.0, 18) END)
      * (price * (CASE WHEN t = 3 THEN pow(10.0, -12) ELSE 1.0 END))
      * (CASE WHEN anchor_kind = 'usd' THEN 1.0 ELSE 612.5 END) END AS fdv
  FROM spiked WHERE t <> 7 AND board IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY window_id, board ORDER BY {order}) AS rk FROM valued),
firsts AS (
  SELECT *, first_value(fdv) OVER w AS cap, CAST(row_number() OVER w = 1 AS INTEGER) AS is_first
  FROM ranked WINDOW w AS (PARTITION BY window_id, board, t ORDER BY rk)),
counted AS (
  SELECT *, sum(is_first) OVER (PARTITION BY window_id, board ORDER BY rk) AS k,
    CASE WHEN cap >= {min_usd} THEN 'main' ELSE 'danger' END AS variant FROM firsts),
walked AS (
  SELECT *, row_number() OVER (PARTITION BY window_id, board, variant ORDER BY rk) AS gp
  FROM counted WHERE k <= {max_lookups}),
filled AS (
  SELECT window_id, board, CASE WHEN count(*) FILTER (WHERE gp = {per_group}) = 2
      THEN max(rk) FILTER (WHERE gp = {per_group}) END AS full_rank
  FROM walked GROUP BY window_id, board),
totals AS (
  SELECT w.window_id, w.board, any_value(f.full_rank) AS full_rank,
    max(k) FILTER (WHERE f.full_rank IS NULL OR rk <= f.full_rank) AS lookups
  FROM walked w JOIN filled f USING (window_id, board) GROUP BY w.window_id, w.board),
cut AS (SELECT window_id, board, max(k) > {max_lookups} AS cut FROM counted GROUP BY window_id, board),
selected AS (
  SELECT w.*, t.lookups AS n_lookups, t.full_rank IS NULL AND c.cut AS capped
  FROM walked w JOIN totals t USING (window_id, board) JOIN cut c USING (window_id, board) WHERE gp <= {per_group})
"""


ORDER_SWAPS = "swaps DESC, volume_usd DESC NULLS LAST, volume DESC, first_seq"
ORDER_SPIKE = (
    "(spike IS NULL), spike DESC, CASE WHEN spike IS NULL THEN volume_usd END DESC NULLS LAST, volume DESC, first_seq"
)
