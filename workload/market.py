"""Aggregates, series, scores, rankings and whole boards over derived swaps."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from poolscope import config
from poolscope.functions import money as M
from poolscope.functions.rsi import wilder_rsi
from poolscope.operators import aggregate as A
from poolscope.operators import board as B
from poolscope.operators import rank as R
from poolscope.operators import select as T
from poolscope.operators import series as S
from poolscope.operators.pools import attach_pools
from poolscope.plans import market as P
from poolscope.sources import state as st
from workload import derive as d
from workload.registry import query


def text(*names: str) -> list:
    return [F.col(n).cast("string").alias(n) for n in names]


def v3_aggregate(spark, sf) -> DataFrame:
    return A.aggregate_v3(attach_pools(d.swaps(spark, sf), d.pools(spark)))


@query(
    "v3_agg",
    f"""WITH {d.SQL_AGG}
    SELECT window_id, pool, swaps, traders, CAST(volume AS VARCHAR) AS volume_anchor, CAST(fees0 AS VARCHAR) AS fees0,
      CAST(fees1 AS VARCHAR) AS fees1, last_block, last_sqrt AS last_sqrt_price FROM agg""",
)
def v3_agg(spark, sf):
    rows = v3_aggregate(spark, sf)
    return rows.select(
        "window_id", "pool", "swaps", "traders", *text("volume_anchor", "fees0", "fees1"), "last_block", "last_sqrt_price"
    )


@query(
    "cl_agg",
    f"""WITH {d.SQL_CL_AGG}
    SELECT window_id, pool, swaps, traders, CAST(volume AS VARCHAR) AS volume_anchor,
      CAST(fees_anchor AS VARCHAR) AS fees_anchor, CAST(fee_pips AS BIGINT) AS last_fee_pips, last_block FROM agg""",
)
def cl_agg(spark, sf):
    rows = A.aggregate_cl(attach_pools(d.swaps(spark, sf, "cl"), d.pools(spark, "cl")))
    return rows.select(
        "window_id", "pool", "swaps", "traders", *text("volume_anchor", "fees_anchor"), "last_fee_pips", "last_block"
    )


_SPANS = {"bucket": 1, "day": 24, "all": None}


@query(
    "traders_span",
    f"""WITH {d.SQL_SWAPS}, b AS (SELECT pool, block_number // 12000 AS bucket, trader FROM swaps),
    newest AS (SELECT pool, max(bucket) AS top FROM b GROUP BY pool),
    spans(span, n) AS (VALUES ('bucket', 1), ('day', 24), ('all', 1000000000))
    SELECT pool, span, CAST(count(DISTINCT bucket) AS BIGINT) AS buckets, CAST(count(DISTINCT trader) AS BIGINT) AS exact, TRUE AS within
    FROM b JOIN newest USING (pool), spans WHERE bucket > top - n GROUP BY pool, span""",
)
def traders_span(spark, sf):
    """Traders of a pool over its newest bucket, its newest 24 and all, from the same stored sketches, beside the exact count."""
    swaps = d.swaps(spark, sf).select("pool", "trader", F.floor(F.col("block_number") / 12_000).alias("bucket"))
    base = st.shared_dir(spark, "sketches")
    A.trader_sketches(swaps, ["pool", "bucket"], "trader").write.parquet(base)
    sketches, out = spark.read.parquet(base), None
    for span, n in _SPANS.items():
        own, rows = (sketches, swaps) if n is None else (A.recent_buckets(sketches, n), A.recent_buckets(swaps, n))
        exact = rows.groupBy("pool").agg(F.count_distinct("bucket").alias("buckets"), F.count_distinct("trader").alias("exact"))
        part = A.merge_traders(own, ["pool"]).join(exact, "pool").withColumn("span", F.lit(span))
        out = part if out is None else out.unionByName(part)
    # three standard errors
    close = F.abs(F.col("traders") - F.col("exact")) <= F.col("exact") * 0.05
    return out.select("pool", "span", "buckets", "exact", close.alias("within"))


# amounts of every seventh swap are 128 bits wider, as in `raw_logs`
def times(x: str, factor: int) -> str:
    """x * factor as BIGNUM, which only adds exactly: doubling and adding along the factor's bits."""
    bits = ", ".join(f"{factor:b}")
    return f"list_reduce([{bits}], lambda acc, bit: acc + acc + CASE WHEN bit = 1 THEN {x} ELSE CAST(0 AS BIGNUM) END, CAST(0 AS BIGNUM))"


def times_by(x: str, factor: str) -> str:
    """x * factor as BIGNUM for a factor column below 2^40, by doubling and adding."""
    return f"""list_reduce(list_prepend(CAST(0 AS BIGNUM), list_transform(range(40), lambda k: CASE WHEN ({factor} >> (39 - k)) & 1 = 1 THEN {x} ELSE CAST(0 AS BIGNUM) END)),
      lambda acc, x: acc + acc + x)"""


def wide_fee(fee: str, when: str) -> str:
    """Sum of trunc(a * fee / 10^6) over narrow amounts and trunc(a * 2^128 * fee / 10^6) over wide ones."""
    part = lambda expr, cond: f"CAST(coalesce(sum({expr}) FILTER (WHERE {when} AND {cond}), 0) AS BIGNUM)"
    ratio, rest = divmod(2**128, 10**6)
    return f"""CAST({part(f'a * {fee} // 1000000', 'NOT w')} + {times(part(f'a * {fee} // 1000000', 'w'), 2**128)}
      + {times(part(f'(a * {fee}) % 1000000', 'w'), ratio)} + {part(f'((a * {fee}) % 1000000) * {rest} // 1000000', 'w')} AS VARCHAR)"""


_WIDE_VOLUME = f"""CAST(CAST(coalesce(sum(abs(q)) FILTER (WHERE NOT qw), 0) AS BIGNUM)
  + {times('CAST(coalesce(sum(abs(q)) FILTER (WHERE qw), 0) AS BIGNUM)', 2**128)} AS VARCHAR)"""
WIDE_ROWS = """legs AS (
  SELECT s.*, p.fee_pips, CASE WHEN p.is0 THEN amount0 ELSE amount1 END AS q, p.is0 AND seq % 7 = 3 AS qw, seq % 7 = 3 AS w0
  FROM swaps s JOIN pools p USING (pool_id) WHERE seq % 101 <> 0)"""


def wide_swaps(spark, sf, venue: str) -> DataFrame:
    from poolscope.operators import decode as D
    from poolscope.sources import logs as L
    from workload.logs import raw_logs

    decode = D.decode_v3_swaps if venue == "v3" else D.decode_cl_swaps
    swaps = decode(D.usable_logs(raw_logs(spark, sf, venue, wide_cl=True)))
    return attach_pools(L.assign_windows(swaps, d.WINDOW_BLOCKS), d.pools(spark, venue))


@query(
    "v3_agg_wide",
    f"""WITH {d.SQL_SWAPS}, {d.SQL_POOLS}, {WIDE_ROWS},
    vol AS (SELECT window_id, pool, count(*) AS swaps, count(DISTINCT trader) AS traders, {_WIDE_VOLUME} AS volume_anchor,
              count(*) FILTER (WHERE w0) AS overflow_rows, coalesce(bool_or(qw), false) AS big FROM legs GROUP BY ALL),
    f0 AS (SELECT window_id, pool, {wide_fee('fee_pips', 'a > 0')} AS fees0 FROM (SELECT *, amount0 AS a, w0 AS w FROM legs) GROUP BY ALL),
    f1 AS (SELECT window_id, pool, {wide_fee('fee_pips', 'a > 0')} AS fees1 FROM (SELECT *, amount1 AS a, false AS w FROM legs) GROUP BY ALL)
    SELECT window_id, pool, swaps, traders, volume_anchor, NOT big AS volume_fits, fees0, fees1, overflow_rows
    FROM vol JOIN f0 USING (window_id, pool) JOIN f1 USING (window_id, pool)""",
)
def v3_agg_wide(spark, sf):
    """Decoded logs with 256-bit amounts: exact totals of any width, and no number where it does not fit."""
    rows = A.aggregate_v3(wide_swaps(spark, sf, "v3"), keep_limbs=True)
    names = ("volume_anchor", "fees0", "fees1")
    fits = F.col("volume_anchor").isNotNull().alias("volume_fits")
    return rows.select("window_id", "pool", "swaps", "traders", fits, "overflow_rows", *[A.exact_text(n).alias(n) for n in names])


@query(
    "cl_agg_wide",
    f"""WITH {d.SQL_SWAPS}, {d.SQL_POOLS}, {WIDE_ROWS},
    vol AS (SELECT window_id, cl_pool AS pool, count(*) AS swaps, {_WIDE_VOLUME} AS volume_anchor FROM legs GROUP BY ALL),
    fees AS (SELECT window_id, cl_pool AS pool, {wide_fee('event_fee', 'event_fee <= 100000')} AS fees_anchor
             FROM (SELECT *, abs(q) AS a, qw AS w FROM legs) GROUP BY ALL)
    SELECT * FROM vol JOIN fees USING (window_id, pool)""",
)
def cl_agg_wide(spark, sf):
    rows = A.aggregate_cl(wide_swaps(spark, sf, "cl"), keep_limbs=True)
    return rows.select("window_id", "pool", "swaps", *[A.exact_text(n).alias(n) for n in ("volume_anchor", "fees_anchor")])


def tables(spark, venue: str = "v3") -> P.MarketTables:
    tokens = d.tokens(spark)
    return P.MarketTables(
        pools=d.pools(spark, venue),
        tokens=tokens,
        denied=d.denied(spark),
        rate=d.RATE,
        symbols=tokens.select("token", "symbol"),
        audits=d.audits(spark),
    )


_BOARD_OUT = """
  CAST(window_id * 60000 AS BIGINT) AS from_block, CAST(window_id * 60000 + 59999 AS BIGINT) AS to_block, board, variant,
  CAST(gp AS INTEGER) AS group_pos, pool, token,
  CASE WHEN t % 3 = 0 OR t = 5 THEN substr(token, 1, 8) ELSE 'TK' || t END AS symbol,
  CAST(volume_usd AS VARCHAR) AS volume_usd, swaps, traders,
  CAST(CASE WHEN anchor_kind = 'usd' THEN fees ELSE fees * 612500000 // 1000000 END AS VARCHAR) AS fees_usd,
  CASE WHEN t % 4 <> 1 THEN t % 4 <> 2 END AS verified,
  CASE WHEN t % 4 <> 1 THEN CASE WHEN t % 4 = 2 THEN 'unknown' WHEN t % 8 = 0 THEN 'high' ELSE 'clean' END END AS risk,
  CASE fee_pips WHEN 100 THEN '0.01%' WHEN 500 THEN '0.05%' WHEN 2500 THEN '0.25%' WHEN 10000 THEN '1%' END AS fee_tier,
  rsi, rsi_label, round(cap, 2) AS market_cap_usd, round(spike, 6) AS spike, CAST(n_lookups AS INTEGER) AS lookups, capped
"""
_V3_FEES = """
fees_done AS (
  SELECT *, CASE WHEN is0 THEN fees0 + CASE WHEN last_milli = 0 THEN 0 ELSE fees1 * 65536 // (last_milli * last_milli) END
                 ELSE fees1 + fees0 * (last_milli * last_milli) // 65536 END AS fees FROM selected)
"""
BOARD_SQL = f"""WITH {d.SQL_AGG}, {d.SQL_SAMPLES}, {d.SQL_HISTORY}, {d.SQL_CANDLES}, {d.SQL_SCORED},
{d.sql_selected(d.ORDER_SWAPS)}, {_V3_FEES} SELECT window_id, {_BOARD_OUT} FROM fees_done"""
CL_BOARD_SQL = f"""WITH {d.SQL_CL_AGG}, {d.SQL_SAMPLES}, {d.SQL_HISTORY}, {d.SQL_CANDLES}, {d.SQL_SCORED},
{d.sql_selected(d.ORDER_SPIKE)}, fees_done AS (SELECT *, fees_anchor AS fees FROM selected)
SELECT window_id, {_BOARD_OUT} FROM fees_done"""


def shown(rows: DataFrame) -> DataFrame:
    """Board rows in comparable form: wide amounts as text, doubles rounded."""
    return rows.select(
        "window_id", "from_block", "to_block", "board", "variant", "group_pos", "pool", "token", "symbol",
        *text("volume_usd"), "swaps", "traders", *text("fees_usd"), "verified", "risk", "fee_tier", "rsi", "rsi_label",
        F.round("market_cap_usd", 2).alias("market_cap_usd"), F.round("spike", 6).alias("spike"), "lookups", "capped",
    )


@query("board_v3", BOARD_SQL)
def board_v3(spark, sf):
    return shown(P.board_rows(d.swaps(spark, sf), tables(spark), d.CFG))


# the board again, with each window's own rate from pool 2, whose first token is the native coin
_RATES = """rates AS (
  SELECT window_id, CASE WHEN p > 0 THEN (p / pow(2, 96)) * (p / pow(2, 96)) END AS rate,
    CASE WHEN p > 0 THEN CAST(floor((p / pow(2, 96)) * (p / pow(2, 96)) * 1000000 + 0.5) AS HUGEINT) END AS scaled
  FROM (SELECT window_id, arg_max(sqrt_price, seq) AS p FROM swaps WHERE pool_id = 2 GROUP BY window_id))"""
RATE_BOARD_SQL = (
    BOARD_SQL.replace("scored AS (\n  SELECT s.*,", f"{_RATES}, scored AS (\n  SELECT s.*, rates.rate, rates.scaled,")
    .replace("FROM samples s JOIN folded f", "FROM samples s LEFT JOIN rates USING (window_id) JOIN folded f")
    .replace("612500000", "scaled")
    .replace("612.5", "rate")
)


@query("board_v3_rate", RATE_BOARD_SQL)
def board_v3_rate(spark, sf):
    swaps = d.swaps(spark, sf)
    prices = A.last_value(swaps, ["window_id", "pool"], ["sqrt_price"])
    pairs = d.pool_pairs(spark).select("pool", F.lit(config.WBNB).alias("token0"))
    rates = P.native_rate(prices, pairs, rate_pool=d.pool_name(2))
    return shown(P.board_rows(swaps, dataclasses.replace(tables(spark), rate=rates), d.CFG))


@query("board_cl", CL_BOARD_SQL)
def board_cl(spark, sf):
    return shown(P.board_rows(d.swaps(spark, sf, "cl"), tables(spark, "cl"), d.CFG, config.CL))


# --- aggregates over line items: pool = part, trader = supplier, order-insensitive figures only ---


@query(
    "lineitem_agg",
    """WITH s AS (SELECT l_partkey AS pool, l_suppkey AS trader, l_partkey % 4 AS f,
        CAST(round(l_extendedprice * 100) AS HUGEINT) * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * 10000000000000000 AS amt FROM lineitem)
    SELECT pool, CAST(sum(abs(amt)) AS VARCHAR) AS volume_anchor, count(*) AS swaps, count(DISTINCT trader) AS traders,
      CAST(sum(CASE WHEN amt > 0 THEN amt * CASE f WHEN 0 THEN 100 WHEN 1 THEN 500 WHEN 2 THEN 2500 ELSE 10000 END // 1000000 ELSE 0 END) AS VARCHAR) AS fees0
    FROM s GROUP BY pool""",
)
def lineitem_agg(spark, sf):
    """The per-pool aggregate over many pools: one per part, with its fee tier joined from the part table."""
    items = d.table(spark, sf, "lineitem").selectExpr(
        "l_partkey AS pool",
        "l_suppkey AS trader",
        """CAST(CAST(round(l_extendedprice * 100) AS decimal(18,0)) * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END
             * 10000000000000000 AS decimal(38,0)) AS amount0""",
        "CAST(0 AS decimal(38,0)) AS amount1",
        "CAST(0 AS double) AS sqrt_price",
        "CAST(0 AS bigint) AS block_number",
        "xxhash64(l_orderkey, l_linenumber, l_suppkey, l_shipdate, l_extendedprice) AS seq",
    )
    dim = d.table(spark, sf, "part").selectExpr(
        "p_partkey AS pool", "p_name AS token", "'usdt' AS anchor", "'usd' AS anchor_kind", "true AS anchor_is_token0",
        "element_at(array(100, 500, 2500, 10000), CAST(p_partkey % 4 + 1 AS int)) AS fee_pips",
    )
    rows = A.aggregate_v3(attach_pools(items, dim), keys=["pool"])
    return rows.select("pool", *text("volume_anchor"), "swaps", "traders", *text("fees0"))


# --- series ---


def samples(spark, sf) -> DataFrame:
    return P.pool_samples(d.swaps(spark, sf), d.pools(spark), d.CFG)


_BASE = f"WITH {d.SQL_AGG}, {d.SQL_SAMPLES}"


@query(
    "bucket_volume",
    f"""{_BASE} SELECT pool, bucket, CAST(sum(volume) AS VARCHAR) AS volume, CAST(count(*) * 60000 AS BIGINT) AS blocks,
      count(*) AS samples FROM samples GROUP BY pool, bucket""",
)
def bucket_volume(spark, sf):
    rows = S.bucket_volume(samples(spark, sf))
    return rows.select("pool", "bucket", *text("volume"), "blocks", "samples")


def shuffled_samples(spark, sf) -> DataFrame:
    """Samples whose bucket sometimes falls back by two, as after a reorganisation."""
    back = F.expr("CASE WHEN (window_id + pool_no) % 7 = 0 THEN 2 ELSE 0 END")
    number = F.substring("pool", 5, 38).cast("bigint").alias("pool_no")
    rows = samples(spark, sf).select("*", number)
    return rows.withColumn("bucket", F.greatest(F.col("bucket") - back, F.lit(0))).drop("pool_no")


_SHUFFLED = """shuffled AS (SELECT * REPLACE (greatest(bucket - CASE WHEN (window_id + pool_id) % 7 = 0 THEN 2 ELSE 0 END, 0) AS bucket) FROM samples)"""


@query(
    "late_drop",
    f"""{_BASE}, {_SHUFFLED} SELECT pool, window_id, bucket, CAST(volume AS VARCHAR) AS volume_anchor FROM shuffled a
    WHERE NOT EXISTS (SELECT 1 FROM shuffled b WHERE b.pool = a.pool AND b.window_id < a.window_id AND b.bucket > a.bucket)""",
)
def late_drop(spark, sf):
    rows = S.late_drop(shuffled_samples(spark, sf))
    return rows.select("pool", "window_id", "bucket", *text("volume_anchor"))


@query(
    "candles",
    f"""{_BASE}, {_SHUFFLED}, ok AS (SELECT * FROM shuffled WHERE price IS NOT NULL),
    kept AS (SELECT *, max(bucket) OVER (PARTITION BY pool ORDER BY window_id) AS top FROM ok)
    SELECT pool, bucket, round(arg_max(price, window_id), 9) AS close, max(window_id) AS last_window
    FROM kept WHERE bucket = top GROUP BY pool, bucket""",
)
def candles(spark, sf):
    rows = S.candles(shuffled_samples(spark, sf))
    return rows.select("pool", "bucket", F.round("close", 9).alias("close"), "last_window")


@query(
    "candle_series",
    f"""{_BASE}, {d.SQL_CANDLES}
    SELECT pool, window_id, len(s) AS points, round(s[1], 9) AS oldest, round(s[-1], 9) AS newest, round(list_sum(s), 6) AS total
    FROM series""",
)
def candle_series(spark, sf):
    rows = S.candle_series(samples(spark, sf)).filter(F.col("series").isNotNull())
    total = F.aggregate("series", F.lit(0.0), lambda a, x: a + x)
    return rows.select(
        "pool",
        "window_id",
        F.size("series").cast("bigint").alias("points"),
        F.round(F.col("series")[0], 9).alias("oldest"),
        F.round(F.element_at("series", -1), 9).alias("newest"),
        F.round(total, 6).alias("total"),
    )


_HISTORY_OUT = """CAST(len(st.h) AS BIGINT) AS history_len,
    CAST(coalesce(list_sum([x.v for x in st.h]), 0) AS VARCHAR) AS history_volume,
    CAST(coalesce(list_sum([x.n for x in st.h]), 0) AS BIGINT) AS history_blocks"""


FOLD_SQL = f"""{_BASE.replace(d.SQL_SAMPLES, d.SQL_SAMPLES.replace("samples AS", "samples0 AS"))},
    samples AS (SELECT * REPLACE (greatest(bucket - CASE WHEN (window_id + pool_id) % 7 = 0 THEN 2 ELSE 0 END, 0) AS bucket) FROM samples0),
    {d.SQL_HISTORY} SELECT pool, window_id, {_HISTORY_OUT} FROM folded"""


@query("volume_fold", FOLD_SQL)
def volume_fold(spark, sf):
    """Retained history at each sample, late samples included; the SQL folds sample by sample."""
    rows = S.volume_history(shuffled_samples(spark, sf), d.BUCKET_BLOCKS)
    return rows.select("pool", "window_id", "history_len", *text("history_volume"), "history_blocks")


@query(
    "baseline",
    f"""{_BASE}, buckets AS (SELECT pool, bucket, sum(volume) AS volume, CAST(count(*) * 60000 AS BIGINT) AS blocks FROM samples GROUP BY pool, bucket),
    firsts AS (SELECT pool, min(bucket) AS b0 FROM buckets GROUP BY pool),
    grid AS (SELECT b.pool, b.bucket, least(24, b.bucket - b0) AS n, b.bucket - i AS past
             FROM buckets b JOIN firsts USING (pool), (SELECT unnest(range(1, 25)) AS i) WHERE b.bucket - i >= b0)
    SELECT b.pool, b.bucket, CAST(least(24, b.bucket - f.b0) AS BIGINT) AS history_len,
      CAST(coalesce(sum(p.volume), 0) AS VARCHAR) AS history_volume,
      CAST(coalesce(sum(CASE WHEN g.past IS NOT NULL THEN coalesce(p.blocks, 120000) END), 0) AS BIGINT) AS history_blocks
    FROM buckets b JOIN firsts f USING (pool) LEFT JOIN grid g ON g.pool = b.pool AND g.bucket = b.bucket
      LEFT JOIN buckets p ON p.pool = b.pool AND p.bucket = g.past
    GROUP BY b.pool, b.bucket, f.b0""",
)
def baseline(spark, sf):
    """Calendar form of the history; the SQL lays out every bucket of the past 24 one by one."""
    rows = S.baseline_sliding(S.bucket_volume(samples(spark, sf)), d.BUCKET_BLOCKS)
    return rows.select("pool", "bucket", "history_len", *text("history_volume"), "history_blocks")


@query(
    "keep_recent",
    f"""{_BASE}, last_seen AS (SELECT pool, max(window_id) AS seen, arg_max(first_seq, window_id) AS fs FROM samples GROUP BY pool),
    newest AS (SELECT pool FROM last_seen ORDER BY seen DESC, fs DESC LIMIT 20)
    SELECT pool, count(*) AS samples FROM samples WHERE pool IN (SELECT pool FROM newest) GROUP BY pool""",
)
def keep_recent(spark, sf):
    return S.keep_recent(samples(spark, sf), 20).groupBy("pool").agg(F.count(F.lit(1)).alias("samples"))


# --- RSI over order totals: one bounded price array per customer ---


def price_series(spark, sf) -> DataFrame:
    """All order totals of each customer, newest first in stretches of 31, each stretch oldest first."""
    orders = d.table(spark, sf, "orders")
    newest = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc())
    kept = orders.withColumn("n", F.row_number().over(newest)).withColumn("stretch", F.expr("CAST((n - 1) div 31 AS bigint)"))
    rows = kept.groupBy("o_custkey", "stretch").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col("o_totalprice").alias("p")))).alias("e")
    )
    return rows.select("o_custkey", "stretch", F.transform("e", lambda x: x["p"]).alias("series"))


_SQL_SERIES = """numbered AS (SELECT o_custkey, o_totalprice AS p,
      row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders),
    series AS (SELECT o_custkey, CAST((n - 1) // 31 AS BIGINT) AS stretch, list(p ORDER BY n DESC) AS s FROM numbered GROUP BY ALL),
    deltas AS (SELECT o_custkey, stretch, s, [s[i + 1] - s[i] for i in range(1, len(s))] AS d FROM series),
    averages AS (SELECT o_custkey, stretch, s, CASE WHEN len(s) >= 6 THEN list_reduce(d[6:], lambda a, x:
        {'g': (a.g * 4 + greatest(x, 0)) / 5, 'l': (a.l * 4 + greatest(-x, 0)) / 5},
        {'g': list_sum([greatest(x, 0) for x in d[:5]]) / 5, 'l': list_sum([greatest(-x, 0) for x in d[:5]]) / 5}) END AS av
      FROM deltas)"""


@query(
    "rsi",
    f"""WITH {_SQL_SERIES} SELECT o_custkey, stretch, CASE WHEN len(s) < 6 THEN 50.0::DOUBLE WHEN av.l = 0 THEN 100.0::DOUBLE
      ELSE round(100 - 100 / (1 + av.g / av.l), 6) END AS rsi FROM averages""",
)
def rsi(spark, sf):
    """Wilder RSI with a period of 5, so that short and long series both occur."""
    rows = price_series(spark, sf)
    return rows.select("o_custkey", "stretch", F.round(wilder_rsi(F.col("series"), 5), 6).alias("rsi"))


@query(
    "rsi_tag",
    f"""{_BASE}, {d.SQL_CANDLES}
    SELECT s.pool, s.window_id, CASE WHEN volume >= 1000000000000000000 THEN rsi END AS rsi,
      CASE WHEN volume >= 1000000000000000000 THEN CASE WHEN list_min(s) < list_max(s) AND rsi < 30 THEN 'oversold'
           WHEN list_min(s) < list_max(s) AND rsi > 70 THEN 'overbought' END END AS rsi_label
    FROM samples s LEFT JOIN rsi r ON r.pool = s.pool AND r.window_id = s.window_id""",
)
def rsi_tag(spark, sf):
    rows = S.rsi_tag(S.candle_series(samples(spark, sf)), min_volume=10**18)
    return rows.select("pool", "window_id", "rsi", "rsi_label")


# --- scores, rankings, selection ---

_SCORED = f"{_BASE}, {d.SQL_HISTORY}, {d.SQL_CANDLES}, {d.SQL_SCORED}"


def scored(spark, sf) -> DataFrame:
    return P.score_samples(samples(spark, sf), d.CFG, d.RATE)


@query(
    "spike",
    f"""{_SCORED} SELECT pool, window_id, round(baseline / 1e12, 6) AS baseline_e12, round(spike, 6) AS spike FROM spiked""",
)
def spike(spark, sf):
    return scored(spark, sf).select(
        "pool", "window_id", F.round(F.col("baseline") / 1e12, 6).alias("baseline_e12"), F.round("spike", 6).alias("spike")
    )


@query(
    "rank_volume",
    f"""{_BASE} SELECT window_id, pool, CAST(row_number() OVER (PARTITION BY window_id ORDER BY volume DESC, first_seq) AS INTEGER) AS rank FROM samples""",
)
def rank_volume(spark, sf):
    return R.rank(samples(spark, sf), "volume").select("window_id", "pool", "rank")


def unknown_rate(rows: DataFrame) -> DataFrame:
    """Dollar volumes with the native rate unknown in every third window."""
    rate = F.when(F.col("window_id") % 3 > 0, F.lit(d.RATE))
    return rows.withColumn("volume_usd", M.to_usd(F.col("volume_anchor"), F.col("anchor_kind"), rate))


_USD_GAPS = "CASE WHEN anchor_kind = 'usd' THEN volume WHEN window_id % 3 > 0 THEN volume * 612500000 // 1000000 END"


@query(
    "rank_swaps",
    f"""{_BASE}, priced_rows AS (SELECT *, {_USD_GAPS} AS volume_usd FROM samples)
    SELECT window_id, pool, CAST(row_number() OVER (PARTITION BY window_id ORDER BY {d.ORDER_SWAPS}) AS INTEGER) AS rank FROM priced_rows""",
)
def rank_swaps(spark, sf):
    return R.rank(unknown_rate(samples(spark, sf)), "swaps").select("window_id", "pool", "rank")


@query(
    "rank_spike",
    f"""{_SCORED}, priced_rows AS (SELECT * REPLACE ({_USD_GAPS} AS volume_usd) FROM spiked)
    SELECT window_id, pool, CAST(row_number() OVER (PARTITION BY window_id ORDER BY {d.ORDER_SPIKE}) AS INTEGER) AS rank FROM priced_rows""",
)
def rank_spike(spark, sf):
    return R.rank(unknown_rate(scored(spark, sf)), "spike").select("window_id", "pool", "rank")


def _wide_rows(spark, sf) -> DataFrame:
    """Line items as ranked rows: order day is the window, line status the board, part the token."""
    return d.table(spark, sf, "lineitem").groupBy("l_shipdate", "l_linestatus", "l_partkey", "l_suppkey").agg(
        F.count(F.lit(1)).alias("swaps"), F.max("l_extendedprice").alias("price")
    ).select(
        F.col("l_shipdate").cast("date").cast("string").substr(1, 7).alias("window_id"),
        F.col("l_linestatus").alias("board"),
        F.col("l_partkey").alias("token"),
        F.concat_ws("/", F.col("l_shipdate").cast("date").cast("string"), "l_suppkey").alias("pool"),
        "swaps",
        F.when(F.col("l_suppkey") % 9 > 0, F.col("price")).alias("fdv"),
    )


@query(
    "mcap_select",
    """WITH g AS (SELECT l_shipdate, l_linestatus, l_partkey, l_suppkey, count(*) AS swaps, max(l_extendedprice) AS price
        FROM lineitem GROUP BY 1, 2, 3, 4),
    ranked AS (SELECT strftime(l_shipdate, '%Y-%m') AS window_id, l_linestatus AS board, l_partkey AS token,
        strftime(l_shipdate, '%Y-%m-%d') || '/' || l_suppkey AS pool, swaps, CASE WHEN l_suppkey % 9 > 0 THEN price END AS fdv,
        row_number() OVER (PARTITION BY strftime(l_shipdate, '%Y-%m'), l_linestatus
          ORDER BY swaps DESC, l_partkey % 20, l_partkey, strftime(l_shipdate, '%Y-%m-%d') || '/' || l_suppkey) AS rk FROM g),
    firsts AS (SELECT *, first_value(fdv) OVER w AS cap, CAST(row_number() OVER w = 1 AS INTEGER) AS is_first
      FROM ranked WINDOW w AS (PARTITION BY window_id, board, token ORDER BY rk)),
    counted AS (SELECT *, sum(is_first) OVER (PARTITION BY window_id, board ORDER BY rk) AS k,
      CASE WHEN cap >= 90000 THEN 'main' ELSE 'danger' END AS variant FROM firsts),
    walked AS (SELECT *, row_number() OVER (PARTITION BY window_id, board, variant ORDER BY rk) AS gp FROM counted WHERE k <= 40),
    filled AS (SELECT window_id, board, CASE WHEN count(*) FILTER (WHERE gp = 8) = 2 THEN max(rk) FILTER (WHERE gp = 8) END AS full_rank
      FROM walked GROUP BY 1, 2),
    totals AS (SELECT window_id, board, any_value(full_rank) AS fr, max(k) FILTER (WHERE full_rank IS NULL OR rk <= full_rank) AS n
      FROM walked JOIN filled USING (window_id, board) GROUP BY 1, 2),
    cut AS (SELECT window_id, board, max(k) > 40 AS cut FROM counted GROUP BY 1, 2)
    SELECT window_id, board, variant, CAST(gp AS INTEGER) AS group_pos, token, pool, round(cap, 2) AS market_cap_usd,
      CAST(n AS INTEGER) AS lookups, fr IS NULL AND cut AS capped
    FROM walked JOIN totals USING (window_id, board) JOIN cut USING (window_id, board) WHERE gp <= 8""",
)
def mcap_select(spark, sf):
    """The budgeted split at the published settings (8 rows per group, 40 lookups) over monthly boards."""
    rows = _wide_rows(spark, sf)
    order = F.struct((-F.col("swaps")).alias("a"), (F.col("token") % 20).alias("b"), F.col("token").alias("c"), F.col("pool").alias("d"))
    chosen = T.select_by_fdv(rows, order, min_usd=90_000.0, per_group=8, max_lookups=40)
    return chosen.select(
        "window_id", "board", "variant", "group_pos", "token", "pool", F.round("market_cap_usd", 2).alias("market_cap_usd"),
        "lookups", "capped",
    )


@query(
    "run_metrics",
    f"""{_SCORED}, {d.sql_selected(d.ORDER_SWAPS)},
    chosen AS (SELECT window_id, board, max(n_lookups) AS lookups, max(CAST(capped AS INTEGER)) AS capped,
        count(*) FILTER (WHERE variant = 'main') AS m, count(*) FILTER (WHERE variant = 'danger') AS dg FROM selected GROUP BY 1, 2),
    boards AS (SELECT window_id, count(*) AS boards, sum(lookups) AS lookups, sum(capped) AS capped_boards, sum(m) AS main_rows, sum(dg) AS danger_rows
        FROM chosen GROUP BY 1),
    all_pools AS (SELECT window_id, count(*) AS pools, sum(swaps) AS swaps, count(*) FILTER (WHERE t = 7) AS dropped,
        count(*) FILTER (WHERE t <> 7 AND board IS NULL) AS unrouted FROM spiked GROUP BY 1)
    SELECT window_id, pools, CAST(swaps AS BIGINT) AS swaps, dropped, unrouted, coalesce(b.boards, 0) AS boards, CAST(coalesce(b.lookups, 0) AS BIGINT) AS lookups,
      CAST(coalesce(capped_boards, 0) AS BIGINT) AS capped_boards, CAST(coalesce(main_rows, 0) AS BIGINT) AS main_rows,
      CAST(coalesce(danger_rows, 0) AS BIGINT) AS danger_rows
    FROM all_pools LEFT JOIN boards b USING (window_id)""",
)
def run_metrics(spark, sf):
    rows = scored(spark, sf)
    t = tables(spark)
    listed = t.denied.select("token", F.lit(True).alias("_listed"))
    marked = B.route_boards(rows, keep_unrouted=True).join(listed, "token", "left")
    marked = marked.withColumn("denied", F.coalesce("_listed", F.lit(False)))
    chosen = P.publish(rows, t, d.CFG)
    return B.run_metrics(marked, chosen).select(
        "window_id", "pools", "swaps", "dropped", "unrouted", "boards",
        *[F.col(c).cast("bigint").alias(c) for c in ("lookups", "capped_boards", "main_rows", "danger_rows")],
    )


# --- reports ---


def _fixed(x: str, places: int) -> str:
    return f"CAST(CAST(CAST({x} AS DECIMAL(38,{max(places + 6, 8)})) AS DECIMAL(38,{places})) AS VARCHAR)"


def _abbreviated(x: str, tiers: tuple, otherwise: str) -> str:
    steps = " ".join(f"WHEN {x} >= {size} THEN '$' || {_fixed(f'{x} / {size}', 1)} || '{unit}'" for size, unit in tiers)
    return f"CASE {steps} ELSE {otherwise} END"


def _amount(x: str) -> str:
    v = f"CAST({x} AS HUGEINT)"
    return f"""CASE WHEN {x} IS NULL THEN '—' ELSE '$' || format('{{:,}}', {v} // 1000000000000000000) || '.'
      || substr(lpad(CAST({v} % 1000000000000000000 AS VARCHAR), 18, '0'), 1, 2) END"""


def _short_amount(x: str) -> str:
    v = f"(CAST({x} AS DOUBLE) / 1e18)"
    small = f"CASE WHEN {v} < 0.01 THEN '<$0.01' ELSE '$' || {_fixed(v, 2)} END"
    return f"CASE WHEN {x} IS NULL THEN '—' WHEN {v} = 0 THEN '$0' ELSE {_abbreviated(v, ((1e9, 'B'), (1e6, 'M'), (1e3, 'K')), small)} END"


_SHORT = "CASE WHEN length(token) > 12 THEN substr(token, 1, 6) || '…' || right(token, 4) ELSE token END"
_LIGHT = "CASE risk WHEN 'clean' THEN '🟢' WHEN 'caution' THEN '🟡' WHEN 'high' THEN '🔴' WHEN 'unknown' THEN '⬜' END"
_MARK = "CASE WHEN verified THEN '✅' ELSE '⚠️' END"
_MEDAL = "CASE group_pos WHEN 1 THEN '🥇' WHEN 2 THEN '🥈' WHEN 3 THEN '🥉' ELSE group_pos || '.' END"
_RSI = """CASE WHEN rsi IS NULL THEN 'RSI —' ELSE 'RSI ' || rsi
  || CASE rsi_label WHEN 'oversold' THEN ' 🟢 Oversold' WHEN 'overbought' THEN ' 🔴 Overbought' ELSE '' END END"""
_CAP = f"""CASE WHEN market_cap_usd IS NULL THEN 'MC —' WHEN market_cap_usd < 1 THEN 'MC <$1'
  ELSE 'MC ' || {_abbreviated('market_cap_usd', ((1e12, 'T'), (1e9, 'B'), (1e6, 'M'), (1e3, 'K')), "'$' || " + _fixed('market_cap_usd', 0))} END"""
_LABEL = "CASE board WHEN 'wbnb' THEN 'PancakeSwap v3 (WBNB pairs)' WHEN 'usdt' THEN 'PancakeSwap v3 (USDT pairs)' ELSE 'PancakeSwap Infinity' END"
_SAFE = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"

# three short rows always fit a message, so nothing is left out here (`fit_rows` has a query of its own)
_unrounded = lambda sql: sql.replace("round(cap, 2) AS", "cap AS").replace("round(spike, 6) AS", "spike AS")
REPORT_SQL = f"""WITH b AS ({_unrounded(BOARD_SQL)}), lines AS (
  SELECT *, CASE WHEN variant = 'danger' THEN '⚠️ <b>Danger Zone — ' || {_SAFE.format(_LABEL)} || '</b>'
      WHEN board = 'wbnb' THEN '{B.HTML_TITLES["wbnb"]}' ELSE '{B.HTML_TITLES["usdt"]}' END || chr(10) || '<i>blocks '
      || format('{{:,}}', from_block) || '–' || format('{{:,}}', to_block) || '</i>' || chr(10) || chr(10) AS head,
    {_MEDAL} || ' <b>' || {_SAFE.format('symbol')} || '</b>' || CASE WHEN verified IS NULL THEN '' ELSE ' ' || {_MARK} || coalesce({_LIGHT}, '⬜') END
      || coalesce(' (' || fee_tier || ')', '') || ' · ' || {_RSI} || ' · ' || replace({_CAP}, 'MC <', 'MC &lt;') || chr(10)
      || '    ' || {_amount('volume_usd')} || ' vol · ' || swaps || ' swaps · ' || traders || ' traders · ' || {_amount('fees_usd')} || ' fees' || chr(10)
      || '    ↳ <a href="{config.EXPLORER_TOKEN_URL}' || token || '">' || {_SHORT} || '</a>' AS line
  FROM b)
SELECT window_id, board, variant, count(*) AS rows, head || string_agg(line, chr(10) || chr(10) ORDER BY group_pos) AS message
FROM lines GROUP BY window_id, board, variant, head"""
PLAIN_REPORT_SQL = f"""WITH b AS ({_unrounded(CL_BOARD_SQL)}), lines AS (
  SELECT *, CASE WHEN variant = 'danger' THEN '⚠️  Danger Zone — ' ELSE '📈 ' END || {_LABEL} || '  (blocks ' || from_block || '–' || to_block || ')' || chr(10) AS head,
    {_MEDAL} || ' ' || symbol || CASE WHEN verified IS NULL THEN coalesce(' ' || {_LIGHT}, '') ELSE ' ' || {_MARK} || coalesce({_LIGHT}, '') END
      || coalesce(' (' || fee_tier || ')', '') || ' ' || CASE WHEN spike IS NULL THEN '(warming)' WHEN spike >= 10 THEN {_fixed('spike', 0)} || 'x' ELSE {_fixed('spike', 1)} || 'x' END
      || ' · ' || {_RSI} || ' · ' || {_CAP} || chr(10)
      || '    ' || {_short_amount('volume_usd')} || ' vol · ' || swaps || ' swaps · ' || traders || ' traders · ' || {_short_amount('fees_usd')} || ' fees' || chr(10)
      || '    ↳ ' || {_SHORT} AS line
  FROM b)
SELECT window_id, board, variant, count(*) AS rows, head || string_agg(line, chr(10) ORDER BY group_pos) AS message
FROM lines GROUP BY window_id, board, variant, head"""


@query("board_report", REPORT_SQL)
def board_report(spark, sf):
    """Finished HTML messages of every board and window."""
    rows = P.board_rows(d.swaps(spark, sf), tables(spark), d.CFG)
    return B.board_report(rows, ["window_id", "board", "variant"])


@query("board_report_plain", PLAIN_REPORT_SQL)
def board_report_plain(spark, sf):
    rows = P.board_rows(d.swaps(spark, sf, "cl"), tables(spark, "cl"), d.CFG, config.CL)
    return B.board_report(rows, ["window_id", "board", "variant"], html=False)


_UNITS = "(length(t) + length(regexp_replace(t, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')))"


@query(
    "fit_rows",
    f"""WITH r AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN '🥇 ' ELSE '' END || text AS t FROM conversations),
    n AS (SELECT conv_id, turn, {_UNITS} AS u, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM r),
    s AS (SELECT *, sum(u) OVER (PARTITION BY conv_id ORDER BY turn) + (n - 1) * 2 + 30 AS total FROM n)
    SELECT conv_id, turn, CAST(total AS BIGINT) AS message_units, n = 1 AND total > 1500 AS placeholder FROM s WHERE total <= 1500 OR n = 1""",
)
def fit_rows(spark, sf):
    """Leading turns of each conversation that fit one message of 1,500 UTF-16 units."""
    rows = d.table(spark, sf, "conversations").selectExpr(
        "conv_id", "turn", "concat(CASE WHEN turn % 3 = 1 THEN '🥇 ' ELSE '' END, text) AS row_text"
    )
    fitted = B.fit_rows(rows, ["conv_id"], header_units=F.lit(30), position="turn", limit=1500)
    return fitted.select("conv_id", "turn", "message_units", "placeholder")
