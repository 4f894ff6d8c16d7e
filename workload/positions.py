"""Prices, units, positions, ranges, quotes and the execution trail, over rows derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from poolscope import config
from poolscope.functions import money as M
from poolscope.functions import ticks as K
from poolscope.operators import aggregate as A
from poolscope.operators import positions as X
from poolscope.operators import trail as T
from poolscope.plans import market as P
from workload import derive as d
from workload.market import WIDE_ROWS, text, times, times_by, v3_aggregate, wide_fee, wide_swaps
from workload.registry import query

_TOK = "concat('0x{p}', lpad(CAST({n} AS string), 38, '0'))"
_SQL_TOK = "'0x{p}' || lpad(CAST({n} AS VARCHAR), 38, '0')"


@query(
    "sort_pair",
    f"""WITH p AS (SELECT l_orderkey AS item, l_linenumber AS line, {_SQL_TOK.format(p='7a', n='l_partkey')} AS a, {_SQL_TOK.format(p='7A', n='l_suppkey * 3')} AS b FROM lineitem)
    SELECT item, line, CASE WHEN lower(a) > lower(b) THEN b ELSE a END AS token0, CASE WHEN lower(a) > lower(b) THEN a ELSE b END AS token1, lower(a) > lower(b) AS flipped FROM p""",
)
def sort_pair(spark, sf):
    rows = d.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS item", "l_linenumber AS line",
        f"{_TOK.format(p='7a', n='l_partkey')} AS token_a", f"{_TOK.format(p='7A', n='l_suppkey * 3')} AS token_b",
    )
    return X.sort_pair(rows).drop("token_a", "token_b")


@query(
    "units",
    """WITH o AS (SELECT o_orderkey, CAST(o_orderkey % 19 AS INTEGER) AS dec, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
    t AS (SELECT *, CASE WHEN o_orderkey % 17 = 0 THEN 'bad' WHEN o_orderkey % 17 = 1 THEN '.' ELSE '' END AS broken FROM o)
    SELECT o_orderkey, CASE WHEN broken <> '' THEN 'invalid amount' WHEN dec < 2 THEN 'too many decimal places' END AS error,
      CASE WHEN broken = '' AND dec >= 2 THEN CAST(cents * CAST(rpad('1', dec - 1, '0') AS HUGEINT) AS VARCHAR) END AS base_units,
      CASE WHEN broken = '' AND dec >= 2 THEN CASE WHEN cents % 100 = 0 THEN CAST(cents // 100 AS VARCHAR)
        ELSE (cents // 100) || '.' || rtrim(lpad(CAST(cents % 100 AS VARCHAR), 2, '0'), '0') END END AS human
    FROM t""",
)
def units(spark, sf):
    """Typed amounts with thousands separators to base units and back."""
    rows = d.table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        "CAST(o_orderkey % 19 AS int) AS dec",
        """CASE o_orderkey % 17 WHEN 0 THEN 'bad' WHEN 1 THEN '.' ELSE
             concat(' ', format_number(CAST(o_totalprice AS decimal(18,2)), 2), ' ') END AS typed""",
    )
    base = rows.withColumn("base", M.to_base_units(F.col("typed"), F.col("dec")))
    return base.select(
        "o_orderkey",
        M.units_error(F.col("typed"), F.col("dec")).alias("error"),
        F.col("base").cast("string").alias("base_units"),
        M.from_base_units(F.col("base"), F.col("dec")).alias("human"),
    )


@query(
    "slippage",
    """SELECT o_orderkey, CASE WHEN o_custkey % 120 < 100 THEN CAST(CAST(round(o_totalprice * 100) AS HUGEINT) * 10000000000000000
        * CAST(floor((100.0::DOUBLE - (o_custkey % 120) / 1.25::DOUBLE) * 100 + 0.5) AS HUGEINT) // 10000 AS VARCHAR) END AS floor_amount
    FROM (SELECT * FROM orders)
    """.replace("o_custkey % 120 < 100", "(o_custkey % 120) / 1.25 < 80"),
)
def slippage(spark, sf):
    rows = d.table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        "CAST(CAST(round(o_totalprice * 100) AS decimal(18,0)) * 10000000000000000BD AS decimal(38,0)) AS amount",
        "CASE WHEN (o_custkey % 120) / 1.25D < 80 THEN (o_custkey % 120) / 1.25D ELSE 100.0D + o_custkey END AS pct",
    )
    floor = M.apply_slippage(F.col("amount"), F.col("pct"))
    return rows.select("o_orderkey", floor.cast("string").alias("floor_amount"))


@query(
    "series_price",
    f"""WITH {d.SQL_SWAPS}, s AS (SELECT *, sqrt_price / pow(2, 96) AS q FROM swaps)
    SELECT seq, CASE WHEN price_milli > 0 THEN round(q * q, 9) END AS token_first,
      CASE WHEN price_milli > 0 THEN round(1.0 / (q * q), 9) END AS token_second,
      round(q * q * pow(10.0, CAST(seq % 4 AS DOUBLE) - 2), 9) AS human
    FROM s""",
)
def series_price(spark, sf):
    p = F.col("sqrt_price")
    return d.swaps(spark, sf).select(
        "seq",
        F.round(M.series_price(p, F.lit(True)), 9).alias("token_first"),
        F.round(M.series_price(p, F.lit(False)), 9).alias("token_second"),
        F.round(M.price_from_sqrt(p, F.col("seq") % 4, F.lit(2)), 9).alias("human"),
    )


@query(
    "native_rate",
    f"""WITH {d.SQL_SWAPS}, l AS (SELECT window_id, pool, pool_id, arg_max(sqrt_price, seq) AS p FROM swaps WHERE pool_id IN (1, 2) GROUP BY ALL)
    SELECT window_id, pool, CASE WHEN p > 0 THEN round(CASE WHEN pool_id = 2 THEN (p / pow(2, 96)) * (p / pow(2, 96))
      ELSE 1.0 / ((p / pow(2, 96)) * (p / pow(2, 96))) END, 9) END AS rate FROM l""",
)
def native_rate(spark, sf):
    """Rate of each window from a designated pool: one with the native coin second, one with it first."""
    prices = A.last_value(d.swaps(spark, sf), ["window_id", "pool"], ["sqrt_price"])
    first = F.when(F.col("pool_id") == 2, F.lit(config.WBNB)).otherwise(F.lit(config.USDT))
    pairs = d.pool_pairs(spark).select("pool", first.alias("token0"))
    rates = [P.native_rate(prices, pairs, rate_pool=d.pool_name(p)) for p in (1, 2)]
    return rates[0].unionByName(rates[1]).select("window_id", "pool", F.round("rate", 9).alias("rate"))


@query(
    "to_usd",
    """WITH r AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS HUGEINT) * 1000000000000000 AS amount,
        CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 0.0 WHEN 2 THEN -5.0 ELSE 600.25 + o_custkey / 7.0::DOUBLE END AS rate,
        o_orderkey % 4 = 0 AS is_usd FROM orders)
    SELECT o_orderkey, CAST(CASE WHEN is_usd THEN amount WHEN rate > 0 THEN amount * CAST(floor(CAST(rate AS DOUBLE) * 1000000 + 0.5) AS HUGEINT) // 1000000 END AS VARCHAR) AS usd FROM r""",
)
def to_usd(spark, sf):
    """Dollar values at a rate per row: unknown, zero and negative rates give no value."""
    rows = d.table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        "CAST(CAST(round(o_totalprice * 100) AS decimal(18,0)) * 1000000000000000BD AS decimal(38,0)) AS amount",
        "CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 0.0D WHEN 2 THEN -5.0D ELSE 600.25D + o_custkey / 7.0D END AS rate",
        "CASE WHEN o_orderkey % 4 = 0 THEN 'usd' ELSE 'bnb' END AS kind",
    )
    usd = M.to_usd(F.col("amount"), F.col("kind"), F.col("rate"))
    return rows.select("o_orderkey", usd.cast("string").alias("usd"))


@query(
    "fees_anchor",
    f"""WITH {d.SQL_AGG}
    SELECT window_id, pool, CAST(CASE WHEN is0 THEN fees0 + CASE WHEN last_milli = 0 THEN 0 ELSE fees1 * 65536 // (last_milli * last_milli) END
      ELSE fees1 + fees0 * (last_milli * last_milli) // 65536 END AS VARCHAR) AS fees FROM agg""",
)
def fees_anchor(spark, sf):
    """Both fee legs at the window's last price; the SQL cancels the common power of two."""
    rows = v3_aggregate(spark, sf)
    word = F.lpad("last_sqrt_word", 64, "0")
    fees = M.fees_to_anchor(F.col("fees0"), F.col("fees1"), word, F.col("anchor_is_token0"))
    return rows.select("window_id", "pool", fees.alias("fees"))


def _quotient(digits: str, unit: str) -> str:
    """Decimal text of floor(digits / unit), digit by digit, for a unit below 10^18."""
    steps = f"list_transform(string_split({digits}, ''), lambda c: CAST(c AS BIGINT))"
    fold = f"""list_reduce(list_prepend({{'rest': CAST(0 AS BIGINT), 'text': '', 'd': CAST(0 AS BIGINT)}},
      list_transform({steps}, lambda c: {{'rest': CAST(0 AS BIGINT), 'text': '', 'd': c}})),
      lambda acc, x: {{'rest': (acc.rest * 10 + x.d) % {unit}, 'text': acc.text || CAST((acc.rest * 10 + x.d) // {unit} AS VARCHAR), 'd': CAST(0 AS BIGINT)}})"""
    return f"coalesce(nullif(ltrim(({fold}).text, '0'), ''), '0')"


@query(
    "fees_anchor_wide",
    f"""WITH {d.SQL_SWAPS}, {d.SQL_POOLS}, {WIDE_ROWS},
    f0 AS (SELECT window_id, pool, bool_or(side) AS is0, arg_max(CASE WHEN seq % 103 = 0 THEN 0 ELSE price_milli END, seq) AS m, {wide_fee('fee_pips', 'a > 0')} AS fees0 FROM (SELECT l.*, p.is0 AS side, amount0 AS a, w0 AS w FROM legs l JOIN pools p USING (pool_id)) GROUP BY window_id, pool),
    f1 AS (SELECT window_id, pool, {wide_fee('fee_pips', 'a > 0')} AS fees1 FROM (SELECT *, amount1 AS a, false AS w FROM legs) GROUP BY ALL),
    both_legs AS (SELECT *, m * m AS mm, CAST(fees0 AS BIGNUM) AS n0, CAST(fees1 AS BIGNUM) AS n1 FROM f0 JOIN f1 USING (window_id, pool)),
    scaled AS (SELECT *, CAST({times('n1', 65536)} AS VARCHAR) AS up1, CAST({times_by('n0', 'mm')} AS VARCHAR) AS up0 FROM both_legs)
    SELECT window_id, pool, CAST(CASE WHEN is0 THEN n0 + CASE WHEN m = 0 THEN CAST(0 AS BIGNUM) ELSE CAST({_quotient('up1', 'greatest(mm, 1)')} AS BIGNUM) END
      ELSE n1 + CAST({_quotient('up0', '65536')} AS BIGNUM) END AS VARCHAR) AS fees FROM scaled""",
)
def fees_anchor_wide(spark, sf):
    """Fee legs beyond 2^128 at the window's last price, digit by digit."""
    rows = A.aggregate_v3(wide_swaps(spark, sf, "v3"), keep_limbs=True)
    legs = rows.withColumns({n: A.exact_text(n) for n in ("fees0", "fees1")})
    fees = M.fees_to_anchor(F.col("fees0"), F.col("fees1"), F.lpad("last_sqrt_word", 64, "0"), F.col("anchor_is_token0"))
    return legs.select("window_id", "pool", fees.alias("fees"))


@query(
    "fdv",
    f"""WITH {d.SQL_AGG}, {d.SQL_SAMPLES}
    SELECT window_id, pool, CASE WHEN t <> 5 AND price > 0 THEN round((CASE WHEN t = 3 THEN (t + 1) * 1e9 / pow(10.0, 6) ELSE (t + 1) * 1e21 / pow(10.0, 18) END)
      * (price * (CASE WHEN t = 3 THEN pow(10.0, -12) ELSE 1.0 END)) * (CASE WHEN anchor_kind = 'usd' THEN 1.0 ELSE 612.5 END), 4) END AS fdv FROM samples""",
)
def fdv(spark, sf):
    rows = P.pool_samples(d.swaps(spark, sf), d.pools(spark), d.CFG)
    valued = P.with_fdv(P.with_rate(rows, d.RATE), d.tokens(spark))
    return valued.select("window_id", "pool", F.round("fdv", 4).alias("fdv"))


# --- positions: one per order; its pool price comes from the swaps ---


def positions(spark, sf):
    return d.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS token_id",
        "o_custkey AS owner",
        f"{_TOK.format(p='b0', n='o_custkey % 48')} AS pool",
        "CAST(25000 + (o_orderkey % 300) * 50 AS int) AS tick_lower",
        "CAST(25000 + (o_orderkey % 300) * 50 + (o_custkey % 100 - 2) * 100 AS int) AS tick_upper",
        "CAST(CASE WHEN o_orderkey % 8 = 0 THEN 0 ELSE CAST(round(o_totalprice) AS bigint) * 1000000000 END AS decimal(38,0)) AS liquidity",
        "CAST(o_orderkey % 16 AS decimal(38,0)) AS owed0",
        "CAST(0 AS decimal(38,0)) AS owed1",
    )


def spot(spark, sf):
    return A.last_value(d.swaps(spark, sf), ["pool"], ["sqrt_price", "sqrt_price_word"])


_SQL_POS = f"""{d.SQL_SWAPS}, spot AS (SELECT pool_id, arg_max(sqrt_price, seq) AS sp FROM swaps GROUP BY pool_id),
pos0 AS (SELECT o_orderkey AS token_id, o_custkey AS owner, CAST(25000 + (o_orderkey % 300) * 50 AS INTEGER) AS lo,
   CAST(25000 + (o_orderkey % 300) * 50 + (o_custkey % 100 - 2) * 100 AS INTEGER) AS hi, o_custkey, o_orderkey,
   CASE WHEN o_orderkey % 8 = 0 THEN 0 ELSE CAST(round(o_totalprice) AS BIGINT) * 1000000000 END AS liq, sp
  FROM orders LEFT JOIN spot ON pool_id = o_custkey % 48),
pos AS (SELECT *, pow(1.0001, lo / 2.0) * pow(2, 96) AS a, pow(1.0001, hi / 2.0) * pow(2, 96) AS b FROM pos0),
clamped AS (SELECT *, least(greatest(sp, a), b) AS p FROM pos)"""


@query(
    "position_value",
    f"""WITH {_SQL_POS}
    SELECT token_id, CASE WHEN lo >= hi THEN 'empty range' END AS error,
      CASE WHEN lo < hi AND sp IS NOT NULL THEN round(CASE WHEN liq > 0 AND p < b THEN CAST(liq AS DOUBLE) * (b - p) / p * pow(2, 96) / b ELSE 0 END / 1e6, 3) END AS amount0,
      CASE WHEN lo < hi AND sp IS NOT NULL THEN round(CASE WHEN liq > 0 AND p > a THEN CAST(liq AS DOUBLE) * (p - a) / pow(2, 96) ELSE 0 END / 1e6, 3) END AS amount1
    FROM clamped""",
)
def position_value(spark, sf):
    rows = X.value_positions(positions(spark, sf), spot(spark, sf).drop("sqrt_price_word"))
    return rows.select(
        "token_id", "error", F.round(F.col("amount0") / 1e6, 3).alias("amount0"), F.round(F.col("amount1") / 1e6, 3).alias("amount1")
    )


@query(
    "position_value_exact",
    f"""WITH {_SQL_POS}
    SELECT token_id, CASE WHEN lo >= hi THEN 'empty range' END AS error,
      CASE WHEN lo < hi AND sp IS NOT NULL THEN round(CASE WHEN liq > 0 AND p < b THEN CAST(liq AS DOUBLE) * (b - p) / p * pow(2, 96) / b ELSE 0 END / 1e10) END AS amount0,
      CASE WHEN lo < hi AND sp IS NOT NULL THEN round(CASE WHEN liq > 0 AND p > a THEN CAST(liq AS DOUBLE) * (p - a) / pow(2, 96) ELSE 0 END / 1e10) END AS amount1
    FROM clamped""",
)
def position_value_exact(spark, sf):
    """The same values as exact integers, shown in units in which the SQL's doubles agree (tests compare all digits)."""
    rows = X.value_positions(positions(spark, sf), spot(spark, sf), exact=True)
    shown = lambda c: F.round(F.col(c).cast("double") / 1e10).alias(c)
    return rows.select("token_id", "error", shown("amount0"), shown("amount1"))


@query(
    "amounts_exact",
    f"""WITH {d.SQL_SWAPS}, spot AS (SELECT pool_id, arg_max(price_milli, seq) AS sp FROM swaps GROUP BY pool_id),
    r AS (SELECT o_orderkey AS token_id, o_orderkey % 1500 + 500 AS lo, o_orderkey % 1500 + 400 + o_custkey % 700 AS hi, sp,
       CASE WHEN o_orderkey % 8 = 0 THEN CAST(0 AS HUGEINT) ELSE CAST(round(o_totalprice) AS HUGEINT) * 1000000007000000011 + o_orderkey END AS liq
      FROM orders LEFT JOIN spot ON pool_id = o_custkey % 48),
    c AS (SELECT *, least(greatest(sp, lo), hi) AS p FROM r WHERE lo < hi AND sp IS NOT NULL)
    SELECT r.token_id, CAST(c.liq * (c.hi - c.p) * 256 // (c.p * c.hi) AS VARCHAR) AS amount0, CAST(c.liq * (c.p - c.lo) // 256 AS VARCHAR) AS amount1
    FROM r LEFT JOIN c USING (token_id)""",
)
def amounts_exact(spark, sf):
    """Exact amounts between two square-root prices; the SQL cancels the common power of two and compares all digits."""
    rows = d.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS token_id", f"{_TOK.format(p='b0', n='o_custkey % 48')} AS pool",
        f"CAST(o_orderkey % 1500 + 500 AS double) * {d.Q88}D AS low", f"CAST(o_orderkey % 1500 + 400 + o_custkey % 700 AS double) * {d.Q88}D AS high",
        """CASE WHEN o_orderkey % 8 = 0 THEN CAST(0 AS decimal(38,0))
           ELSE CAST(CAST(CAST(round(o_totalprice) AS bigint) AS decimal(18,0)) * 1000000007000000011BD + o_orderkey AS decimal(38,0)) END AS liquidity""",
    )
    priced = rows.join(spot(spark, sf), "pool", "left")
    both = K.exact_amounts_between(F.col("liquidity"), F.col("low"), F.col("high"), F.col("sqrt_price_word"))
    return priced.withColumn("_v", both).select("token_id", "_v.amount0", "_v.amount1")


_AT = "(o_orderkey * 7919) % 5900000 - 50000"


@query(
    "asof_join",
    f"""WITH {d.SQL_SWAPS}, last AS (SELECT pool_id, block_number, arg_max(sqrt_price, seq) AS sp FROM swaps GROUP BY ALL),
    asked AS (SELECT o_orderkey AS token_id, o_custkey % 48 AS pool_id, {_AT} AS at_block, CAST(25000 + (o_orderkey % 300) * 50 AS INTEGER) AS lo,
       CAST(25000 + (o_orderkey % 300) * 50 + (o_custkey % 100 - 2) * 100 AS INTEGER) AS hi,
       CASE WHEN o_orderkey % 8 = 0 THEN 0 ELSE CAST(round(o_totalprice) AS BIGINT) * 1000000000 END AS liq FROM orders),
    found AS (SELECT a.*, l.sp, l.block_number AS price_block, pow(1.0001, lo / 2.0) * pow(2, 96) AS a, pow(1.0001, hi / 2.0) * pow(2, 96) AS b
      FROM asked a ASOF LEFT JOIN last l ON a.pool_id = l.pool_id AND a.at_block >= l.block_number),
    clamped AS (SELECT *, least(greatest(sp, a), b) AS p FROM found)
    SELECT token_id, at_block, price_block, CASE WHEN lo >= hi THEN 'empty range' END AS error,
      CASE WHEN lo < hi AND sp IS NOT NULL THEN round(CASE WHEN liq > 0 AND p < b THEN CAST(liq AS DOUBLE) * (b - p) / p * pow(2, 96) / b ELSE 0 END / 1e6, 3) END AS amount0,
      CASE WHEN lo < hi AND sp IS NOT NULL THEN round(CASE WHEN liq > 0 AND p > a THEN CAST(liq AS DOUBLE) * (p - a) / pow(2, 96) ELSE 0 END / 1e6, 3) END AS amount1
    FROM clamped""",
)
def asof_join(spark, sf):
    """Every position at a block of its own, valued at its pool's latest price by then."""
    at = d.table(spark, sf, "orders").selectExpr("o_orderkey AS token_id", f"{_AT} AS at_block")
    rows = positions(spark, sf).join(at, "token_id")
    prices = d.swaps(spark, sf).withColumn("price_block", F.col("block_number"))
    valued = X.value_positions_asof(rows, prices, at="at_block")
    shown = lambda c: F.round(F.col(c) / 1e6, 3).alias(c)
    return valued.select("token_id", "at_block", "price_block", "error", shown("amount0"), shown("amount1"))


_PCT = "CASE o_custkey % 6 WHEN 0 THEN 100.0 WHEN 1 THEN 25.5 WHEN 2 THEN 0.004 WHEN 3 THEN 120.0 ELSE 50.0 END"


@query(
    "exit_quote",
    f"""WITH {_SQL_POS}, q AS (SELECT *, {_PCT} AS pct FROM clamped),
    r AS (SELECT *, CASE WHEN pct >= 100 THEN CAST(liq AS HUGEINT) ELSE CAST(liq AS HUGEINT) * CAST(floor(CAST(pct AS DOUBLE) * 100 + 0.5) AS HUGEINT) // 10000 END AS out FROM q),
    e AS (SELECT *, CASE WHEN pct > 100 THEN 'percent out of range' WHEN liq = 0 AND o_orderkey % 16 = 0 THEN 'already empty'
       WHEN liq > 0 AND out = 0 THEN 'rounds to zero liquidity' WHEN lo >= hi THEN 'empty range' END AS error FROM r)
    SELECT token_id, error, CAST(out AS VARCHAR) AS liquidity_out,
      CASE WHEN error IS NULL THEN CASE WHEN out > 0 THEN 'withdraw,' ELSE '' END || 'collect' || CASE WHEN pct >= 100 THEN ',burn' ELSE '' END END AS steps,
      CASE WHEN error IS NULL AND sp IS NOT NULL THEN round(CASE WHEN out > 0 AND p > a THEN CAST(out AS DOUBLE) * (p - a) / pow(2, 96) ELSE 0 END / 1e6, 3) END AS expected1,
      CASE WHEN error IS NULL AND sp IS NOT NULL THEN round(CAST(CAST(floor(CASE WHEN out > 0 AND p > a THEN CAST(out AS DOUBLE) * (p - a) / pow(2, 96) ELSE 0 END) AS HUGEINT) * 9900 // 10000 AS DOUBLE) / 1e9 + 0.0001234, 3) END AS min1
    FROM e""",
)
def exit_quote(spark, sf):
    rows = positions(spark, sf)
    pct = F.expr(_PCT.replace("o_custkey", "owner")).cast("double")
    out = X.exit_quotes(rows, spot(spark, sf).drop("sqrt_price_word"), pct, F.lit(1.0))
    return out.select(
        "token_id",
        "error",
        *text("liquidity_out"),
        F.array_join("steps", ",").alias("steps"),
        F.round(F.col("expected1").cast("double") / 1e6, 3).alias("expected1"),
        F.round(F.col("min1").cast("double") / 1e9 + 0.0001234, 3).alias("min1"),
    )


_SQL_SPACING = "CASE fee WHEN 100 THEN 1 WHEN 500 THEN 10 WHEN 2500 THEN 50 WHEN 10000 THEN 200 END"


def pool_ticks(spark, sf):
    """A tick, a width and a fee tier per order; some tiers and widths are not allowed."""
    return d.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS id",
        "CAST((o_orderkey * 7919) % 400000 - 200000 AS int) AS tick",
        "CAST(element_at(array(100, 500, 2500, 10000, 3000), CAST(o_custkey % 5 + 1 AS int)) AS int) AS fee_pips",
        "CAST(o_orderkey % 120 AS double) AS pct",
        "CASE o_orderkey % 3 WHEN 0 THEN 'token0' WHEN 1 THEN 'token1' END AS side",
    )


_SQL_TICKS = f"""t0 AS (SELECT o_orderkey AS id, CAST((o_orderkey * 7919) % 400000 - 200000 AS INTEGER) AS tick,
    CASE o_custkey % 5 WHEN 0 THEN 100 WHEN 1 THEN 500 WHEN 2 THEN 2500 WHEN 3 THEN 10000 ELSE 3000 END AS fee,
    CAST(o_orderkey % 120 AS DOUBLE) AS pct, CASE o_orderkey % 3 WHEN 0 THEN 'token0' WHEN 1 THEN 'token1' END AS side FROM orders),
t AS (SELECT *, {_SQL_SPACING} AS s, ln(1 + pct / 100) / ln(1.0001) AS w, ln(1 + 2.0 / 100) / ln(1.0001) AS near,
    ln(1 + (2.0 + pct) / 100) / ln(1.0001) AS far FROM t0),
ok AS (SELECT *, s IS NOT NULL AND pct > 0 AND pct < 100 AS fine FROM t)"""


@query(
    "plan_ranges",
    f"""WITH {_SQL_TICKS}, r AS (SELECT *, floor((tick - w) / s) * s AS lo, ceil((tick + w) / s) * s AS hi FROM ok)
    SELECT id, CASE WHEN s IS NULL THEN 'unsupported fee tier' WHEN NOT fine THEN 'range must be between 0 and 100 percent' END AS range_error,
      CAST(s AS INTEGER) AS spacing, CAST(CASE WHEN fine THEN lo END AS INTEGER) AS tick_lower, CAST(CASE WHEN fine THEN hi END AS INTEGER) AS tick_upper FROM r""",
)
def plan_ranges(spark, sf):
    rows = X.plan_ranges(pool_ticks(spark, sf), F.col("pct"))
    return rows.select("id", "range_error", "spacing", "tick_lower", "tick_upper")


@query(
    "plan_one_sided",
    f"""WITH {_SQL_TICKS}, r AS (SELECT *, floor((tick - near) / s) * s AS bu, floor((tick - far) / s) * s AS bl0,
       ceil((tick + near) / s) * s AS al, ceil((tick + far) / s) * s AS au0 FROM ok)
    SELECT id, CAST(CASE WHEN fine THEN CASE side WHEN 'token1' THEN CASE WHEN bl0 >= bu THEN bu - s ELSE bl0 END WHEN 'token0' THEN al
        ELSE floor((tick - w) / s) * s END END AS INTEGER) AS tick_lower,
      CAST(CASE WHEN fine THEN CASE side WHEN 'token1' THEN bu WHEN 'token0' THEN CASE WHEN au0 <= al THEN al + s ELSE au0 END
        ELSE ceil((tick + w) / s) * s END END AS INTEGER) AS tick_upper
    FROM r""",
)
def plan_one_sided(spark, sf):
    """Below the price for token1, above it for token0, around it where no side is given."""
    rows = X.plan_ranges(pool_ticks(spark, sf), F.col("pct"), F.col("side"), F.lit(2.0))
    return rows.select("id", "tick_lower", "tick_upper")


def registry(spark, sf):
    """One registered pool per part and fee tier; that of cheap parts has another pair, and some are zero."""
    return d.table(spark, sf, "part").selectExpr(
        f"{_TOK.format(p='70', n='p_partkey')} AS token0",
        f"CASE WHEN p_retailprice >= 950 THEN '{config.USDT}x' ELSE 'other' END AS token1",
        "CAST(element_at(array(100, 500, 2500, 10000), CAST(p_partkey % 4 + 1 AS int)) AS int) AS fee_pips",
        f"CASE WHEN p_size = 1 THEN '{config.ZERO_ADDRESS}' ELSE {_TOK.format(p='B0', n='p_partkey')} END AS pool",
    )


def registry_prices(spark, sf):
    return d.table(spark, sf, "part").selectExpr(
        f"CASE WHEN p_size < 45 THEN {_TOK.format(p='b0', n='p_partkey')} ELSE {_TOK.format(p='b1', n='p_partkey')} END AS pool",
        f"(1000 + p_partkey % 977) * {d.Q88}D AS sqrt_price",
        "CAST(p_partkey * 3 - 500 AS int) AS tick",
    )


_SQL_QUOTES = f"""req AS (SELECT l_orderkey AS item, l_linenumber AS line, l_suppkey AS supp, l_partkey AS pk, CASE l_suppkey % 3 WHEN 0 THEN l_partkey % 4 ELSE l_suppkey % 5 END AS tier,
    l_partkey % 19 AS d0, 18 AS d1, l_quantity AS qty, l_extendedprice AS price FROM lineitem),
q AS (SELECT r.*, CASE tier WHEN 0 THEN 100 WHEN 1 THEN 500 WHEN 2 THEN 2500 WHEN 3 THEN 10000 ELSE 3000 END AS fee,
    CASE WHEN p_retailprice >= 950 AND tier = p_partkey % 4 THEN CASE WHEN p_size = 1 THEN 'zero' ELSE 'ok' END END AS reg,
    p_size < 45 AND p_size <> 1 AS priced, (1000 + p_partkey % 977) * {d.Q88}.0::DOUBLE AS sp, CAST(p_partkey * 3 - 500 AS INTEGER) AS tk FROM req r LEFT JOIN part ON p_partkey = pk),
j AS (SELECT *, CASE WHEN tier > 3 THEN 'unsupported fee tier' WHEN reg IS NULL OR reg = 'zero' THEN 'no such pool' WHEN NOT priced THEN 'no price' END AS error FROM q)"""


@query(
    "pool_quote",
    f"""WITH {_SQL_QUOTES} SELECT item, line, supp, error, CAST(CASE tier WHEN 0 THEN 1 WHEN 1 THEN 10 WHEN 2 THEN 50 WHEN 3 THEN 200 END AS INTEGER) AS spacing,
      CASE WHEN error IS NULL THEN round(ln((sp / pow(2, 96)) * (sp / pow(2, 96)) * pow(10.0, CAST(d0 - d1 AS DOUBLE))), 8) END AS log_price FROM j""",
)
def pool_quote(spark, sf):
    requests = d.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS item", "l_linenumber AS line", "l_suppkey AS supp",
        f"{_TOK.format(p='70', n='l_partkey')} AS token0", f"'{config.USDT}x' AS token1",
        "CAST(element_at(array(100, 500, 2500, 10000, 3000), CAST((CASE l_suppkey % 3 WHEN 0 THEN l_partkey % 4 ELSE l_suppkey % 5 END) + 1 AS int)) AS int) AS fee_pips",
        "CAST(l_partkey % 19 AS int) AS decimals0", "18 AS decimals1",
    )
    rows = X.pool_quotes(requests, registry(spark, sf), registry_prices(spark, sf))
    return rows.select("item", "line", "supp", "error", "spacing", F.round(F.log("price"), 8).alias("log_price"))


@query(
    "entry_quote",
    f"""WITH {_SQL_QUOTES}, a AS (SELECT *, CASE WHEN qty > 45 THEN 0 ELSE CAST(qty AS BIGINT) END AS n0, CASE WHEN qty < 3 OR qty > 48 THEN 0 ELSE CAST(round(price) AS BIGINT) END AS n1 FROM j),
    m AS (SELECT *, CAST(n1 AS HUGEINT) * 1000000000000000000 AS amount0, CAST(n0 AS HUGEINT) * CAST(rpad('1', CAST(d0 + 1 AS INTEGER), '0') AS HUGEINT) AS amount1,
       CASE WHEN n0 = 0 AND n1 = 0 THEN 'both amounts are zero' ELSE error END AS err, CASE tier WHEN 0 THEN 1 WHEN 1 THEN 10 WHEN 2 THEN 50 WHEN 3 THEN 200 END AS s,
       ln(1 + 10.0 / 100) / ln(1.0001) AS w, ln(1 + 1.0 / 100) / ln(1.0001) AS near, ln(1 + 11.0 / 100) / ln(1.0001) AS far FROM a)
    SELECT item, line, supp, err AS error, supp % 2 <> 0 AS flipped, CAST(amount0 AS VARCHAR) AS amount0, CAST(amount1 AS VARCHAR) AS amount1,
      CAST(amount0 * 9900 // 10000 AS VARCHAR) AS min0, CAST(amount1 * 9900 // 10000 AS VARCHAR) AS min1,
      CAST(CASE WHEN err IS NULL THEN CASE WHEN n1 = 0 THEN floor((tk - far) / s) * s WHEN n0 = 0 THEN ceil((tk + near) / s) * s ELSE floor((tk - w) / s) * s END END AS INTEGER) AS tick_lower,
      CAST(CASE WHEN err IS NULL THEN CASE WHEN n1 = 0 THEN floor((tk - near) / s) * s WHEN n0 = 0 THEN ceil((tk + far) / s) * s ELSE ceil((tk + w) / s) * s END END AS INTEGER) AS tick_upper,
      err IS NULL AND n1 > 0 AS approve0, err IS NULL AND n0 > 0 AND (supp % 3 = 0 OR n0 > 20) AS approve1
    FROM m""",
)
def entry_quote(spark, sf):
    """One entry request per line item, half of them naming the pair in the other order."""
    tok = _TOK.format(p="70", n="l_partkey")
    raw = d.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS item", "l_linenumber AS line", "l_suppkey AS supp", "l_partkey AS pk", "l_suppkey % 2 = 0 AS swap_names",
        f"concat(CAST(l_suppkey % 3 AS string), '-', CAST(l_partkey AS string)) AS owner", f"{tok} AS t0", f"'{config.USDT}x' AS t1",
        "CAST(l_partkey % 19 AS int) AS d0", "18 AS d1",
        "CAST(CASE WHEN l_quantity > 45 THEN 0 ELSE CAST(l_quantity AS bigint) END AS string) AS n0",
        "CAST(CASE WHEN l_quantity < 3 OR l_quantity > 48 THEN 0 ELSE CAST(round(l_extendedprice) AS bigint) END AS string) AS n1",
        "CAST(element_at(array(100, 500, 2500, 10000, 3000), CAST((CASE l_suppkey % 3 WHEN 0 THEN l_partkey % 4 ELSE l_suppkey % 5 END) + 1 AS int)) AS int) AS fee_pips",
    )
    # the pool order is by address, and every part token sorts after the quote address
    pick = lambda a, b: F.when(F.col("swap_names"), F.col(a)).otherwise(F.col(b))
    requests = raw.select(
        "item", "line", "supp", "owner", "fee_pips",
        pick("t1", "t0").alias("token_a"), pick("t0", "t1").alias("token_b"),
        pick("d1", "d0").alias("decimals_a"), pick("d0", "d1").alias("decimals_b"),
        pick("n1", "n0").alias("amount_a"), pick("n0", "n1").alias("amount_b"),
    )
    reg = registry(spark, sf).select(
        F.col("token1").alias("token0"), F.col("token0").alias("token1"), "fee_pips", "pool"
    )
    allowances = d.table(spark, sf, "part").selectExpr(
        "explode(array('1', '2')) AS who", f"{_TOK.format(p='70', n='p_partkey')} AS token", "p_partkey AS pk",
        "CAST(concat('20', repeat('0', CAST(p_partkey % 19 AS int))) AS decimal(38,0)) AS allowance",
    ).selectExpr("concat(who, '-', CAST(pk AS string)) AS owner", "token", "allowance")
    rows = X.entry_quotes(requests, reg, registry_prices(spark, sf), allowances, F.lit(10.0), F.lit(1.0))
    ok = F.col("error").isNull()
    return rows.select(
        "item", "line", "supp", "error", "flipped", *text("amount0", "amount1", "min0", "min1"),
        F.when(ok, F.col("tick_lower")).alias("tick_lower"), F.when(ok, F.col("tick_upper")).alias("tick_upper"),
        "approve0", "approve1",
    )


@query(
    "holdings",
    """SELECT c_custkey, CASE WHEN cents % 100 = 0 THEN CAST(cents // 100 AS VARCHAR) ELSE (cents // 100) || '.' || rtrim(lpad(CAST(cents % 100 AS VARCHAR), 2, '0'), '0') END AS amount
    FROM (SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) AS cents FROM customer) WHERE cents > 0""",
)
def holdings(spark, sf):
    rows = d.table(spark, sf, "customer").selectExpr(
        "c_custkey",
        "CAST(CAST(round(c_acctbal * 100) AS decimal(18,0)) * 10000000000000000BD AS decimal(38,0)) AS balance",
        "18 AS decimals",
    )
    return X.holdings(rows).select("c_custkey", "amount")


@query(
    "list_positions",
    f"""WITH {_SQL_POS}, n AS (SELECT owner, token_id, row_number() OVER (PARTITION BY owner ORDER BY token_id) AS slot, liq = 0 AS empty FROM pos0)
    SELECT owner, token_id, CAST(slot AS INTEGER) AS slot, empty FROM n""",
)
def list_positions(spark, sf):
    return X.list_positions(positions(spark, sf)).select("owner", "token_id", "slot", "empty")


@query(
    "resolve_tokens",
    """WITH t AS (SELECT o_orderkey, CASE o_custkey % 5 WHEN 0 THEN ' usdt' WHEN 1 THEN 'Cake ' WHEN 2 THEN '0xAB' || lpad(CAST(o_custkey AS VARCHAR), 38, '0') WHEN 3 THEN '0xAB' ELSE o_orderpriority END AS typed FROM orders),
    c AS (SELECT o_orderkey, trim(typed) AS typed FROM t)
    SELECT o_orderkey, CASE WHEN length(typed) = 42 THEN lower(typed) WHEN upper(typed) = 'USDT' THEN '0x55d398326f99059ff775485246999027b3197955' WHEN upper(typed) = 'CAKE' THEN '0x0e09fabb73bd3ade0a17ecc321fd13a19e81ce82' END AS address,
      CASE WHEN length(typed) = 42 THEN substr(typed, 1, 6) || '…' || right(typed, 4) WHEN upper(typed) IN ('USDT', 'CAKE') THEN upper(typed) END AS symbol,
      CASE WHEN upper(typed) IN ('USDT', 'CAKE') THEN CAST(18 AS INTEGER) END AS decimals FROM c""",
)
def resolve_tokens(spark, sf):
    rows = d.table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        f"""CASE o_custkey % 5 WHEN 0 THEN ' usdt' WHEN 1 THEN 'Cake ' WHEN 2 THEN {_TOK.format(p='AB', n='o_custkey')}
             WHEN 3 THEN '0xAB' ELSE o_orderpriority END AS typed""",
    )
    return X.resolve_tokens(rows, "typed").drop("typed")


@query(
    "trail",
    f"""WITH r AS (SELECT o_orderkey AS id, o_custkey, o_orderkey, o_orderdate, CASE WHEN o_orderpriority <> '3-MEDIUM' THEN 'direct' ELSE 'other' END AS source FROM orders),
    n AS (SELECT * FROM r WHERE source = 'direct' ORDER BY strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') DESC, id LIMIT 15),
    dt AS (SELECT n.*, CASE WHEN c_mktsegment <> 'BUILDING' THEN true END AS has, c_nationkey FROM n LEFT JOIN customer ON c_custkey = o_custkey)
    SELECT id, CASE o_orderkey % 4 WHEN 0 THEN '✅' WHEN 1 THEN '❌' WHEN 2 THEN '⏳' ELSE '❔' END AS status_mark,
      CASE WHEN has THEN 'detail' || id ELSE 'list' || id END AS hash,
      CASE WHEN has THEN CASE c_nationkey % 3 WHEN 0 THEN 'position manager' WHEN 1 THEN 'USDT' ELSE '0x70' || '00' || '…' || right(lpad(CAST(o_custkey AS VARCHAR), 38, '0'), 4) END ELSE '' END AS contract_label,
      strftime(o_orderdate, '%Y-%m-%d %H:%M') AS when_utc
    FROM dt""",
)
def trail(spark, sf):
    """The newest direct runs joined to their details; customers of one segment have no details."""
    runs = d.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS id", "o_custkey", "CASE WHEN o_orderpriority <> '3-MEDIUM' THEN 'direct' ELSE 'other' END AS source",
        "CASE o_orderkey % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'system_error' WHEN 2 THEN 'running' END AS status",
        "date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") AS started_at", "concat('list', CAST(o_orderkey AS string)) AS hash",
    )
    details = d.table(spark, sf, "orders").join(
        d.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")
    ).selectExpr(
        "CASE WHEN c_mktsegment <> 'BUILDING' THEN o_orderkey ELSE -o_orderkey END AS id", "concat('detail', CAST(o_orderkey AS string)) AS hash",
        f"""CASE c_nationkey % 3 WHEN 0 THEN upper('{config.POSITION_MANAGER}') WHEN 1 THEN '{config.USDT}'
             ELSE {_TOK.format(p='70', n='c_custkey')} END AS contract""",
    )
    rows = T.trail_labels(T.execution_trail(runs, details, T.MAX_TRAIL))
    return rows.select("id", "status_mark", "hash", "contract_label", "when_utc")
