"""Pool and token dimensions built, refreshed and joined, over rows derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from poolscope import config
from poolscope.operators import aggregate as A
from poolscope.operators import audit as U
from poolscope.operators import board as B
from poolscope.operators import dims as D
from poolscope.operators import pools as P
from poolscope.operators import positions as X
from poolscope.sources.reference import denylist_df
from workload import derive as d
from workload.market import text
from workload.registry import query

_ANCHORS = [config.NATIVE_COIN, config.WBNB, config.USDT, config.USDC, config.USD1]


def _currency(expr: str, number: str, prefix: str, cast: str) -> str:
    """One of the five anchors for codes 0-4, else a token address made from a number."""
    whens = " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(_ANCHORS))
    return f"CASE {expr} {whens} ELSE concat('{prefix}', lpad(CAST({number} AS {cast}), 38, '0')) END"


def pairs(spark, sf):
    """One currency pair per line item; about a third have exactly one anchor."""
    c0 = _currency("l_partkey % 12", "l_partkey", "0x70", "string")
    c1 = _currency("l_suppkey % 9", "l_suppkey", "0x71", "string")
    items = d.table(spark, sf, "lineitem")
    return items.selectExpr("l_orderkey AS item", "l_linenumber AS line", f"upper({c0}) AS c0", f"{c1} AS c1").selectExpr(
        "item", "line", "concat('0x', substr(c0, 3)) AS currency0", "c1 AS currency1"
    )


_SQL_PAIRS = f"""pairs AS (
  SELECT l_orderkey AS item, l_linenumber AS line, {_currency('l_partkey % 12', 'l_partkey', '0x70', 'VARCHAR')} AS c0,
    {_currency('l_suppkey % 9', 'l_suppkey', '0x71', 'VARCHAR')} AS c1, l_partkey % 12 AS k0, l_suppkey % 9 AS k1 FROM lineitem),
sided AS (
  SELECT item, line, CASE WHEN k0 < 5 THEN c1 ELSE c0 END AS token, CASE WHEN k0 < 5 THEN c0 ELSE c1 END AS anchor,
    CASE WHEN CASE WHEN k0 < 5 THEN k0 ELSE k1 END < 2 THEN 'bnb' ELSE 'usd' END AS anchor_kind, k0 < 5 AS anchor_is_token0,
    CASE WHEN k0 < 5 THEN k0 ELSE k1 END AS ak
  FROM pairs WHERE (k0 < 5) <> (k1 < 5))"""


@query("anchor_side", f"WITH {_SQL_PAIRS} SELECT item, line, token, anchor, anchor_kind, anchor_is_token0 FROM sided")
def anchor_side(spark, sf):
    rows = P.anchor_side(pairs(spark, sf))
    return rows.select("item", "line", "token", "anchor", "anchor_kind", "anchor_is_token0")


@query(
    "board_route",
    f"""WITH {_SQL_PAIRS} SELECT coalesce(CASE WHEN ak < 2 THEN 'wbnb' WHEN ak = 2 THEN 'usdt' END, 'none') AS board,
      count(*) AS pools, count(DISTINCT token) AS tokens FROM sided GROUP BY 1""",
)
def board_route(spark, sf):
    routed = B.route_boards(P.anchor_side(pairs(spark, sf)), keep_unrouted=True)
    return routed.groupBy(F.coalesce("board", F.lit("none")).alias("board")).agg(
        F.count(F.lit(1)).alias("pools"), F.count_distinct("token").alias("tokens")
    )


@query(
    "deny_filter",
    f"""WITH {_SQL_PAIRS} SELECT token, count(*) AS rows_kept FROM sided
    WHERE token NOT IN ('{config.USDC}', '{config.USD1}', '0x70' || lpad('7', 38, '0'), '0x71' || lpad('8', 38, '0'))
    GROUP BY token""",
)
def deny_filter(spark, sf):
    """The curated list plus two extra tokens minus one allowed; malformed extras are ignored."""
    extra = ("0x70" + "7".rjust(38, "0"), "0X71" + "8".rjust(38, "0"), "not an address")
    denied = denylist_df(spark, extra=extra, allow=(config.USDT,))
    rows = P.anchor_side(pairs(spark, sf))
    return B.drop_denied(rows, denied).groupBy("token").agg(F.count(F.lit(1)).alias("rows_kept"))


@query(
    "canonical_pools",
    f"""WITH k AS (SELECT o_orderkey AS id, o_custkey AS c FROM orders),
    s AS (SELECT id, c, c % 4 AS a, CASE WHEN id % 19 = 0 THEN NULL WHEN id % 23 = 0 THEN 'no' WHEN c % 4 = 3 THEN 'no'
        WHEN id % 29 = 0 THEN NULL WHEN id % 31 = 0 THEN 'no' WHEN id % 37 = 0 THEN NULL WHEN id % 9 = 0 THEN 'no' ELSE 'ok' END AS st FROM k)
    SELECT '0xb0' || lpad(CAST(id AS VARCHAR), 38, '0') AS pool, CASE st WHEN 'no' THEN 'rejected' ELSE st END AS status,
      CASE WHEN st = 'ok' THEN '0x70' || lpad(CAST(c AS VARCHAR), 38, '0') END AS token,
      CASE WHEN st = 'ok' THEN CASE a WHEN 0 THEN '{config.WBNB}' WHEN 1 THEN '{config.USDT}' ELSE '{config.USD1}' END END AS anchor,
      CASE WHEN st = 'ok' THEN CAST(2500 AS INTEGER) END AS fee_pips
    FROM s""",
)
def canonical_pools(spark, sf):
    """Pool answers judged in phases: pair, anchor, fee, registry. Silence keeps a pool undecided."""
    pad = lambda e: f"concat('0x', lpad(substr({e}, 3), 64, '0'))"
    anchor = f"""CASE c % 4 WHEN 0 THEN '{config.WBNB}' WHEN 1 THEN '{config.USDT}' WHEN 2 THEN '{config.USD1}'
                 ELSE concat('0x71', lpad(CAST(c AS string), 38, '0')) END"""
    token = "concat('0x70', lpad(CAST(c AS string), 38, '0'))"
    own = "concat('0xb0', lpad(CAST(id AS string), 38, '0'))"
    calls = d.table(spark, sf, "orders").selectExpr("o_orderkey AS id", "o_custkey AS c").selectExpr(
        f"{own} AS pool",
        f"CASE WHEN id % 19 = 0 THEN NULL WHEN id % 23 = 0 THEN '0x' ELSE {pad(token)} END AS token0_raw",
        f"{pad(anchor)} AS token1_raw",
        "CASE WHEN id % 29 = 0 THEN NULL WHEN id % 31 = 0 THEN '0x' ELSE concat('0x', lpad(hex(2500), 64, '0')) END AS fee_raw",
        f"""CASE WHEN id % 37 = 0 THEN NULL WHEN id % 9 = 0 THEN concat('0x', repeat('0', 64)) ELSE {pad(own)} END AS registry_raw""",
    )
    return P.build_v3_pools(calls).select("pool", "status", "token", "anchor", "fee_pips")


@query(
    "registry_match",
    f"""WITH {_SQL_PAIRS}, cand AS (SELECT DISTINCT token, anchor FROM sided)
    SELECT token, anchor FROM cand WHERE CAST(substr(token, 5) AS BIGINT) % 3 <> 0""",
)
def registry_match(spark, sf):
    """Candidates whose (token0, token1, fee) the registry maps to another pool are forks."""
    cand = P.anchor_side(pairs(spark, sf)).select("token", "anchor").distinct()
    cand = cand.selectExpr(
        "token", "anchor", "token AS token0", "anchor AS token1", "2500 AS fee_pips", "substr(sha2(concat(token, anchor), 256), 1, 40) AS pool"
    )
    number = "CAST(substr(token0, 5) AS bigint)"
    registry = cand.selectExpr("token0", "token1", "fee_pips", f"CASE WHEN {number} % 3 = 0 THEN 'fork' ELSE pool END AS pool")
    return P.canonical_pools(cand, registry).select("token", "anchor")


_NOW = 1_000_000_000


def _stored(spark, sf):
    """A dimension of parts: some fresh, some stale, some rejected; large parts are stored under keys nobody asks for."""
    return d.table(spark, sf, "part").selectExpr(
        "CASE WHEN p_size <= 40 THEN p_partkey ELSE -p_partkey END AS k",
        "CASE WHEN p_partkey % 3 = 0 THEN 'rejected' ELSE 'ok' END AS status",
        "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END AS brand",
        f"CAST({_NOW} - p_size * 1000000 AS bigint) AS checked_at",
    )


@query(
    "keys_to_refresh",
    """SELECT DISTINCT l_partkey AS k FROM lineitem
    LEFT JOIN part ON p_partkey = l_partkey AND p_size <= 40
    WHERE p_partkey IS NULL OR (p_partkey % 3 = 0 AND p_size * 1000000 >= 21600000)""",
)
def keys_to_refresh(spark, sf):
    requested = d.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("k"))
    return D.keys_to_refresh(requested, _stored(spark, sf), "k", _NOW, None, config.UNVERIFIED_TTL_MS)


@query(
    "merge_lookup",
    f"""WITH dim AS (SELECT CASE WHEN p_size <= 40 THEN p_partkey ELSE -p_partkey END AS k, CASE WHEN p_partkey % 3 = 0 THEN 'rejected' ELSE 'ok' END AS status,
      CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END AS brand, {_NOW} - p_size * 1000000 AS checked_at
      FROM part),
    ans AS (SELECT p_partkey AS k, CASE WHEN p_size > 10 THEN CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'rejected' ELSE 'ok' END END AS st,
      CASE WHEN p_partkey % 4 >= 2 THEN p_type END AS brand FROM part)
    SELECT coalesce(d.k, a.k) AS k, coalesce(a.st, d.status) AS status, CASE WHEN a.st IS NULL THEN d.brand ELSE a.brand END AS brand,
      CAST(CASE WHEN a.st IS NULL THEN d.checked_at ELSE {_NOW} END AS BIGINT) AS checked_at
    FROM dim d FULL JOIN (SELECT * FROM ans WHERE st IS NOT NULL) a USING (k)""",
)
def merge_lookup(spark, sf):
    answers = d.table(spark, sf, "part").selectExpr(
        "p_partkey AS k",
        "CASE WHEN p_size > 10 THEN CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'rejected' ELSE 'ok' END END AS status",
        "CASE WHEN p_partkey % 4 >= 2 THEN p_type END AS brand",
    )
    return D.merge_lookup(_stored(spark, sf), answers, "k", _NOW)


@query(
    "build_tokens",
    """SELECT '0x70' || lpad(CAST(o_orderkey AS VARCHAR), 38, '0') AS token,
      CASE WHEN o_orderkey % 5 <> 1 THEN CAST(CAST(o_custkey AS HUGEINT) * 18446744073709551616 + o_orderkey AS VARCHAR) END AS supply,
      CAST(o_custkey % 50 AS INTEGER) AS decimals
    FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_custkey % 50 <= 36""",
)
def build_tokens(spark, sf):
    """Two answers per token; a missing one, a silent one or absurd decimals store nothing."""
    wide = "CASE WHEN o_orderkey % 5 = 1 THEN 'f' ELSE '0' END"
    calls = d.table(spark, sf, "orders").selectExpr(
        "concat('0x70', lpad(CAST(o_orderkey AS string), 38, '0')) AS token",
        f"""CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE concat('0x', {wide}, repeat('0', 31),
              lpad(lower(hex(o_custkey)), 16, '0'), lpad(lower(hex(o_orderkey)), 16, '0')) END AS supply_raw""",
        "CASE WHEN o_orderkey % 11 = 0 THEN '0x' ELSE concat('0x', lpad(lower(hex(o_custkey % 50)), 64, '0')) END AS decimals_raw",
    )
    return D.build_tokens(calls).select("token", *text("supply"), "decimals")


@query(
    "hydrate",
    f"""WITH {_SQL_PAIRS}, t AS (SELECT item, line, c1 AS token, CASE WHEN k1 >= 5 THEN CAST(substr(c1, 5) AS BIGINT) END AS n FROM pairs)
    SELECT item, line, CASE token WHEN '{config.WBNB}' THEN 'WBNB' WHEN '{config.USDT}' THEN 'USDT' WHEN '{config.USDC}' THEN 'USDC'
        WHEN '{config.USD1}' THEN 'USD1' ELSE CASE WHEN s_acctbal >= 2000 AND n % 4 = 0 THEN 'S' || n ELSE substr(token, 1, 6) || '…' || right(token, 4) END END AS t_symbol,
      CASE WHEN n IS NULL THEN CASE WHEN token <> '{config.NATIVE_COIN}' THEN CAST(18 AS INTEGER) END
           WHEN s_acctbal >= 2000 THEN CAST(n % 19 AS INTEGER) END AS t_decimals
    FROM t LEFT JOIN supplier ON s_suppkey = n""",
)
def hydrate(spark, sf):
    """Symbols and decimals of a token column: aliases, then the token table, then a short address."""
    tokens = d.table(spark, sf, "supplier").selectExpr(
        "concat(CASE WHEN s_acctbal >= 2000 THEN '0x71' ELSE '0x72' END, lpad(CAST(s_suppkey AS string), 38, '0')) AS token",
        "CASE WHEN s_suppkey % 4 = 0 THEN concat('S', CAST(s_suppkey AS string)) ELSE '' END AS symbol",
        "CAST(s_suppkey % 19 AS int) AS decimals",
    )
    rows = D.hydrate_tokens(pairs(spark, sf), tokens, "currency1", "t")
    return rows.select("item", "line", "t_symbol", "t_decimals")


@query(
    "enrich",
    f"""WITH {d.SQL_AGG}
    SELECT window_id, pool, CASE WHEN t % 3 = 0 OR t = 5 THEN substr(token, 1, 8) ELSE 'TK' || t END AS symbol,
      CASE WHEN t % 4 <> 1 THEN t % 4 <> 2 END AS verified,
      CASE WHEN t % 4 <> 1 THEN CASE WHEN t % 4 = 2 THEN 'unknown' WHEN t % 8 = 0 THEN 'high' ELSE 'clean' END END AS risk,
      CASE fee_pips WHEN 100 THEN '0.01%' WHEN 500 THEN '0.05%' WHEN 2500 THEN '0.25%' ELSE '1%' END AS fee_tier
    FROM agg""",
)
def enrich(spark, sf):
    from workload.market import v3_aggregate

    rows = B.enrich(v3_aggregate(spark, sf), d.tokens(spark).select("token", "symbol"), d.audits(spark))
    return rows.select("window_id", "pool", "symbol", "verified", "risk", "fee_tier")


@query(
    "needs_audit",
    f"""WITH {_SQL_PAIRS}, both_sides AS (SELECT c0 AS token FROM pairs UNION SELECT c1 FROM pairs)
    SELECT token FROM both_sides WHERE token NOT IN ('{config.WBNB}', '{config.USDT}', '{config.USDC}', '{config.USD1}')""",
)
def needs_audit(spark, sf):
    return U.tokens_needing_audit(pairs(spark, sf), ("currency0", "currency1"))


@query(
    "approval_gap",
    """WITH allow AS (SELECT c_custkey AS owner, CAST(round(c_acctbal * 10) AS BIGINT) AS allowance FROM customer WHERE c_mktsegment <> 'MACHINERY'),
    req AS (SELECT o_orderkey AS id, o_custkey AS owner, CAST(round(o_totalprice / 10) AS BIGINT) * (o_orderkey % 3) AS amount FROM orders)
    SELECT id, owner, CAST(amount AS VARCHAR) AS amount, CAST(coalesce(allowance, 0) AS VARCHAR) AS allowance
    FROM req LEFT JOIN allow USING (owner) WHERE amount > 0 AND coalesce(allowance, 0) < amount""",
)
def approval_gap(spark, sf):
    requests = d.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS id", "o_custkey AS owner", "'t' AS token",
        "CAST(CAST(round(o_totalprice / 10) AS bigint) * (o_orderkey % 3) AS decimal(38,0)) AS amount",
    )
    allowances = d.table(spark, sf, "customer").selectExpr(
        "c_custkey AS owner", "CASE WHEN c_mktsegment <> 'MACHINERY' THEN 't' ELSE 'other' END AS token", "CAST(CAST(round(c_acctbal * 10) AS bigint) AS decimal(38,0)) AS allowance"
    )
    return X.approval_gap(requests, allowances).select("id", "owner", *text("amount", "allowance"))


@query(
    "asof_price",
    f"""WITH {d.SQL_SWAPS}
    SELECT pool, arg_max(sqrt_price, seq) AS sqrt_price, arg_max(block_number, seq) AS price_block
    FROM swaps WHERE block_number <= 2500000 GROUP BY pool""",
)
def asof_price(spark, sf):
    return A.latest_price(d.swaps(spark, sf), as_of=2_500_000)


@query(
    "last_price",
    f"""WITH {d.SQL_SWAPS}
    SELECT window_id, pool, arg_max(sqrt_price, seq) AS sqrt_price, arg_max(block_number, seq) AS block_number
    FROM swaps GROUP BY window_id, pool""",
)
def last_price(spark, sf):
    return A.last_value(d.swaps(spark, sf), ["window_id", "pool"], ["sqrt_price", "block_number"])


@query(
    "reference_tables",
    f"""WITH {d.SQL_SWAPS}, {d.SQL_POOLS},
    spaced AS (SELECT p.*, CASE fee_pips WHEN 100 THEN 1 WHEN 500 THEN 10 WHEN 2500 THEN 50 ELSE 200 END AS spacing FROM pools p)
    SELECT CASE board WHEN 'wbnb' THEN 'PancakeSwap v3 (WBNB pairs)' WHEN 'usdt' THEN 'PancakeSwap v3 (USDT pairs)' END AS label,
      CAST(CASE board WHEN 'wbnb' THEN 1 WHEN 'usdt' THEN 2 END AS INTEGER) AS board_order, anchor_kind, CAST(spacing AS INTEGER) AS spacing,
      CASE WHEN anchor = '{config.NATIVE_COIN}' THEN NULL ELSE 18 END AS anchor_decimals, count(*) AS swaps
    FROM swaps JOIN spaced USING (pool_id) GROUP BY ALL""",
)
def reference_tables(spark, sf):
    """Swaps per board, anchor kind and tick spacing, by joins with the reference tables."""
    from poolscope.operators.pools import is_anchor
    from poolscope.sources import reference as R

    pairs = d.pools(spark).filter(is_anchor(F.col("anchor"))).drop("anchor_kind")
    known = pairs.join(R.anchors_df(spark), "anchor").join(R.boards_df(spark), "anchor", "left").join(R.tick_spacing_df(spark), "fee_pips")
    alias = R.token_alias_df(spark).select(F.col("token").alias("anchor"), F.col("decimals").alias("anchor_decimals"))
    rows = d.swaps(spark, sf).join(known.join(alias, "anchor", "left"), "pool")
    return rows.groupBy("label", "board_order", "anchor_kind", "spacing", "anchor_decimals").agg(F.count(F.lit(1)).alias("swaps"))
