"""The board plan: swaps of many windows -> scored, gated, enriched board rows.

One lazy DataFrame. Shuffles, all but the first on pre-aggregated rows: (window, pool, trader) and
(window, pool) for the aggregate, pool for the series, (window, board, token) and (window, board)
for the selection. Nothing is broadcast except fixed short lists and what Spark's own size
threshold allows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolscope import config
from poolscope.functions import money as M
from poolscope.operators import aggregate as A
from poolscope.operators import board as B
from poolscope.operators import rank as R
from poolscope.operators import series as S
from poolscope.operators.pools import attach_pools
from poolscope.operators.select import select_by_fdv
from poolscope.sources.logs import window_columns

BOARD_COLUMNS = [
    "window_id", "from_block", "to_block", "board", "label", "variant", "group_pos", "pool", "token", "symbol",
    "volume_usd", "swaps", "traders", "fees_usd", "verified", "risk", "fee_tier", "fee_pips", "rsi", "rsi_label",
    "market_cap_usd", "spike", "lookups", "capped",
]


@dataclass(frozen=True)
class MarketTables:
    """Dimension tables of a run. `rate` is a number, None (unknown) or a (window_id, rate) table."""

    pools: DataFrame
    tokens: DataFrame
    denied: DataFrame
    rate: float | None | DataFrame = None
    symbols: DataFrame | None = None
    audits: DataFrame | None = None


def native_rate(prices: DataFrame, pools: DataFrame, rate_pool: str = config.RATE_POOL, native: str = config.WBNB) -> DataFrame:
    """Native-coin price in dollars from one designated pool; its orientation comes from its own token0.

    `prices` has the latest price per pool, or per window and pool, `pools` the pair. The result has
    a row per window in which the pool traded (`MarketTables.rate` takes it as it is), without
    windows one row; a price that is no positive number gives NULL, which is an unknown rate.
    """
    keys = ["window_id"] if "window_id" in prices.columns else []
    pair = pools.filter(F.lower("pool") == rate_pool).select("pool", F.lower("token0").alias("_t0"))
    rate = M.native_rate_from_sqrt(F.col("sqrt_price"), F.col("_t0") == native)
    return prices.filter(F.lower("pool") == rate_pool).join(pair, "pool").select(*keys, "pool", rate.alias("rate"))


def with_rate(df: DataFrame, rate: float | None | DataFrame) -> DataFrame:
    if isinstance(rate, DataFrame):
        return df.join(rate.select("window_id", F.col("rate").cast("double").alias("_rate")), ["window_id"], "left")
    return df.withColumn("_rate", F.lit(rate).cast("double"))


def pool_samples(
    swaps: DataFrame,
    pools: DataFrame,
    cfg: config.BoardConfig,
    venue: config.VenueConfig = config.V3,
    windows: Callable[[DataFrame], DataFrame] | None = None,
    salt: int | None = None,
) -> DataFrame:
    """Swaps with a window_id -> one sample per (window, pool)."""
    attached = attach_pools(swaps, pools, salt)
    if venue.name == config.CL.name:
        rows = A.aggregate_cl(attached, max_fee_pips=cfg.max_fee_pips)
    else:
        rows = A.aggregate_v3(attached)
    windows = windows or (lambda df: window_columns(df, cfg.lookback_blocks))
    return S.samples(windows(rows), cfg.blocks_per_bucket)


def score_samples(
    sample_rows: DataFrame,
    cfg: config.BoardConfig,
    rate: float | None | DataFrame = None,
    volume_state: DataFrame | None = None,
    candle_state: DataFrame | None = None,
) -> DataFrame:
    """Dollar volume, spike and RSI of each sample, against its pool's own past."""
    history = S.volume_history(sample_rows, cfg.blocks_per_bucket, cfg.history_buckets, volume_state)
    history = history.filter(~F.col("_stored")).drop("_stored", "first_bucket", "pos")
    return score_series(S.candle_series(history, cfg.retained_closes, candle_state), cfg, rate)


def score_series(series: DataFrame, cfg: config.BoardConfig, rate: float | None | DataFrame = None) -> DataFrame:
    """The same from samples that already have their history and price series."""
    series = series.filter(~F.col("_stored")).drop("_stored", "first_bucket", "pos", "candle_live")
    tagged = S.rsi_tag(series, min_volume=cfg.rsi_min_volume).drop("series")
    baseline = S.baseline_rate(
        F.col("history_volume"), F.col("history_blocks"), F.col("history_len"), cfg.spike_min_buckets
    )
    priced = with_rate(tagged, rate).withColumn(
        "volume_usd", M.to_usd(F.col("volume_anchor"), F.col("anchor_kind"), F.col("_rate"))
    )
    spike = S.spike_score(
        F.col("volume_anchor"), F.col("window_blocks"), F.col("volume_usd"), baseline, cfg.spike_floor_usd18, cfg.spike_ceiling
    )
    return priced.withColumn("baseline", baseline).withColumn("spike", spike)


def with_fdv(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    dim = tokens.select("token", F.col("supply_value").alias("_supply"), F.col("decimals").alias("_decimals"))
    found = rows.join(dim, ["token"], "left")
    usd = M.anchor_usd_price(F.col("anchor_kind"), F.col("_rate"))
    fdv = M.fdv_usd(F.col("price"), F.col("_supply"), F.col("_decimals"), usd, config.ANCHOR_DECIMALS)
    return found.withColumn("fdv", fdv).drop("_supply", "_decimals")


def _label(board: Column) -> Column:
    from poolscope.functions.display import pick

    return pick(board, {**config.BOARD_LABELS, config.CL_BOARD: config.CL_LABEL}, None)


def denied_tokens(denied: DataFrame, cfg: config.BoardConfig) -> DataFrame:
    """The denied addresses of a run: the table plus the settings' own, minus those they allow."""
    tokens = denied.select(F.lower("token").alias("token"))
    if cfg.deny_extra:
        extra = denied.sparkSession.createDataFrame([(a.strip().lower(),) for a in cfg.deny_extra], "token string")
        tokens = tokens.unionByName(extra)
    allowed = [a.strip().lower() for a in cfg.deny_allow]
    return tokens.filter(~F.col("token").isin(allowed)) if allowed else tokens


def publishable_pools(tables: MarketTables, cfg: config.BoardConfig, venue: config.VenueConfig = config.V3) -> DataFrame:
    """Pools whose token is not denied and whose anchor has a board.

    The others, among them the busiest pairs, then never reach the aggregates and windows;
    `run_metrics` over all pools' counts tells how many there are.
    """
    pools = B.drop_denied(tables.pools, denied_tokens(tables.denied, cfg)) if cfg.deny_enabled else tables.pools
    return B.route_boards(pools).drop("board") if venue.routed else pools


def publish(
    scored: DataFrame, tables: MarketTables, cfg: config.BoardConfig, venue: config.VenueConfig = config.V3
) -> DataFrame:
    """Scored samples -> board rows: drop denied tokens, route, price, select, then enrich the chosen few."""
    kept = B.drop_denied(scored, denied_tokens(tables.denied, cfg)) if cfg.deny_enabled else scored
    if venue.routed:
        routed = B.route_boards(kept)
    else:
        routed = kept.withColumn("board", F.lit(config.CL_BOARD))
    chosen = select_by_fdv(
        with_fdv(routed, tables.tokens),
        R.rank_key(venue.rank_by),
        cfg.min_market_cap_usd,
        cfg.rows_per_group,
        cfg.max_lookups,
    )
    if "fees_anchor" in chosen.columns:
        chosen = chosen.withColumnRenamed("last_fee_pips", "fee_pips").withColumn("_fees", F.col("fees_anchor"))
    else:
        spot = F.lpad(F.col("last_sqrt_word"), 64, "0")
        text = M.fees_to_anchor(F.col("fees0"), F.col("fees1"), spot, F.col("anchor_is_token0"))
        chosen = chosen.withColumn("_fees", text.try_cast("decimal(38,0)"))
    valued = chosen.withColumn("fees_usd", M.to_usd(F.col("_fees"), F.col("anchor_kind"), F.col("_rate")))
    enriched = B.enrich(valued, tables.symbols, tables.audits)
    return enriched.withColumn("label", _label(F.col("board"))).select(*BOARD_COLUMNS)


def board_rows(
    swaps: DataFrame,
    tables: MarketTables,
    cfg: config.BoardConfig | None = None,
    venue: config.VenueConfig = config.V3,
    windows: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The whole plan for swaps that carry a window_id (see `assign_windows`)."""
    cfg = cfg or config.BoardConfig()
    sample_rows = pool_samples(swaps, publishable_pools(tables, cfg, venue), cfg, venue, windows)
    return publish(score_samples(sample_rows, cfg, tables.rate), tables, cfg, venue)
