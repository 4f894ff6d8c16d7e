"""Liquidity positions, ranges and quotes as table jobs. Bad input fills `error`, it drops no row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poolscope import config
from poolscope.functions import money as M
from poolscope.functions import ticks as X
from poolscope.functions.words import WIDE
from poolscope.operators.asof import asof_join


def sort_pair(df: DataFrame, a: str = "token_a", b: str = "token_b") -> DataFrame:
    """token0, token1 in pool order (address ascending) and whether the pair was flipped."""
    flipped = F.lower(a) > F.lower(b)
    return (
        df.withColumn("token0", F.when(flipped, F.col(b)).otherwise(F.col(a)))
        .withColumn("token1", F.when(flipped, F.col(a)).otherwise(F.col(b)))
        .withColumn("flipped", flipped)
    )


def resolve_tokens(df: DataFrame, name: str, prefix: str = "") -> DataFrame:
    """A typed symbol or address -> address, symbol and decimals. An address wins over an alias.

    Decimals are NULL for a raw address (to be read from the token table) and everything is NULL
    for an unknown name.
    """
    from poolscope.functions.display import short_addr
    from poolscope.sources.reference import lookup

    typed = F.trim(name)
    upper = F.upper(typed)
    raw = typed.rlike("^0x[0-9a-fA-F]{40}$")
    alias = lookup(upper, {s: a for s, (a, _) in config.TOKEN_ALIASES.items()})
    digits = lookup(upper, {s: str(d) for s, (_, d) in config.TOKEN_ALIASES.items()})
    return (
        df.withColumn(f"{prefix}address", F.when(raw, F.lower(typed)).otherwise(alias))
        .withColumn(f"{prefix}symbol", F.when(raw, short_addr(typed)).when(alias.isNotNull(), upper))
        .withColumn(f"{prefix}decimals", F.when(~raw, digits.cast("int")))
    )


def value_positions(positions: DataFrame, prices: DataFrame, exact: bool = False) -> DataFrame:
    """Token amounts each position is worth at its pool's price.

    Default: DOUBLE columns. exact=True: integer text, which needs `sqrt_price_word` in the prices. NULL amounts mean an inverted range or no price.
    """
    return _valued(positions.join(prices, ["pool"], "left"), exact)


def value_positions_asof(positions: DataFrame, swaps: DataFrame, at: str, exact: bool = False, salt: int | None = None) -> DataFrame:
    """The same, each position at its pool's latest price at or before its own block `at`.

    `swaps` has pool, block_number, seq, sqrt_price and price_block, and sqrt_price_word for `exact`.
    """
    values = ["sqrt_price", "price_block", *(["sqrt_price_word"] if exact else [])]
    return _valued(asof_join(positions, swaps, values, at=at, salt=salt), exact)


def _valued(joined: DataFrame, exact: bool) -> DataFrame:
    lower, upper = F.col("tick_lower"), F.col("tick_upper")
    error = F.when(lower >= upper, F.lit("empty range")).when(
        (lower < config.MIN_TICK) | (upper > config.MAX_TICK), F.lit("tick out of range")
    )
    if exact:
        both = X.exact_position_amounts(F.col("liquidity"), lower, upper, F.col("sqrt_price_word"))
        out = joined.withColumn("_v", both)
        out = out.withColumns({"amount0": F.col("_v.amount0"), "amount1": F.col("_v.amount1")}).drop("_v")
    else:
        amount0, amount1 = X.position_amounts(F.col("liquidity"), lower, upper, F.col("sqrt_price"))
        out = joined.withColumn("amount0", amount0).withColumn("amount1", amount1)
    return out.withColumn("error", error)


def liquidity_share(liquidity: Column, pct: Column) -> Column:
    """Liquidity to withdraw: everything at 100 %, else truncated to a hundredth of a percent."""
    part = M.mul_div(liquidity, F.floor(pct * 100 + 0.5).cast("decimal(18,0)"), 10_000)
    return F.when(pct >= 100, liquidity.cast(WIDE)).otherwise(part)


def exit_quotes(
    positions: DataFrame, prices: DataFrame, pct: Column, slippage_pct: Column, exact: bool = False
) -> DataFrame:
    """Exit quote per position: share, expected amounts, slippage floors and the steps to take.

    Steps: withdraw if there is liquidity, collect always, burn on a full exit. An empty position,
    a percent out of (0, 100] or a share that rounds to nothing is rejected in `error`.
    """
    staged = positions.withColumn("pct", pct).withColumn("slippage_pct", slippage_pct)
    staged = staged.withColumn("liquidity_out", liquidity_share(F.col("liquidity"), F.col("pct")))
    empty = (F.col("liquidity") == 0) & (F.col("owed0") == 0) & (F.col("owed1") == 0)
    problem = (
        F.when(~((F.col("pct") > 0) & (F.col("pct") <= 100)), F.lit("percent out of range"))
        .when(empty, F.lit("already empty"))
        .when((F.col("liquidity") > 0) & (F.col("liquidity_out") == 0), F.lit("rounds to zero liquidity"))
    )
    staged = staged.withColumn("_problem", problem).withColumn("_held", F.col("liquidity"))
    valued = value_positions(staged.withColumn("liquidity", F.col("liquidity_out")), prices, exact)
    valued = valued.withColumn("error", F.coalesce(F.col("_problem"), F.col("error")))
    ok = F.col("error").isNull()
    full = F.col("pct") >= 100
    for leg in ("0", "1"):
        # floor of a DOUBLE estimate goes through DECIMAL text-free: amounts stay below 2^124 or turn NULL
        whole = F.col(f"amount{leg}").cast("decimal(38,0)") if exact else F.floor(F.col(f"amount{leg}").cast("decimal(38,6)")).cast(WIDE)
        valued = valued.withColumn(f"expected{leg}", F.when(ok, whole))
        valued = valued.withColumn(f"min{leg}", M.apply_slippage(F.col(f"expected{leg}"), F.col("slippage_pct")))
    steps = F.array_compact(
        F.array(F.when(F.col("liquidity_out") > 0, F.lit("withdraw")), F.lit("collect"), F.when(full, F.lit("burn")))
    )
    return (
        valued.withColumn("steps", F.when(ok, steps))
        .withColumn("full_exit", full)
        .withColumn("liquidity", F.col("_held"))
        .drop("_problem", "_held", "amount0", "amount1")
    )


def plan_ranges(
    df: DataFrame, pct: Column, side: Column | None = None, offset_pct: Column | None = None,
    tick: str = "tick", fee: str = "fee_pips",
) -> DataFrame:
    """tick_lower, tick_upper and spacing: a band around the price, or a one-sided range off it."""
    t, f = F.col(tick), F.col(fee)
    # Logarithms and the spacing are columns of their own, so each is computed once per row.
    prepared = {"spacing": X.tick_spacing(f), "_width": X.tick_distance(pct)}
    error = X.range_error(pct, f)
    if side is not None:
        offset = offset_pct if offset_pct is not None else F.lit(1.0)
        prepared |= {"_side": side, "_near": X.tick_distance(offset), "_far": X.tick_distance(offset + pct)}
        error = F.coalesce(error, F.when(side.isNotNull(), X.range_error(offset, f)))
    staged = df.withColumns({**prepared, "range_error": error})
    lower, upper = X.symmetric_range(t, F.col("_width"), F.col("spacing"))
    if side is not None:
        around = F.col("_side").isNull()
        single = X.one_sided_range(t, F.col("_side") == "token1", F.col("_near"), F.col("_far"), F.col("spacing"))
        lower, upper = (F.when(around, a).otherwise(b) for a, b in zip((lower, upper), single))
    ok = F.col("range_error").isNull()
    ranged = staged.withColumns({"tick_lower": F.when(ok, lower), "tick_upper": F.when(ok, upper)})
    return ranged.drop("_width", "_side", "_near", "_far")


def approval_gap(requests: DataFrame, allowances: DataFrame) -> DataFrame:
    """Amounts above zero whose allowance is short; a missing allowance counts as zero."""
    joined = requests.join(allowances.select("owner", "token", "allowance"), ["owner", "token"], "left")
    have = F.coalesce(F.col("allowance"), F.lit(0).cast(WIDE))
    return joined.filter((F.col("amount") > 0) & (have < F.col("amount"))).withColumn("allowance", have)


def pool_quotes(requests: DataFrame, registry: DataFrame, prices: DataFrame) -> DataFrame:
    """Pool, human price, tick and spacing of each requested (token0, token1, fee).

    Missing or zero pools and unsupported tiers end up in `error`.
    """
    reg = registry.select("token0", "token1", "fee_pips", F.lower("pool").alias("pool"))
    found = requests.join(reg, ["token0", "token1", "fee_pips"], "left")
    priced = found.join(prices.select("pool", "sqrt_price", "tick"), ["pool"], "left")
    error = (
        F.when(X.tick_spacing(F.col("fee_pips")).isNull(), F.lit("unsupported fee tier"))
        .when(F.col("pool").isNull() | (F.col("pool") == config.ZERO_ADDRESS), F.lit("no such pool"))
        .when(F.col("sqrt_price").isNull(), F.lit("no price"))
    )
    ok = error.isNull()
    return (
        priced.withColumn("error", error)
        .withColumn("spacing", X.tick_spacing(F.col("fee_pips")))
        .withColumn("price", F.when(ok, M.price_from_sqrt(F.col("sqrt_price"), F.col("decimals0"), F.col("decimals1"))))
    )


def entry_quotes(
    requests: DataFrame,
    registry: DataFrame,
    prices: DataFrame,
    allowances: DataFrame,
    range_pct: Column,
    slippage_pct: Column,
    offset_pct: Column | None = None,
) -> DataFrame:
    """Entry quote per request: pool order, mapped amounts, range, price bounds, floors, approvals.

    Requests: request_id, owner, token_a, token_b, decimals_a, decimals_b, fee_pips, amount_a,
    amount_b (typed text). A zero amount puts the whole range on one side of the price.
    """
    paired = sort_pair(requests)
    flip = F.col("flipped")
    for leg, other in (("0", "1"), ("1", "0")):
        first, second = ("a", "b") if leg == "0" else ("b", "a")
        text = F.when(flip, F.col(f"amount_{second}")).otherwise(F.col(f"amount_{first}"))
        digits = F.when(flip, F.col(f"decimals_{second}")).otherwise(F.col(f"decimals_{first}"))
        paired = paired.withColumn(f"decimals{leg}", digits).withColumn(f"_text{leg}", text)
    for leg in ("0", "1"):
        text, digits = F.col(f"_text{leg}"), F.col(f"decimals{leg}")
        paired = paired.withColumns(
            {f"amount{leg}": M.to_base_units(text, digits), f"_bad{leg}": M.units_error(text, digits)}
        )
    quoted = pool_quotes(paired, registry, prices)
    zero0, zero1 = F.col("amount0") == 0, F.col("amount1") == 0
    side = F.when(zero0, F.lit("token1")).when(zero1, F.lit("token0"))
    ranged = plan_ranges(quoted.withColumn("side", side), range_pct, F.col("side"), offset_pct)
    error = F.coalesce(
        F.col("_bad0"), F.col("_bad1"), F.when(zero0 & zero1, F.lit("both amounts are zero")), F.col("error"), F.col("range_error")
    )
    scale = F.pow(F.lit(10.0), (F.col("decimals0") - F.col("decimals1")).cast("double"))
    out = ranged.withColumn("error", error)
    for bound in ("lower", "upper"):
        out = out.withColumn(f"price_{bound}", F.pow(F.lit(1.0001), F.col(f"tick_{bound}").cast("double")) * scale)
    for leg in ("0", "1"):
        out = out.withColumn(f"min{leg}", M.apply_slippage(F.col(f"amount{leg}"), slippage_pct))
        granted = allowances.select(
            "owner", F.col("token").alias(f"token{leg}"), F.col("allowance").alias(f"_allow{leg}")
        )
        out = out.join(granted, ["owner", f"token{leg}"], "left")
        have = F.coalesce(F.col(f"_allow{leg}"), F.lit(0).cast(WIDE))
        short = (F.col(f"amount{leg}") > 0) & (have < F.col(f"amount{leg}"))
        out = out.withColumn(f"approve{leg}", F.coalesce(short, F.lit(False)) & F.col("error").isNull())
    return out.drop("_text0", "_text1", "_bad0", "_bad1", "_allow0", "_allow1", "range_error")


def holdings(balances: DataFrame) -> DataFrame:
    """Non-zero balances in human units."""
    return balances.filter(F.col("balance") > 0).withColumn(
        "amount", M.from_base_units(F.col("balance"), F.col("decimals"))
    )


def list_positions(positions: DataFrame, limit: int | None = None) -> DataFrame:
    """Positions of each owner with their slot numbers; the first `limit` of them where one is given."""
    w = Window.partitionBy("owner").orderBy("token_id")
    numbered = positions.withColumn("slot", F.row_number().over(w))
    if limit is not None:
        numbered = numbered.filter(F.col("slot") <= limit)
    return numbered.withColumn("empty", F.col("liquidity") == 0)
