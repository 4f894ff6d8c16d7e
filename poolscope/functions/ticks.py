"""Concentrated-liquidity tick maths as column expressions."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from poolscope.config import MAX_TICK, MIN_TICK, TICK_SPACING
from poolscope.functions.money import Q96

_LOG_BASE = math.log(1.0001)


def tick_spacing(fee: Column) -> Column:
    """Spacing of a fee tier, NULL for an unsupported tier."""
    out = F.lit(None).cast("int")
    for tier, spacing in TICK_SPACING.items():
        out = F.when(fee == tier, F.lit(spacing)).otherwise(out)
    return out


def align_tick(tick: Column, spacing: Column, up: bool) -> Column:
    steps = F.ceil(tick / spacing) if up else F.floor(tick / spacing)
    return F.least(F.greatest(steps * spacing, F.lit(MIN_TICK)), F.lit(MAX_TICK)).cast("int")


def tick_distance(pct: Column) -> Column:
    """How many ticks a pct price move spans."""
    return F.log(1.0 + pct / 100.0) / F.lit(_LOG_BASE)


def range_error(pct: Column, fee: Column) -> Column:
    return F.when(tick_spacing(fee).isNull(), F.lit("unsupported fee tier")).when(
        ~((pct > 0) & (pct < 100)) | pct.isNull(), F.lit("range must be between 0 and 100 percent")
    )


def symmetric_range(tick: Column, width: Column, spacing: Column) -> tuple[Column, Column]:
    """(lower, upper) of a band `width` ticks around the tick, widened when it collapses."""
    lower = align_tick(tick - width, spacing, up=False)
    upper = align_tick(tick + width, spacing, up=True)
    empty = lower == upper
    return (
        F.when(empty, align_tick(lower - spacing, spacing, up=False)).otherwise(lower),
        F.when(empty, align_tick(upper + spacing, spacing, up=True)).otherwise(upper),
    )


def one_sided_range(
    tick: Column, below: Column, near: Column, far: Column, spacing: Column
) -> tuple[Column, Column]:
    """(lower, upper) from `near` to `far` ticks off the price: under it for token1, over it for token0."""
    inner_down, outer_down = align_tick(tick - near, spacing, up=False), align_tick(tick - far, spacing, up=False)
    inner_up, outer_up = align_tick(tick + near, spacing, up=True), align_tick(tick + far, spacing, up=True)
    lower = F.when(outer_down >= inner_down, align_tick(inner_down - spacing, spacing, up=False)).otherwise(outer_down)
    upper = F.when(outer_up <= inner_up, align_tick(inner_up + spacing, spacing, up=True)).otherwise(outer_up)
    return F.when(below, lower).otherwise(inner_up), F.when(below, inner_down).otherwise(upper)


def sqrt_ratio(tick: Column) -> Column:
    """floor(sqrt(1.0001^tick) * 2^96) as DOUBLE; NULL outside the tick bounds."""
    inside = tick.between(MIN_TICK, MAX_TICK)
    # no floor(): BIGINT cannot hold 2^96, and above 2^53 a DOUBLE has no fraction left to drop
    return F.when(inside, F.pow(F.lit(1.0001), tick / 2.0) * F.lit(Q96))


def position_amounts(
    liquidity: Column, tick_lower: Column, tick_upper: Column, sqrt_price: Column
) -> tuple[Column, Column]:
    """Token amounts a position is worth, as DOUBLE; NULL for an inverted range."""
    a, b = sqrt_ratio(tick_lower), sqrt_ratio(tick_upper)
    p = F.least(F.greatest(sqrt_price, a), b)
    depth = liquidity.cast("double")
    amount0 = F.when(p < b, depth * (b - p) / p * F.lit(Q96) / b).otherwise(F.lit(0.0))
    amount1 = F.when(p > a, depth * (p - a) / F.lit(Q96)).otherwise(F.lit(0.0))
    valid = (tick_lower < tick_upper) & a.isNotNull() & b.isNotNull() & sqrt_price.isNotNull()
    some = liquidity > 0
    return (
        F.when(valid, F.when(some, amount0).otherwise(F.lit(0.0))),
        F.when(valid, F.when(some, amount1).otherwise(F.lit(0.0))),
    )


def exact_amounts_between(liquidity: Column, low: Column, high: Column, sqrt_word: Column) -> Column:
    """Struct (amount0, amount1), decimal text, of liquidity between two square-root prices at the price `sqrt_word`.

    `low` and `high` are DOUBLE, taken digit for digit. amount0 = floor(L * (high - p) * 2^96 / (p * high)) and
    amount1 = floor(L * (p - low) / 2^96), with p clamped to the range. The products pass 400 bits, so they are made
    of Python's integers, a batch of rows at a time; limb columns take over twenty times as long. NULL for an empty or
    unknown range and an unknown price.
    """

    def amounts(size: pa.Array, at: pa.Array, low: pa.Array, high: pa.Array) -> pa.Array:
        first, second, unknown = [], [], []
        for row in zip(size.to_pylist(), at.to_pylist(), low.to_pylist(), high.to_pylist(), strict=True):
            unknown.append(None in row)
            if unknown[-1]:
                first.append(None)
                second.append(None)
                continue
            held, a, b = int(row[0]), int(row[2]), int(row[3])
            p = min(max(int(row[1], 16), a), b)
            first.append(str((held * (b - p) << 96) // (p * b)) if p and b else None)
            second.append(str(held * (p - a) >> 96))
        columns = [pa.array(first, pa.string()), pa.array(second, pa.string())]
        return pa.StructArray.from_arrays(columns, names=["amount0", "amount1"], mask=pa.array(unknown, pa.bool_()))

    digits = F.greatest(liquidity, F.lit(0)).cast("string")
    whole = lambda x: F.when((x >= 0) & (x < F.lit(2.0**192)), x.cast("double"))
    return F.arrow_udf(amounts, "amount0 string, amount1 string")(
        F.when(digits.rlike("^[0-9]+$"), digits), F.when(sqrt_word.rlike("^[0-9a-fA-F]{1,64}$"), sqrt_word),
        whole(F.when(low < high, low)), whole(high),
    )


def exact_position_amounts(liquidity: Column, tick_lower: Column, tick_upper: Column, sqrt_word: Column) -> Column:
    """Same amounts as exact integers in text (struct of amount0, amount1); NULL for an empty range or bad ticks."""
    ordered = F.when(tick_lower < tick_upper, tick_lower)
    return exact_amounts_between(liquidity, sqrt_ratio(ordered), sqrt_ratio(tick_upper), sqrt_word)
