"""Prices, money and unit conversion as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from poolscope.functions import limbs as L
from poolscope.functions.words import WIDE

Q96 = float(2**96)


def dec(value: int) -> Column:
    """An integer literal as an exact decimal of just enough digits."""
    return F.lit(str(value)).cast(f"decimal({len(str(abs(value)))},0)")


def split_div(x: Column, unit: int) -> tuple[Column, Column]:
    """(quotient, remainder) of a wide integer by a constant, truncating toward zero, exact."""
    r = x % dec(unit)
    return ((x - r) / dec(unit)).cast(WIDE), r


def trunc_div(x: Column, unit: int) -> Column:
    return split_div(x, unit)[0]


def mul_div(x: Column, factor: Column, unit: int) -> Column:
    """trunc(x * factor / unit), exact, for units up to 10^6; NULL where it leaves 38 digits.

    Usual sizes are one product and one division (its six decimals are exact for such units). Past
    10^25 the product could leave 38 digits, so quotient and remainder are scaled apart.
    """
    x, f = x.cast(WIDE), factor.try_cast("decimal(18,0)")
    ratio = (x * f).cast(WIDE) / dec(unit)
    quick = F.when(x < 0, F.ceil(ratio)).otherwise(F.floor(ratio)).cast(WIDE)
    q, r = split_div(x, unit)
    tail = (r.cast("decimal(12,0)") * f).cast(WIDE)
    return F.when((x < dec(10**25)) & (x > dec(-(10**25))) & (f < dec(10**12)), quick).otherwise(
        F.try_add(F.try_multiply(q, f).cast(WIDE), trunc_div(tail, unit)).cast(WIDE)
    )


def leg_fee(amount: Column, pips: Column) -> Column:
    """Fee of one positive leg, truncated per swap; a non-positive leg pays nothing."""
    return F.when(amount > 0, mul_div(amount, pips, 1_000_000)).otherwise(F.lit(0).cast(WIDE))


def plausible_fee(pips: Column, ceiling: int = 100_000) -> Column:
    return F.coalesce(pips <= ceiling, F.lit(False))


def series_price(sqrt_price: Column, token_is_token0: Column) -> Column:
    """Quote per token from a Q96 square-root price held as DOUBLE; NULL when there is no price."""
    s = sqrt_price / F.lit(Q96)
    ratio = s * s
    return F.when(
        sqrt_price > 0, F.when(token_is_token0, ratio).when(ratio > 0, F.lit(1.0) / ratio)
    )


def price_from_sqrt(sqrt_price: Column, decimals0: Column, decimals1: Column) -> Column:
    """Human price of token1 per token0."""
    q = sqrt_price / F.lit(Q96)
    return q * q * F.pow(F.lit(10.0), (decimals0 - decimals1).cast("double"))


def usable_rate(rate: Column) -> Column:
    """NULL unless the rate is a finite positive number."""
    r = rate.cast("double")
    return F.when((r > 0) & ~F.isnan(r) & (r < F.lit(float("inf"))), r)


def native_rate_from_sqrt(sqrt_price: Column, native_is_token0: Column) -> Column:
    return usable_rate(series_price(sqrt_price, native_is_token0))


def to_usd(amount: Column, kind: Column, rate: Column) -> Column:
    """Anchor units -> dollars, both 1e18 fixed point. NULL when the needed rate is unknown."""
    scaled = F.floor(usable_rate(rate) * 1_000_000 + 0.5).try_cast("decimal(18,0)")
    return F.when(kind == "usd", amount.cast(WIDE)).when(
        kind == "bnb", mul_div(amount, scaled, 1_000_000)
    )


def anchor_usd_price(kind: Column, rate: Column) -> Column:
    return F.when(kind == "usd", F.lit(1.0)).when(kind == "bnb", usable_rate(rate))


def fdv_usd(
    series_value: Column,
    supply: Column,
    token_decimals: Column,
    anchor_usd: Column,
    anchor_decimals: int = 18,
) -> Column:
    """Fully diluted value in dollars; NULL for any input that cannot give a meaningful figure."""
    ten = F.lit(10.0)
    dec_d = token_decimals.cast("double")
    whole_supply = supply.cast("double") / F.pow(ten, dec_d)
    price = series_value * F.pow(ten, dec_d - F.lit(float(anchor_decimals)))
    fdv = whole_supply * price * anchor_usd
    sane_in = (supply > 0) & (series_value > 0) & (anchor_usd > 0) & (token_decimals <= 36)
    return F.when(sane_in & ~F.isnan(fdv) & (fdv > 0) & (fdv < F.lit(float("inf"))), fdv)


def apply_slippage(amount: Column, pct: Column) -> Column:
    """Lowest acceptable amount after pct slippage; NULL when pct is outside [0, 100)."""
    keep = F.floor((F.lit(100.0) - pct) * 100 + 0.5).cast("decimal(18,0)")
    return F.when((pct >= 0) & (pct < 100), mul_div(amount, keep, 10_000))


def pow10(n: Column) -> Column:
    """10^n as an exact decimal, for 0 <= n <= 37."""
    return F.rpad(F.lit("1"), (n + 1).cast("int"), F.lit("0")).cast(WIDE)


def _typed_parts(text: Column) -> tuple[Column, Column, Column]:
    """(cleaned text, digits before the point, digits after it) of a typed amount."""
    clean = F.replace(F.trim(text), F.lit(","), F.lit(""))
    return clean, F.split_part(clean, F.lit("."), F.lit(1)), F.split_part(clean, F.lit("."), F.lit(2))


def units_error(text: Column, decimals: Column) -> Column:
    """Why a typed amount cannot be converted, or NULL when it can."""
    clean, _, fraction = _typed_parts(text)
    good = clean.rlike(r"^(?:\d++(?:\.\d*+)?|\.\d++)$")
    return F.when(~F.coalesce(good, F.lit(False)), F.lit("invalid amount")).when(
        F.length(fraction) > decimals, F.lit("too many decimal places")
    )


def to_base_units(text: Column, decimals: Column) -> Column:
    """Typed amount -> exact base units, without a float in between; NULL when invalid or too wide."""
    _, whole, fraction = _typed_parts(text)
    digits = F.concat(F.lit("0"), whole, F.rpad(fraction, decimals.cast("int"), F.lit("0")))
    return F.when(units_error(text, decimals).isNull(), digits.try_cast(WIDE))


def from_base_units(value: Column, decimals: Column, places: int = 6) -> Column:
    """Base units -> text with at most `places` decimals, truncated, trailing zeros dropped."""
    digits = F.lpad(value.cast("string"), F.greatest(F.length(value.cast("string")), decimals + 1).cast("int"), F.lit("0"))
    whole = F.substring(digits, F.lit(1), (F.length(digits) - decimals).cast("int"))
    fraction = F.substring(digits, (F.length(digits) - decimals + 1).cast("int"), F.least(decimals, F.lit(places)).cast("int"))
    trimmed = F.regexp_replace(fraction, "0+$", "")
    return F.when(trimmed == "", whole).otherwise(F.concat(whole, F.lit("."), trimmed))


def fees_to_anchor(fees0: Column, fees1: Column, sqrt_word: Column, anchor_is_token0: Column) -> Column:
    """Both fee legs in anchor units at the given spot, as decimal text.

    The legs are decimals or decimal text of any width. The products pass 256 bits and stay exact in limbs: one
    square, one product or division per row, for aggregated rows. A leg, price or side that is NULL gives NULL.
    """
    parts = F.struct(
        L.from_digits(fees0.cast("string")).alias("f0"), L.from_digits(fees1.cast("string")).alias("f1"),
        L.let(L.from_hex(sqrt_word), lambda p: L.multiply(p, p)).alias("square"), anchor_is_token0.alias("first"),
    )

    def value(v: Column) -> Column:
        # a Q96 price squared carries 192 bits, eight limbs; at price zero the other leg is worth nothing
        in0 = L.add(v["f0"], F.coalesce(L.divide(L.shifted_up(v["f1"], 8), v["square"]), F.when(v["f1"].isNotNull(), F.array(F.lit(0).cast("bigint")))))
        in1 = L.add(v["f1"], L.shifted_down(L.multiply(v["f0"], v["square"]), 8))
        return F.when(v["square"].isNotNull(), L.to_digits(F.when(v["first"], in0).when(~v["first"], in1)))

    return L.let(parts, value)
