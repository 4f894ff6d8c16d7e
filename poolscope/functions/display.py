"""Report text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from poolscope.config import EXPLORER_TOKEN_URL
from poolscope.functions.words import magnitude

# --- fixed values: report marks ---
DASH = "—"
MEDALS = ["🥇", "🥈", "🥉", "4️⃣", "5️⃣", "6️⃣", "7️⃣", "8️⃣"]
PLAIN_MEDALS = ["🥇", "🥈", "🥉"]
RISK_LIGHTS = {"clean": "🟢", "caution": "🟡", "high": "🔴", "unknown": "⬜"}
VERIFIED_MARK = "✅"
UNVERIFIED_MARK = "⚠️"
NO_AUDIT_MARK = "❔"
STATUS_MARKS = {
    "success": "✅",
    "error": "❌",
    "system_error": "❌",
    "external_error": "❌",
    "cancelled": "⬜",
    "pending": "⏳",
    "running": "⏳",
}


def pick(value: Column, table: dict[str, str], default: str | None) -> Column:
    out = F.lit(default).cast("string")
    for key, text in table.items():
        out = F.when(value == key, F.lit(text)).otherwise(out)
    return out


def fixed(x: Column, places: int) -> Column:
    """A number with fixed decimals, half up."""
    return F.round(x.cast(f"decimal(38,{max(places + 6, 8)})"), places).cast(f"decimal(38,{places})").cast("string")


def grouped(n: Column) -> Column:
    """Thousands separators for a non-negative integer of any width."""
    text = n.cast("string")
    return F.regexp_replace(text, r"(\d)(?=(\d{3})+$)", "$1,")


def fmt_fee_tier(pips: Column) -> Column:
    """2500 -> '0.25%': at most four decimals, no trailing zeros."""
    pct = (pips.cast("decimal(20,0)") / F.lit(10000).cast("decimal(5,0)")).cast("decimal(24,4)").cast("string")
    return F.concat(F.regexp_replace(F.regexp_replace(pct, "0+$", ""), r"\.$", ""), F.lit("%"))


def _scaled(usd: Column, units: list[tuple[float, str]], otherwise: Column) -> Column:
    out = otherwise
    for size, suffix in reversed(units):
        out = F.when(usd >= size, F.concat(F.lit("$"), fixed(usd / size, 1), F.lit(suffix))).otherwise(out)
    return out


def fmt_usd18(value: Column) -> Column:
    """A 1e18 fixed-point dollar amount, abbreviated; unknown is a dash and never $0."""
    usd = value.cast("double") / 1e18
    small = F.when(usd < 0.01, F.lit("<$0.01")).otherwise(F.concat(F.lit("$"), fixed(usd, 2)))
    text = F.when(usd == 0, F.lit("$0")).otherwise(_scaled(usd, [(1e9, "B"), (1e6, "M"), (1e3, "K")], small))
    return F.when(value.isNull(), F.lit(DASH)).otherwise(text)


def fmt_market_cap(usd: Column, html: bool = False) -> Column:
    """'MC $1.2M'. The HTML form must escape the '<' of a sub-dollar cap."""
    tiers = [(1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "K")]
    text = _scaled(usd, tiers, F.concat(F.lit("$"), fixed(usd, 0)))
    body = F.concat(F.lit("MC "), text)
    tiny = ((usd > 0) & (usd < 1)) if html else (usd < 1)
    return (
        F.when(usd.isNull(), F.lit("MC " + DASH))
        .when(tiny, F.lit("MC &lt;$1" if html else "MC <$1"))
        .otherwise(body)
    )


def fmt_usd_amount(value: Column, decimals: int = 2) -> Column:
    """Exact dollars from 1e18 fixed point, truncated so a figure never reads too high."""
    digits = magnitude(value).cast("string")
    padded = F.lpad(digits, F.greatest(F.length(digits), F.lit(19)).cast("int"), F.lit("0"))
    whole = F.substring(padded, F.lit(1), (F.length(padded) - 18).cast("int"))
    fraction = F.substring(padded, (F.length(padded) - 17).cast("int"), F.lit(decimals))
    sign = F.when(value < 0, F.lit("-")).otherwise(F.lit(""))
    parts = [sign, F.lit("$"), grouped(whole)] + ([F.lit("."), fraction] if decimals > 0 else [])
    return F.when(value.isNull(), F.lit(DASH)).otherwise(F.concat(*parts))


def _mark(verified: Column) -> Column:
    return F.when(verified, F.lit(VERIFIED_MARK)).otherwise(F.lit(UNVERIFIED_MARK))


def fmt_badges(verified: Column, risk: Column) -> Column:
    """Plain report badge: each half is blank when it is unknown."""
    first = F.when(verified.isNull(), F.lit("")).otherwise(_mark(verified))
    return F.concat(first, F.coalesce(pick(risk, RISK_LIGHTS, None), F.lit("")))


def audit_badge(verified: Column, risk: Column) -> Column:
    """HTML report badge: blank when the verdict is unknown, a white light for an unknown risk."""
    light = pick(risk, RISK_LIGHTS, RISK_LIGHTS["unknown"])
    return F.when(verified.isNull(), F.lit("")).otherwise(F.concat(F.lit(" "), _mark(verified), light))


def fmt_rsi(rsi: Column, label: Column) -> Column:
    badge = (
        F.when(label == "oversold", F.lit(" 🟢 Oversold"))
        .when(label == "overbought", F.lit(" 🔴 Overbought"))
        .otherwise(F.lit(""))
    )
    return F.when(rsi.isNull(), F.lit("RSI " + DASH)).otherwise(
        F.concat(F.lit("RSI "), F.floor(rsi + 0.5).cast("int").cast("string"), badge)
    )


def fmt_spike(spike: Column) -> Column:
    return (
        F.when(spike.isNull(), F.lit("(warming)"))
        .when(spike >= 10, F.concat(fixed(spike, 0), F.lit("x")))
        .otherwise(F.concat(fixed(spike, 1), F.lit("x")))
    )


def short_addr(address: Column) -> Column:
    return F.when(
        F.length(address) > 12,
        F.concat(F.substring(address, 1, 6), F.lit("…"), F.right(address, F.lit(4))),
    ).otherwise(address)


def html_escape(text: Column) -> Column:
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def utf16_units(text: Column) -> Column:
    """Length in UTF-16 code units, the unit message limits are counted in."""
    return F.length(text) + F.regexp_count(text, F.lit("[\\x{10000}-\\x{10FFFF}]"))


def rank_mark(position: Column, medals: list[str]) -> Column:
    out = F.concat(position.cast("string"), F.lit("."))
    for i, medal in enumerate(medals, start=1):
        out = F.when(position == i, F.lit(medal)).otherwise(out)
    return out


def token_link(token: Column) -> Column:
    return F.concat(
        F.lit('<a href="' + EXPLORER_TOKEN_URL), token, F.lit('">'), short_addr(token), F.lit("</a>")
    )


def block_span(from_block: Column, to_block: Column) -> Column:
    return F.when(
        from_block == to_block, F.concat(F.lit("block "), grouped(to_block))
    ).otherwise(F.concat(F.lit("blocks "), grouped(from_block), F.lit("–"), grouped(to_block)))


def fmt_when(iso: Column) -> Column:
    """ISO time -> 'yyyy-MM-dd HH:mm' in UTC, a dash when it cannot be read."""
    ts = F.try_to_timestamp(iso)
    utc = F.to_utc_timestamp(ts, F.current_timezone())
    return F.coalesce(F.date_format(utc, "yyyy-MM-dd HH:mm"), F.lit(DASH))
