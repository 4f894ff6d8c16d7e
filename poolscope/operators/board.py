"""Boards: drop denied tokens, route by anchor, enrich chosen rows, render reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poolscope import config
from poolscope.functions import display as D
from poolscope.sources.reference import lookup


def drop_denied(rows: DataFrame, denied: DataFrame, token_col: str = "token") -> DataFrame:
    """Remove denied tokens before pricing. Matching is by address, case-insensitively."""
    keys = denied.select(F.lower("token").alias("_denied")).distinct()
    return rows.join(keys, F.lower(rows[token_col]) == F.col("_denied"), "left_anti")


def route_boards(rows: DataFrame, keep_unrouted: bool = False) -> DataFrame:
    """Board of each row by its anchor. Anchors without a board are indexed but not published."""
    routed = rows.withColumn("board", lookup(F.lower("anchor"), config.BOARD_BY_ANCHOR))
    return routed if keep_unrouted else routed.filter(F.col("board").isNotNull())


def enrich(
    chosen: DataFrame,
    symbols: DataFrame | None = None,
    audits: DataFrame | None = None,
    token_col: str = "token",
) -> DataFrame:
    """Symbol (or the first 8 characters of the address), verification and risk, fee label.

    Run on chosen rows only: these lookups are the late part of a board.
    """
    out = chosen
    if symbols is not None:
        dim = symbols.select(F.col("token").alias(token_col), F.col("symbol").alias("_symbol"))
        out = out.join(dim, [token_col], "left")
    else:
        out = out.withColumn("_symbol", F.lit(None).cast("string"))
    if audits is not None:
        dim = audits.select(F.col("token").alias(token_col), "verified", "risk")
        out = out.join(dim, [token_col], "left")
    else:
        out = out.withColumn("verified", F.lit(None).cast("boolean")).withColumn("risk", F.lit(None).cast("string"))
    known = F.when(F.col("_symbol") != "", F.col("_symbol"))
    return (
        out.withColumn("symbol", F.coalesce(known, F.substring(token_col, 1, 8)))
        .withColumn("fee_tier", D.fmt_fee_tier(F.col("fee_pips")))
        .drop("_symbol")
    )


def run_metrics(pools: DataFrame, chosen: DataFrame | None = None, by: tuple[str, ...] = ("window_id",)) -> DataFrame:
    """Counts per window: pools, swaps, denied and unrouted pools, rows with wide amounts.

    `pools` has one row per (window, pool) with boolean `denied` and nullable `board`.
    """
    live = ~F.col("denied")
    counts = pools.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pools"),
        F.sum("swaps").alias("swaps"),
        F.count(F.when(F.col("denied"), F.lit(1))).alias("dropped"),
        F.count(F.when(live & F.col("board").isNull(), F.lit(1))).alias("unrouted"),
        F.sum("overflow_rows").alias("overflow_rows"),
    )
    if chosen is None:
        return counts
    per_board = chosen.groupBy(*by, "board").agg(
        F.max("lookups").alias("lookups"),
        F.max(F.col("capped").cast("int")).alias("capped"),
        F.count(F.when(F.col("variant") == "main", F.lit(1))).alias("main_rows"),
        F.count(F.when(F.col("variant") == "danger", F.lit(1))).alias("danger_rows"),
    )
    totals = per_board.groupBy(*by).agg(
        F.count(F.lit(1)).alias("boards"),
        F.sum("lookups").alias("lookups"),
        F.sum("capped").alias("capped_boards"),
        F.sum("main_rows").alias("main_rows"),
        F.sum("danger_rows").alias("danger_rows"),
    )
    joined = counts.join(totals, list(by), "left")
    return joined.fillna(0, ["boards", "lookups", "capped_boards", "main_rows", "danger_rows"])


def plain_row(position: Column) -> Column:
    """Three console lines of one board row."""
    badges = D.fmt_badges(F.col("verified"), F.col("risk"))
    head = F.concat_ws(
        " ",
        D.rank_mark(position, D.PLAIN_MEDALS),
        F.col("symbol"),
        F.when(badges != "", badges),
        F.when(F.col("fee_tier").isNotNull(), F.concat(F.lit("("), F.col("fee_tier"), F.lit(")"))),
    )
    line1 = F.concat(
        head, F.lit(" "), D.fmt_spike(F.col("spike")), F.lit(" · "), D.fmt_rsi(F.col("rsi"), F.col("rsi_label")),
        F.lit(" · "), D.fmt_market_cap(F.col("market_cap_usd")),
    )
    line2 = F.concat(
        F.lit("    "), D.fmt_usd18(F.col("volume_usd")), F.lit(" vol · "), F.col("swaps").cast("string"),
        F.lit(" swaps · "), F.col("traders").cast("string"), F.lit(" traders · "),
        D.fmt_usd18(F.col("fees_usd")), F.lit(" fees"),
    )
    line3 = F.concat(F.lit("    ↳ "), D.short_addr(F.col("token")))
    return F.concat_ws("\n", line1, line2, line3)


def html_row(position: Column) -> Column:
    """Three lines of one board row as chat HTML. Only the symbol is untrusted text."""
    tier = F.when(F.col("fee_tier").isNotNull(), F.concat(F.lit(" ("), F.col("fee_tier"), F.lit(")"))).otherwise(F.lit(""))
    line1 = F.concat(
        D.rank_mark(position, D.MEDALS), F.lit(" <b>"), D.html_escape(F.col("symbol")), F.lit("</b>"),
        D.audit_badge(F.col("verified"), F.col("risk")), tier, F.lit(" · "),
        D.fmt_rsi(F.col("rsi"), F.col("rsi_label")), F.lit(" · "), D.fmt_market_cap(F.col("market_cap_usd"), html=True),
    )
    line2 = F.concat(
        F.lit("    "), D.fmt_usd_amount(F.col("volume_usd")), F.lit(" vol · "), F.col("swaps").cast("string"),
        F.lit(" swaps · "), F.col("traders").cast("string"), F.lit(" traders · "),
        D.fmt_usd_amount(F.col("fees_usd")), F.lit(" fees"),
    )
    return F.concat_ws("\n", line1, line2, F.concat(F.lit("    ↳ "), D.token_link(F.col("token"))))


# --- fixed values: report titles ---
HTML_TITLES = {
    "wbnb": "🥞 <b>PancakeSwap v3 — Top Movers</b> · <i>WBNB pairs</i>",
    "usdt": "🥞 <b>PancakeSwap v3 — Top Movers</b> · <i>USDT pairs</i>",
    "cl": "♾️ <b>PancakeSwap Infinity — Top Movers</b>",
}
TOO_LARGE = "<i>(board too large to render)</i>"


def html_title(board: Column, variant: Column, label: Column) -> Column:
    danger = F.concat(
        F.lit("⚠️ <b>Danger Zone — "), D.html_escape(F.coalesce(label, F.lit("PancakeSwap"))), F.lit("</b>")
    )
    return F.when(variant == "danger", danger).otherwise(D.pick(board, HTML_TITLES, ""))


def plain_title(variant: Column, label: Column) -> Column:
    return F.when(
        variant == "danger", F.concat(F.lit("⚠️  Danger Zone — "), F.coalesce(label, F.lit("unknown source")))
    ).otherwise(F.concat(F.lit("📈 "), F.coalesce(label, F.lit("Top Movers"))))


def fit_rows(
    rows: DataFrame,
    group: list[str],
    text: str = "row_text",
    header_units: Column | None = None,
    position: str = "group_pos",
    limit: int = config.MAX_MESSAGE_UNITS,
    gap: int = 2,
) -> DataFrame:
    """Keep the longest run of leading rows whose rendered message fits the limit.

    The size of a message with its first n rows is the header, the rows so far and the gaps between
    them, all counted in UTF-16 units. A board whose first row alone does not fit keeps that row with
    `placeholder` true, to be rendered as one "too large" line. Whole rows go, never parts of one.
    """
    so_far = Window.partitionBy(*group).orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.row_number().over(Window.partitionBy(*group).orderBy(position))
    size = F.sum(D.utf16_units(F.col(text))).over(so_far) + (F.col("_n") - 1) * gap
    base = header_units if header_units is not None else F.lit(0)
    # Every row after the first costs at least its gap, so rows past this number cannot fit.
    at_most = limit // gap + 1 if gap > 0 else None
    numbered = rows.withColumn("_n", n)
    if at_most is not None:
        numbered = numbered.filter(F.col("_n") <= at_most)
    return (
        numbered.withColumn("message_units", (size + base).cast("bigint"))
        .withColumn("placeholder", (F.col("_n") == 1) & (F.col("message_units") > limit))
        .filter((F.col("message_units") <= limit) | F.col("placeholder"))
        .drop("_n")
    )


def board_report(rows: DataFrame, group: list[str], html: bool = True) -> DataFrame:
    """One finished message per board and variant, from its at most 2 x N chosen rows."""
    pos = F.col("group_pos")
    if html:
        title = html_title(F.col("board"), F.col("variant"), F.col("label"))
        head = F.concat(title, F.lit("\n<i>"), D.block_span(F.col("from_block"), F.col("to_block")), F.lit("</i>\n\n"))
        staged = rows.withColumn("_head", head).withColumn("row_text", html_row(pos))
        fitted = fit_rows(staged, group, header_units=D.utf16_units(F.col("_head")))
        body = F.when(F.col("placeholder"), F.lit(TOO_LARGE)).otherwise(F.col("row_text"))
        gap = "\n\n"
    else:
        span = F.concat(
            F.lit("blocks "), F.col("from_block").cast("string"), F.lit("–"), F.col("to_block").cast("string")
        )
        head = F.concat(plain_title(F.col("variant"), F.col("label")), F.lit("  ("), span, F.lit(")\n"))
        fitted = rows.withColumn("_head", head).withColumn("row_text", plain_row(pos))
        body, gap = F.col("row_text"), "\n"
    lines = F.array_sort(F.collect_list(F.struct(pos.alias("p"), body.alias("t"))))
    return fitted.groupBy(*group, "_head").agg(lines.alias("_lines"), F.count(F.lit(1)).alias("rows")).select(
        *group, "rows", F.concat(F.col("_head"), F.array_join(F.transform("_lines", lambda x: x["t"]), gap)).alias("message")
    )
